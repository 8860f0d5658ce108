import duckdb
import pytest

import __spark_entry__ as entry
from kerbside.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "impact_score" in df.columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    assert df.count() == len(con.sql(entry.oracle_sql()["impact_live"]).fetchall()) > 0


def test_every_query_has_oracle_or_is_rows_only():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(o)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return repr(v) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_at_small_scale(spark, duck, name):
    s = entry.queries()[name](spark, SF)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(s.columns) == sorted(rel.columns), name
    cols = sorted(s.columns)
    srows = sorted(str(tuple(_norm(r[c]) for c in cols)) for r in s.collect())
    idx = {c: i for i, c in enumerate(rel.columns)}
    drows = sorted(str(tuple(_norm(r[idx[c]]) for c in cols)) for r in rel.fetchall())
    assert srows == drows, name
