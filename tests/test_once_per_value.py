from pyspark.sql import functions as F

from kerbside.functions.text import normalize_violation_type
from kerbside.functions.timefn import parse_utc
from kerbside.profiles import BATCH, LIVE

TEXTS = [None, "", "  ", "[]", "[null]", '["a b","c"]', ' ["x"] ', "['q','r']", '["open', '[open] tail', "plain text", "nan", '[1, 2]', '["a"] ["b"]', '[,"z"]']


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_value_is_parsed_as_an_array_once(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    want = {
        "live": ["Unknown", "Unknown", "Unknown", "[]", "[Null]", "A B", "X", "Q", "Open", "Open] Tail", "Plain Text", "Nan", "1", "A", "Unknown"],
        "batch": ["Unknown", "Unknown", "", "[]", "[Null]", "A B", "X", "['Q','R']", '["Open', "[Open] Tail", "Plain Text", "Unknown", "1", "A", "Z"],
    }
    for p in (LIVE, BATCH):
        out = df.select(normalize_violation_type(F.col("t"), p).alias("v"))
        assert _plan(out).lower().count("from_json(") + _plan(out).lower().count("jsontostructs(") == 1
        assert [r.v for r in out.collect()] == want[p.name]


def test_the_offset_of_a_timestamp_is_searched_once(spark):
    df = spark.createDataFrame([("2024-01-01 05:30:00+05:30",), ("2024-01-01 00:00:00",), ("2024-01-01 00:00:00Z",), ("2023-12-31 19:00-0500",), ("NULL",)], "t string")
    out = df.select(parse_utc(F.col("t")).alias("v"))
    assert _plan(out).count("(Z|[+-]") == 1
    assert [str(r.v) for r in out.collect()] == ["2024-01-01 00:00:00"] * 4 + ["None"]
