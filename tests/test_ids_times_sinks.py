"""Ids of any kind, written timestamps, and sinks without NaN."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions.text import finite_columns
from kerbside.functions.timefn import parse_local_wall_clock, parse_utc
from kerbside.operators.clean import clean
from kerbside.operators.outputs import geojson_features
from kerbside.plans.job import main, run_job
from kerbside.schema import with_sequence
from kerbside.sources.csv import read_records_csv
from kerbside.sources.snapshot import current_run, prune, publish, read_published
from kerbside.streaming import ingest

HEADER = "id,latitude,longitude,vehicle_type,violation_type,created_datetime,closed_datetime,junction_name,police_station,validation_status\n"
WRITTEN = {
    "20/11/2023 00:28": "2023-11-20 00:28:00", "Nov 20, 2023 00:28": "2023-11-20 00:28:00", "11/20/2023 12:28 AM": "2023-11-20 00:28:00",
    "05/11/2023 7:05:09 pm": "2023-05-11 19:05:09", "20 November 2023": "2023-11-20 00:00:00", "20-Nov-2023 23:59:59.250": "2023-11-20 23:59:59.250",
    "Mon, 20 Nov 2023 00:28:46 +0530": "2023-11-20 00:28:46", "2023/11/20 00:28:46": "2023-11-20 00:28:46", "20231120": "2023-11-20 00:00:00",
    "November 20th, 2023 at 12:00 PM": "2023-11-20 12:00:00", "20.11.2023 08:15": "2023-11-20 08:15:00", "2023-11-20 00:28:46+05:30": "2023-11-20 00:28:46",
    "2023-11-20T00:28:46Z": "2023-11-20 00:28:46", "31/31/2023": None, "30/02/2023 10:00": None, "20/11/2023 25:00": None, "13:00 pm": None, "NULL": None,
    "": None, "no date": None, "20/11/2023 13:00 pm later": None, None: None,
}


def test_written_timestamps(spark):
    df = spark.createDataFrame([(k, v) for k, v in WRITTEN.items()], "c string, want string")
    got = df.select("c", parse_local_wall_clock(F.col("c")).alias("t"), F.col("want").cast("timestamp_ntz").alias("w")).collect()
    assert [(g.c, g.t) for g in got] == [(g.c, g.w) for g in got]
    two = spark.createDataFrame([("20/11/23 01:00",)], "c string").select(parse_local_wall_clock(F.col("c")).alias("t")).first().t
    assert str(two) == "2023-11-20 01:00:00"
    utc = spark.createDataFrame([("Nov 20, 2023 00:28 +05:30",)], "c string").select(parse_utc(F.col("c")).alias("t")).first().t
    assert str(utc) == "2023-11-19 18:58:00"


def rows(n, prefix="KA-"):
    rnd = random.Random(4)
    return [(f"{prefix}{rnd.randrange(10**6)}", f"{12.9 + (i % 3) * 0.01 + (i % 7) * 1e-5:.6f}", "77.5", rnd.choice(["CAR", "BUS", "LGV"]), rnd.choice(["A", "B"]),
             rnd.choice(["20/11/2023 08:28", '"Nov 21, 2023 09:10"']), "", rnd.choice(["J1", "J2"]), "PS", "VALID") for i in range(n)]


def test_text_ids_come_out_and_file_order_decides(spark, tmp_path):
    table = rows(60)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + "".join(",".join(r) + "\n" for r in table[:25]))
    (tmp_path / "in" / "b.csv").write_text(HEADER + "".join(",".join(r) + "\n" for r in table[25:]))
    raw = read_records_csv(spark, str(tmp_path / "in"), order_key="file")
    assert [r.id for r in raw.orderBy("seq").collect()] == [r[0] for r in table]
    out = run_job(spark, raw, "live")
    got = {r.id: r for r in out["labeled"].collect()}
    assert set(got) == {r[0] for r in table} and not any(r.created_datetime is None for r in got.values())
    # clusters are numbered by the first record of each in the files: rows 0, 1, 2 are one of each
    assert [got[table[i][0]].cluster_label for i in range(3)] == [0, 1, 2]
    first = {}
    for i, r in enumerate(table):
        first.setdefault(r[3], i)
    count = {v: sum(r[3] == v for r in table) for v in first}
    assert [r.vehicle_type for r in out["vehicle_types"].collect()] == sorted(first, key=lambda v: (-count[v], first[v]))


def test_command_line_reads_text_ids_and_written_times(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + "".join(",".join(r) + "\n" for r in rows(30)))
    main(["--input", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--run-id", "r"])
    assert read_published(spark, str(tmp_path / "out"), "clusters").filter("first_seen IS NOT NULL").count() == 3


def test_sequence_ranks_ids_of_any_kind(spark):
    raw = spark.createDataFrame([(x,) for x in ["b", "10", "9", None, "a", "", "b"]], "id string")
    got = [(r.id, r.seq) for r in with_sequence(raw).orderBy("seq").collect()]
    assert [g[0] for g in got[:5]] == ["9", "10", "a", "b", "b"] and [g[1] for g in got] == list(range(7))
    assert [(r.id, r.seq) for r in with_sequence(spark.createDataFrame([("7",), ("x",)], "id string").limit(1)).collect()] == [("7", 7)]
    assert with_sequence(spark.createDataFrame([(5,)], "id long")).first().seq == 5
    kept = clean(spark.createDataFrame([("KA-1", "12.9", "77.5", "2024-01-01 08:00:00", "VALID")], "id string, latitude string, longitude string, created_datetime string, validation_status string"))
    assert kept.first().id == "KA-1"


def test_no_sink_writes_nan(spark, tmp_path):
    bad = float("nan")
    kind = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.ArrayType(T.StructType([T.StructField("x", T.FloatType())]))),
                         T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))), T.StructField("s", T.StringType())])
    df = spark.createDataFrame([(bad, [(bad,), (1.5,)], {"k": [float("inf"), 2.0]}, "NaN"), (1.0, None, None, None)], kind)
    got = [json.loads(x) for x in finite_columns(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toPandas()["j"]]
    assert got == [{"a": None, "b": [{"x": None}, {"x": 1.5}], "m": {"k": [None, 2.0]}, "s": "NaN"}, {"a": 1.0, "b": None, "m": None, "s": None}]
    scored = spark.createDataFrame([(0, bad, 77.0, 3, "T", 0.5, bad, float("-inf"), "High", "#fff", "w", ["j"], ["p"], None, None)],
                                   "cluster_id int, centroid_lat double, centroid_lon double, violation_count long, dominant_violation_type string, peak_hour_ratio double, "
                                   "avg_resolution_minutes double, impact_score double, priority_tier string, priority_color string, recommended_enforcement_time string, "
                                   "junctions_covered array<string>, police_stations_involved array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz")
    feature = json.loads(geojson_features(scored).first().feature)
    assert feature["geometry"]["coordinates"] == [77.0, None] and feature["properties"]["impact_score"] is None
    publish(spark, str(tmp_path), "r", {"clusters": scored})
    assert "NaN" not in "".join(p.read_text() for p in (tmp_path / "runs").rglob("part-*.json"))


def test_publishers_at_once_get_numbers_of_their_own(spark, tmp_path):
    root = str(tmp_path / "p")
    small = spark.createDataFrame([(1,)], "x int")
    errors = []

    def one(name):
        try:
            publish(spark, root, name, {"t": small})
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=one, args=(f"r{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    names = sorted(p.name for p in (tmp_path / "p" / "CURRENT").glob("[0-9]*.json"))
    assert names == [f"{i:012d}.json" for i in range(1, 5)]
    last = current_run(spark, root)
    assert last["number"] == 4 and read_published(spark, root, "t").first().x == 1
    gone = prune(spark, root, keep=2)
    assert len(gone) == 2 and last["run_id"] not in gone and current_run(spark, root)["run_id"] == last["run_id"]
    assert sorted(p.name for p in (tmp_path / "p" / "runs").iterdir()) == sorted({f"r{i}" for i in range(4)} - set(gone))


def test_a_replayed_batch_is_not_counted_twice(spark, tmp_path, monkeypatch):
    landing, table = tmp_path / "in", str(tmp_path / "table")
    landing.mkdir()
    (landing / "a.csv").write_text(HEADER + "".join(",".join(r) + "\n" for r in rows(10)))
    plain = ingest.clean

    # the same batch number comes again when a run ended before its commit: a fresh stream checkpoint replays batch 0
    for ck in ("ck1", "ck2"):
        ingest.ingest_available(spark, str(landing), table, str(tmp_path / ck), columns=HEADER.strip().split(","))
    assert plain is ingest.clean and spark.read.parquet(table).count() == 10


@pytest.mark.parametrize("order", ["id", "file"])
def test_numeric_text_ids_order_by_value(spark, tmp_path, order):
    (tmp_path / "a.csv").write_text(HEADER + "".join(f"{i},12.9,77.5,CAR,A,2024-01-01 08:00:00,,J,PS,VALID\n" for i in (9, 10, 11)))
    got = clean(with_sequence(read_records_csv(spark, str(tmp_path), order_key=order))).orderBy("seq").collect()
    assert [r.id for r in got] == ["9", "10", "11"] and [r.seq for r in got] == ([9, 10, 11] if order == "id" else [1, 2, 3])
