import json
import os

from pyspark.sql import functions as F

from kerbside.operators.outputs import dashboard, geojson_features, ts_text
from kerbside.operators.score import score_live
from kerbside.sources.csv import read_records_csv
from kerbside.sources.report import report_rows, write_report
from kerbside.sources.snapshot import backfill_clusters, publish, read_published
from kerbside.sources.synthetic import synthetic_records
from kerbside.operators.clean import clean
from kerbside.operators.clusters import cluster_summary, label_points


def test_csv_reader_keeps_arrays_newlines_and_text(spark, tmp_path):
    p = tmp_path / "in"
    p.mkdir()
    (p / "a.csv").write_text(
        'id,latitude,longitude,violation_type,description,validation_status\n'
        '1,12.9,77.5,"[""WRONG PARKING"",""NO PARKING""]","two\nlines",NULL\n'
        '2,12.9,77.5,,"",NA\n')
    (p / "ignore.txt").write_text("not,a,record\n")
    df = read_records_csv(spark, str(p)).orderBy("id")
    rows = df.collect()
    assert len(rows) == 2
    assert rows[0].violation_type == '["WRONG PARKING","NO PARKING"]'
    assert rows[0].description == "two\nlines" and rows[0].validation_status == "NULL"
    assert rows[1].violation_type is None and rows[1].description is None and rows[1].validation_status == "NA"
    assert "junction_name" in df.columns
    assert clean(df, "live").first().violation_type == "Wrong Parking"


def test_synthetic_records_through_all_operators(spark, tmp_path):
    raw = synthetic_records(spark, n=500, seed=11)
    assert raw.count() == 500
    v = clean(raw, "live")
    lab = label_points(v, "live")
    cl = cluster_summary(lab, "live")
    sc = score_live(cl)
    d = dashboard(lab, sc, "live").first()
    assert d.total_violations == 500 and d.active_clusters == cl.count()
    feats = [json.loads(r.feature) for r in geojson_features(sc).collect()]
    if feats:
        f = feats[0]
        assert f["type"] == "Feature" and f["geometry"]["type"] == "Point"
        assert len(f["properties"]) == 13
        lon, lat = f["geometry"]["coordinates"]
        assert 77 < lon < 78 and 12 < lat < 13


def test_snapshot_publish_read_backfill(spark, tmp_path):
    df = spark.createDataFrame([(1, 800, 0.6), (2, 300, 0.2)], "cluster_id int, violation_count long, peak_hour_ratio double")
    root = str(tmp_path / "snap")
    publish(spark, root, "run1", {"clusters": df})
    back = {r.cluster_id: r for r in backfill_clusters(read_published(spark, root, "clusters")).collect()}
    assert back[1].impact_score == 80.0 and back[1].priority_tier == "Critical"
    assert back[1].recommended_enforcement_time == "7-9 AM and 5-8 PM"
    assert back[2].impact_score == 30.0 and back[2].priority_tier == "Low"
    publish(spark, root, "run2", {"clusters": df.filter("cluster_id = 1")})
    assert read_published(spark, root, "clusters").count() == 1
    publish(spark, root, "run3", {"clusters": df.filter("cluster_id = 9")})
    none = backfill_clusters(read_published(spark, root, "clusters"))
    assert none.count() == 0 and {"violation_count", "impact_score", "priority_color"} <= set(none.columns)


def test_report_rows_written_as_lines(spark, tmp_path):
    d = spark.createDataFrame([(3, 1)], "total_violations long, active_clusters long")
    c = spark.createDataFrame([(0, 2.5)], "cluster_id int, impact_score double")
    h = spark.createDataFrame([(0, 5)], "hour int, count long")
    r = spark.createDataFrame([(0, "x")], "rank int, description string")
    rows = report_rows(d, c, {"hourly": (h, "hour")}, r)
    assert [x.section for x in rows.collect()] == ["dashboard", "clusters", "time_stats.hourly", "recommendations"]
    out = str(tmp_path / "report")
    write_report(rows, out)
    lines = [json.loads(l) for f in os.listdir(out) if f.startswith("part") for l in open(os.path.join(out, f))]
    by_section = {x["section"]: x for x in lines}
    assert len(lines) == 4 and json.loads(by_section["clusters"]["payload"]) == {"cluster_id": 0, "impact_score": 2.5}


def test_csv_position_order_key(spark, tmp_path):
    p = tmp_path / "pos"
    p.mkdir()
    (p / "a.csv").write_text("id,latitude,longitude\nX9,12.9,77.5\nA1,12.91,77.51\nB2,12.92,77.52\n")
    rows = read_records_csv(spark, str(p), order_key="position").orderBy("id").collect()
    assert [r.latitude for r in rows] == ["12.9", "12.91", "12.92"]
    assert [r.id for r in rows] == sorted(r.id for r in rows)


def test_csv_position_follows_file_order_not_split_sizes(spark, tmp_path):
    p = tmp_path / "pos2"
    p.mkdir()
    (p / "a.csv").write_text("latitude,longitude\n1,1\n2,1\n")
    (p / "b.csv").write_text("latitude,longitude\n" + "".join(f"{i},2\n" for i in range(3, 5000)))
    rows = read_records_csv(spark, str(p), order_key="position").select("id", "latitude").collect()
    assert all(str(r.id) == r.latitude for r in rows) and len(rows) == 4999
