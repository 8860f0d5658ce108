import json

from pyspark.sql import functions as F

from kerbside.operators import timestats as ts
from kerbside.operators.heatmap import heat_cells, heat_points, map_sample
from kerbside.operators.outputs import insight_context_json
from kerbside.operators.recommend import prompt_rows, top_clusters
from kerbside.operators.score import junction_count_text
from kerbside.plans.inputs import clusters, labeled, scored
from kerbside.schema import with_alias_columns

SF = "/root/testdata/sf0.001"


def test_junction_count_text(spark):
    df = spark.createDataFrame([("['A', 'B']",), ('["A"]',), ("MG Road",), ("",), (None,), ("[]",)], "s string")
    assert [r[0] for r in df.select(junction_count_text(F.col("s"))).collect()] == [2, 1, 1, 0, 0, 0]


def test_lat_lon_name_variants(spark):
    df = spark.createDataFrame([(1, 12.90001, 77.50004), (2, 12.90004, 77.50001)], "id long, lat double, lon double")
    assert "latitude" in with_alias_columns(df).columns
    cells = heat_cells(df).collect()
    assert len(cells) == 1 and cells[0]["count"] == 2 and cells[0].weight == 1.0


def test_heat_points_thinning_positions(spark):
    df = spark.range(0, 60).select(F.col("id"), (F.lit(12.0) + F.col("id") * 1e-3).alias("latitude"),
                                   F.lit(77.0).alias("longitude"))
    got = sorted(r.position for r in heat_points(df, cap=7).collect())
    assert got == sorted({int(i * (60 / 7)) for i in range(7)})
    assert heat_points(df, cap=100).count() == 60


def test_map_sample_size_and_repartition_stability(spark):
    v = labeled(spark, SF, "batch")
    a = map_sample(v, n=50)
    b = map_sample(v.repartition(5), n=50)
    assert a.count() == 50
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert map_sample(v, n=10**6).count() == v.count()
    assert a.filter(F.col("junction_name") == "No Junction").count() == 0


def test_prompt_rows_round_fields(spark):
    p = prompt_rows(top_clusters(scored(spark, SF, "live"), 5)).collect()
    assert len(p) <= 5 and [r["rank"] for r in p] == list(range(len(p)))
    for r in p:
        assert r.impact_score == round(r.impact_score, 2) and r.peak_hour_ratio == round(r.peak_hour_ratio, 4)


def test_insight_context_json_document(spark):
    lab = labeled(spark, SF, "live")
    doc = json.loads(insight_context_json(
        lab, scored(spark, SF, "live"), ts.hourly(lab, "live"), ts.day_of_week(lab, "live"),
        ts.top_junctions(lab, "live", keep_first_id=True), ts.vehicle_mix(lab, "live", keep_first_id=True),
        ts.violation_mix(lab, "live", keep_first_id=True), ts.resolution_buckets(lab, "live")).first().context)
    assert doc["total_violations"] == lab.count()
    assert len(doc["top_5_hours"]) == 5 and doc["top_5_hours"][0]["hour"].endswith(":59")
    assert list(doc["day_of_week_breakdown"])[0] == "Monday"
    assert set(doc["resolution_time_distribution"]) == {"<30min", "30-60min", "1-2hrs", "2-6hrs", ">6hrs"}
    assert doc["peak_hour"].endswith("violations") and len(doc["top_clusters"]) <= 5
