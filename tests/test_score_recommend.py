import datetime as dt

import pytest
from pyspark.sql import functions as F

from kerbside.operators.recommend import (TEMPLATES, extract_json_array, parse_responses,
                                          recommend_from_templates, recommend_with_responses)
from kerbside.operators.score import score_batch, score_live
from kerbside.schema import CLUSTER_SCHEMA


def clusters(spark, rows):
    full = []
    for i, (vc, uvt, peak, res, junctions) in enumerate(rows):
        full.append((i, 12.9, 77.5, vc, uvt, "No Parking", peak, res, junctions, ["PS 1"],
                     dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)))
    return spark.createDataFrame(full, CLUSTER_SCHEMA)


def test_empty_cluster_set_keeps_columns(spark):
    out = score_live(spark.createDataFrame([], CLUSTER_SCHEMA))
    assert out.count() == 0
    assert out.columns[-4:] == ["impact_score", "priority_tier", "priority_color", "recommended_enforcement_time"]


def test_single_cluster_scores_fifty(spark):
    r = score_live(clusters(spark, [(10, 2, 0.3, 12.0, ["A"])])).first()
    assert (r.impact_score, r.priority_tier, r.priority_color) == (50.0, "High", "#f97316")
    assert r.recommended_enforcement_time == "Evening Rush Hours (5-8 PM)"


def test_zero_resolution_uses_epsilon(spark):
    rows = [(10, 1, 0.0, 0.0, []), (10, 1, 0.0, 1.0, []), (10, 1, 0.0, None, [])]
    s = {r.cluster_id: r.impact_score for r in score_live(clusters(spark, rows)).collect()}
    # 1/1e-6 is the maximum: clusters 0 and 2 share it, cluster 1 is the minimum
    assert s[0] == s[2] > s[1]


def test_live_windows_and_tiers(spark):
    rows = [(100, 6, 0.5, 10.0, ["A", "B", "C"]), (1, 1, 0.2999, 500.0, []), (50, 3, 0.3, 50.0, ["A"])]
    out = {r.cluster_id: r for r in score_live(clusters(spark, rows)).collect()}
    assert out[0].recommended_enforcement_time.startswith("Morning & Evening")
    assert out[1].recommended_enforcement_time.startswith("Business Hours")
    assert out[2].recommended_enforcement_time.startswith("Evening Rush")
    assert out[0].impact_score == 100.0 and out[0].priority_tier == "Critical"
    assert out[1].impact_score == 0.0 and out[1].priority_tier == "Low"


@pytest.mark.parametrize("vc,base", [(100, 10), (101, 20), (200, 20), (201, 30), (500, 30), (501, 40)])
def test_batch_count_thresholds(spark, vc, base):
    r = score_batch(clusters(spark, [(vc, 0, 0.0, 0.0, [])])).first()
    assert r.impact_score == base + 5


@pytest.mark.parametrize("res,pts", [(30.0, 5), (30.5, 10), (60.0, 10), (61.0, 15), (120.0, 15), (121.0, 20)])
def test_batch_resolution_thresholds(spark, res, pts):
    r = score_batch(clusters(spark, [(10, 0, 0.0, res, [])])).first()
    assert r.impact_score == 10 + pts


def test_batch_tiers_and_cap(spark):
    rows = [(600, 10, 1.0, 200.0, []),   # 40 + 30 + 20 + 10 = 100
            (600, 0, 0.5, 130.0, []),    # 40 + 15 + 20 + 0 = 75
            (600, 0, 0.4997, 130.0, []), # 74.99 -> 75.0 after rounding to 1 place
            (150, 0, 0.0, 10.0, [])]     # 20 + 5 = 25
    out = [(r.impact_score, r.priority_tier, r.recommended_enforcement_time)
           for r in score_batch(clusters(spark, rows)).orderBy("cluster_id").collect()]
    assert out[0] == (100.0, "Critical", "7-9 AM and 5-8 PM")
    assert out[1] == (75.0, "Critical", "10 AM - 4 PM")
    assert out[3] == (25.0, "Low", "10 AM - 4 PM")


def test_extract_json_array(spark):
    texts = [("a", 'Sure!\n```json\n[{"cluster_id": 1, "description": "d1"}]\n```\nbye'),
             ("b", 'Here [it is]: [{"cluster_id": 2, "description": "x]"}] trailing [text]'),
             ("c", "no array here"),
             ("d", '[{"cluster_id": 3, "description": "nested [ok]"}] and more')]
    df = spark.createDataFrame(texts, "k string, response string")
    got = {r.k: r.a for r in df.select("k", extract_json_array(F.col("response")).alias("a")).collect()}
    assert got["a"][0]["cluster_id"] == 1 and got["a"][0]["description"] == "d1"
    assert got["c"] is None
    assert got["d"][0]["description"] == "nested [ok]"
    entries, rejects = parse_responses(df)
    assert rejects.count() >= 1


def test_template_and_overlay(spark):
    rows = [(100 - i, 1, 0.1 * i, 10.0 + i, ["A"]) for i in range(7)]
    sc = score_live(clusters(spark, rows))
    t = recommend_from_templates(sc, 5).orderBy("rank").collect()
    assert len(t) == 5 and all(r.mock for r in t)
    assert [r.description for r in t] == [x["description"] for x in TEMPLATES]
    top = [r.cluster_id for r in t]
    resp = ('```json\n[{"cluster_id": %d, "description": "m0"}, {"cluster_id": 999, "description": "p1", '
            '"patrol_time_window": "w"}]\n```' % top[0])
    out = recommend_with_responses(sc, spark.createDataFrame([(resp,)], "response string"), 5).orderBy("rank").collect()
    assert (out[0].description, out[0].patrol_time_window, out[0].mock) == ("m0", "", False)
    assert (out[1].description, out[1].patrol_time_window, out[1].mock) == ("p1", "w", False)
    assert out[2].mock and out[2].description == TEMPLATES[2]["description"]
    bad = recommend_with_responses(sc, spark.createDataFrame([("no json",)], "response string"), 5).collect()
    assert all(r.mock for r in bad)


@pytest.mark.parametrize("profile,score,tier", [
    ("live", 74.9999, "High"), ("live", 75.0, "Critical"), ("live", 49.9999, "Medium"), ("live", 50.0, "High"),
    ("live", 24.9999, "Low"), ("live", 25.0, "Medium"),
    ("batch", 74.9, "High"), ("batch", 75.0, "Critical"), ("batch", 54.9, "Medium"), ("batch", 55.0, "High"),
    ("batch", 34.9, "Low"), ("batch", 35.0, "Medium"),
])
def test_tier_cuts_both_sides(spark, profile, score, tier):
    from kerbside.operators.score import priority_tier
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(priority_tier(F.col("s"), profile)).first()[0] == tier


@pytest.mark.parametrize("profile,ratio,window", [
    ("live", 0.5, "Morning & Evening Rush Hours (7-9 AM, 5-8 PM)"), ("live", 0.4999, "Evening Rush Hours (5-8 PM)"),
    ("live", 0.3, "Evening Rush Hours (5-8 PM)"), ("live", 0.2999, "Business Hours (10 AM - 4 PM)"),
    ("batch", 0.5, "10 AM - 4 PM"), ("batch", 0.5001, "7-9 AM and 5-8 PM"),
])
def test_patrol_window_edges(spark, profile, ratio, window):
    from kerbside.operators.score import patrol_window
    df = spark.createDataFrame([(ratio,)], "r double")
    assert df.select(patrol_window(F.col("r"), profile)).first()[0] == window
