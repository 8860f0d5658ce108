from kerbside.sources.fixture import load_violations_raw, violations_from_events


def test_events_are_spread_before_they_become_records(spark):
    raw = load_violations_raw(spark, "/root/testdata/sf0.001", 3)
    text = raw._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 3" in text and not text.lstrip().startswith("Repartition")
    whole = violations_from_events(spark, spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    assert raw.exceptAll(whole).isEmpty() and whole.exceptAll(raw).isEmpty()
