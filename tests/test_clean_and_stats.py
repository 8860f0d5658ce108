from pyspark.sql import functions as F

from kerbside.operators.clean import clean
from kerbside.operators import timestats as ts


def raw(spark, rows):
    cols = "id long, latitude string, longitude string, validation_status string, created_datetime string, closed_datetime string, violation_type string, vehicle_type string, junction_name string"
    return spark.createDataFrame(rows, cols)


def test_status_filters(spark):
    rows = [(1, "12.9", "77.5", None, "2024-01-01 08:00:00", None, "x", "CAR", "J"),
            (2, "12.9", "77.5", "approved", "2024-01-01 08:00:00", None, "x", "CAR", "J"),
            (3, "12.9", "77.5", "rejected", "2024-01-01 08:00:00", None, "x", "CAR", "J"),
            (4, "12.9", "77.5", "INVALID", "2024-01-01 08:00:00", None, "x", "CAR", "J"),
            (5, "12.9", "77.5", "Valid", "2024-01-01 08:00:00", None, "x", "CAR", "J")]
    live = sorted(r.id for r in clean(raw(spark, rows), "live").collect())
    batch = sorted(r.id for r in clean(raw(spark, rows), "batch").collect())
    assert live == [1, 2, 3, 5]
    assert batch == [2, 5]


def test_coordinate_filter_and_nan(spark):
    rows = [(1, "0", "77.5", "VALID", None, None, None, None, None),
            (2, None, "77.5", "VALID", None, None, None, None, None),
            (3, "abc", "77.5", "VALID", None, None, None, None, None),
            (4, "nan", "77.5", "VALID", None, None, None, None, None),
            (5, "12.9", "", "VALID", None, None, None, None, None),
            (6, "12.9", "77.5", "VALID", None, None, None, None, None)]
    assert [r.id for r in clean(raw(spark, rows), "live").collect()] == [6]


def test_null_created_time(spark):
    rows = [(1, "12.9", "77.5", "VALID", None, None, "x", "CAR", "J")]
    live = clean(raw(spark, rows), "live").collect()
    assert len(live) == 1 and live[0].is_peak_hour is False and live[0].hour_of_day is None
    assert clean(raw(spark, rows), "batch").count() == 0


def test_derived_columns(spark):
    rows = [(1, "12.9", "77.5", "VALID", "2024-12-30 17:10:00+05:30", "2024-12-30 17:40:30+05:30", '["NO PARKING"]', "CAR", "J")]
    r = clean(raw(spark, rows), "live").first()
    assert (r.hour_of_day, r.day_of_week, r.week_number, r.is_peak_hour) == (17, "Monday", 1, True)
    assert abs(r.resolution_minutes - 30.5) < 1e-12
    assert r.violation_type == "No Parking"
    b = clean(raw(spark, rows), "batch").first()
    assert (b.hour_of_day, b.is_peak_hour) == (11, False)


def _minutes(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, resolution_minutes double")


def test_resolution_bucket_edges(spark):
    df = _minutes(spark, [30.0, 60.0, 120.0, 240.0, 360.0, 1440.0, 1441.0, -1.0, None])
    live = [r["count"] for r in ts.resolution_buckets(df, "live").orderBy("bucket_index").collect()]
    batch = [r["count"] for r in ts.resolution_buckets(df, "batch").orderBy("bucket_index").collect()]
    assert live == [0, 1, 1, 2, 3]
    assert batch == [1, 1, 1, 1, 2]


def test_hourly_zero_fill_and_days(spark):
    df = spark.createDataFrame([(1, 3, "Tuesday"), (2, 3, "Tuesday"), (3, None, None)],
                               "id long, hour_of_day int, day_of_week string")
    h = {r.hour: r["count"] for r in ts.hourly(df, "live").collect()}
    assert len(h) == 24 and h[3] == 2 and sum(h.values()) == 2
    assert [r.hour for r in ts.hourly(df, "batch").collect()] == [3]
    d = ts.day_of_week(df, "live").collect()
    assert [r.day_of_week for r in d][:2] == ["Monday", "Tuesday"] and d[1]["count"] == 2


def test_vehicle_percentage_counts_null_rows(spark):
    df = spark.createDataFrame([(1, "CAR"), (2, "CAR"), (3, None), (4, "BUS")], "id long, vehicle_type string")
    got = {r.vehicle_type: r.percentage for r in ts.vehicle_mix(df, "live").collect()}
    assert got == {"CAR": 50.0, "BUS": 25.0}


def test_top_junctions_tie_keeps_first_appearance(spark):
    df = spark.createDataFrame([(i, j, 12.9, 77.5) for i, j in [(5, "B"), (1, "A"), (2, "C"), (3, "C"), (4, "A"), (6, "B")]],
                               "id long, junction_name string, latitude double, longitude double")
    assert [r.junction_name for r in ts.top_junctions(df, "live", n=2).collect()] == ["A", "C"]


def test_bundle_equals_single_statistics(spark):
    from kerbside.plans.inputs import labeled
    for prof in ("live", "batch"):
        lab = labeled(spark, "/root/testdata/sf0.001", prof)
        b = ts.bundle(lab, prof)
        single = {
            "hourly": ts.hourly(lab, prof), "day_of_week": ts.day_of_week(lab, prof),
            "weekly_trend": ts.weekly_trend(lab), "top_junctions": ts.top_junctions(lab, prof),
            "vehicle_types": ts.vehicle_mix(lab, prof), "violation_types": ts.violation_mix(lab, prof),
            "resolution_buckets": ts.resolution_buckets(lab, prof),
        }
        for name, df in single.items():
            def rows(d):
                return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
            assert b[name].columns == df.columns, (prof, name)
            assert rows(b[name]) == rows(df), (prof, name)
