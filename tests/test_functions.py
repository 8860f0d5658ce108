import datetime as dt

import pytest
from pyspark.sql import functions as F

from kerbside.functions.numeric import ratio_half_even, ratio_half_up
from kerbside.functions.text import finite_or_null, junction_label, normalize_violation_type, title_case
from kerbside.functions.timefn import minutes_between, parse_local_wall_clock, parse_utc
from kerbside.profiles import BATCH, LIVE


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("ROAD-CROSSING 5TH", "Road-Crossing 5Th"),
    ("double parking", "Double Parking"),
    ("they're here", "They'Re Here"),
    ("", ""),
])
def test_title_case_matches_python(spark, text, expected):
    assert expected == text.title()
    assert one(spark, title_case(F.col("s")), text) == expected


@pytest.mark.parametrize("raw,live,batch", [
    ('["WRONG PARKING","PARKING NEAR ROAD CROSSING"]', "Wrong Parking", "Wrong Parking"),
    ("[]", "[]", "[]"),
    ("['FOOTPATH PARKING','X']", "Footpath Parking", "['Footpath Parking','X']"),
    (None, "Unknown", "Unknown"),
    ("NULL", "Null", "Unknown"),
    ("nan", "Nan", "Unknown"),
    ("no parking", "No Parking", "No Parking"),
    ('["A"] junk', 'A"] Junk', "A"),
    ("   ", "Unknown", ""),
])
def test_violation_type_normalisation(spark, raw, live, batch):
    assert one(spark, normalize_violation_type(F.col("s"), LIVE), raw) == live
    assert one(spark, normalize_violation_type(F.col("s"), BATCH), raw) == batch


def test_timestamp_wall_clock_and_utc(spark):
    s = "2023-11-20 00:28:46+05:30"
    assert one(spark, parse_local_wall_clock(F.col("s")), s) == dt.datetime(2023, 11, 20, 0, 28, 46)
    assert one(spark, parse_utc(F.col("s")), s) == dt.datetime(2023, 11, 19, 18, 58, 46)
    assert one(spark, parse_utc(F.col("s")), "2023-11-20 00:28:46+00") == dt.datetime(2023, 11, 20, 0, 28, 46)
    assert one(spark, parse_utc(F.col("s")), "2023-11-20 00:28:46-0100") == dt.datetime(2023, 11, 20, 1, 28, 46)
    assert one(spark, parse_utc(F.col("s")), "2023-11-20") == dt.datetime(2023, 11, 20, 0, 0, 0)
    assert one(spark, parse_local_wall_clock(F.col("s")), "NULL") is None


def test_minutes_between_is_microsecond_exact(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 1, 0, 0, 30, 500000))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(minutes_between(F.col("a"), F.col("b"))).first()[0] == pytest.approx(30.5 / 60, abs=1e-12)


def test_finite_or_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(finite_or_null(F.col("x"))).collect()] == [None, None, None, 1.5, None]


def test_junction_label(spark):
    assert one(spark, junction_label(F.col("s")), "BTP012 - Junction 12, Ward 0") == "Junction 12"
    assert one(spark, junction_label(F.col("s")), "MG Road") == "MG Road"


def test_exact_ratio_rounding(spark):
    df = spark.createDataFrame([(1, 400), (3, 2000), (2, 3), (1, 8)], "n long, d long")
    got = [r[0] for r in df.select(ratio_half_even(F.col("n") * 100, F.col("d"), 10)).collect()]
    assert got == [0.2, 0.2, 66.7, 12.5]
    got = [r[0] for r in df.select(ratio_half_up(F.col("n") * 100, F.col("d"))).collect()]
    assert got == [0, 0, 67, 13]


def test_declared_extra_formats(spark):
    c = parse_local_wall_clock(F.col("s"), ("dd/MM/yyyy HH:mm",))
    assert one(spark, c, "20/11/2023 00:28") == dt.datetime(2023, 11, 20, 0, 28)
    assert one(spark, c, "2023-11-20 00:28:46") == dt.datetime(2023, 11, 20, 0, 28, 46)
    assert one(spark, parse_local_wall_clock(F.col("s")), "20/11/2023 00:28") == dt.datetime(2023, 11, 20, 0, 28)
    assert one(spark, parse_local_wall_clock(F.col("s"), ("yyyy~MM~dd",)), "2023~11~20") == dt.datetime(2023, 11, 20)
    assert one(spark, parse_local_wall_clock(F.col("s")), "2023~11~20") is None
