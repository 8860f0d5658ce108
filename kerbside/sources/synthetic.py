"""Synthetic incident records for demos and tests: uniform picks from fixed
lists, coordinates within ±0.05° of a centre, times in the 90 days before
``as_of``, resolution 15–360 minutes.  Seeded and generated in parallel from
``spark.range`` (the original generator is unseeded)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: demo lists and centre
VIOLATION_TYPES = ["No Parking", "Wrong Side Parking", "Blocking Driveway", "Double Parking", "Expired Meter",
                   "Handicap Zone Violation"]
VEHICLE_TYPES = ["Car", "Motorcycle", "Truck", "Auto", "Bus", "Van"]
OFFENCE_CODES = ["OFF001", "OFF002", "OFF003", "OFF004", "OFF005", "OFF006"]
JUNCTION_NAMES = ["Silk Board Junction", "KR Circle", "MG Road Junction", "Hebbal Flyover", "Electronic City Junction",
                  "Koramangala 5th Block", "Whitefield Main Road", "Bannerghatta Road Junction", "Jayanagar 4th Block",
                  "HSR Layout Sector 1"]
POLICE_STATIONS = ["Koramangala PS", "Indiranagar PS", "MG Road PS", "Whitefield PS", "HSR Layout PS"]
BASE_LAT = 12.9716
BASE_LON = 77.5946


def _pick(values: list[str], seed: int) -> F.Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))


def synthetic_records(spark: SparkSession, n: int = 500, seed: int = 7,
                      as_of: dt.datetime | None = None) -> DataFrame:
    """``n`` raw-like records (typed, as after loading) with ids 1..n."""
    as_of = as_of or dt.datetime(2024, 4, 1)
    start = as_of - dt.timedelta(days=90)
    window = int((as_of - start).total_seconds())
    junction = _pick(JUNCTION_NAMES, seed + 1)
    created = F.timestamp_add("SECOND", F.floor(F.rand(seed + 2) * (window + 1)).cast("long"),
                              F.lit(start).cast("timestamp_ntz"))
    closed = F.timestamp_add("SECOND", (F.floor(F.rand(seed + 3) * 346) + 15).cast("long") * 60, F.col("created_datetime"))
    plate = F.format_string("KA-%02d-%s%s-%d", (F.floor(F.rand(seed + 4) * 99) + 1).cast("int"),
                            F.char((F.floor(F.rand(seed + 5) * 26) + 65).cast("int")),
                            F.char((F.floor(F.rand(seed + 6) * 26) + 65).cast("int")),
                            (F.floor(F.rand(seed + 7) * 9000) + 1000).cast("int"))
    df = (spark.range(1, n + 1)
               .select(F.col("id"),
                       (F.lit(BASE_LAT) + (F.rand(seed + 8) * 0.1 - 0.05)).alias("latitude"),
                       (F.lit(BASE_LON) + (F.rand(seed + 9) * 0.1 - 0.05)).alias("longitude"),
                       junction.alias("junction_name"),
                       plate.alias("vehicle_number"),
                       _pick(VEHICLE_TYPES, seed + 10).alias("vehicle_type"),
                       _pick(VIOLATION_TYPES, seed + 11).alias("violation_type"),
                       _pick(OFFENCE_CODES, seed + 12).alias("offence_code"),
                       created.alias("created_datetime"),
                       _pick(POLICE_STATIONS, seed + 13).alias("police_station"),
                       F.lit("VALID").alias("validation_status"),
                       F.lit("").alias("description")))
    return df.withColumn("closed_datetime", closed).withColumn("modified_datetime", F.col("closed_datetime")) \
             .withColumn("location", F.col("junction_name"))
