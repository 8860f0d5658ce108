"""Schemas of the record tables and missing-column tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source columns of one incident record (all text on input).
RAW_COLUMNS = (
    "id", "latitude", "longitude", "location", "vehicle_number", "vehicle_type", "description",
    "violation_type", "offence_code", "created_datetime", "closed_datetime", "modified_datetime",
    "device_id", "created_by_id", "center_code", "police_station", "data_sent_to_scita",
    "junction_name", "action_taken_timestamp", "data_sent_to_scita_timestamp",
    "updated_vehicle_number", "updated_vehicle_type", "validation_status", "validation_timestamp",
)

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

CLUSTER_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.IntegerType(), False),
    T.StructField("centroid_lat", T.DoubleType(), True),
    T.StructField("centroid_lon", T.DoubleType(), True),
    T.StructField("violation_count", T.LongType(), False),
    T.StructField("unique_vehicle_types", T.LongType(), False),
    T.StructField("dominant_violation_type", T.StringType(), True),
    T.StructField("peak_hour_ratio", T.DoubleType(), True),
    T.StructField("avg_resolution_minutes", T.DoubleType(), True),
    T.StructField("junctions_covered", T.ArrayType(T.StringType()), True),
    T.StructField("police_stations_involved", T.ArrayType(T.StringType()), True),
    T.StructField("first_seen", T.TimestampNTZType(), True),
    T.StructField("last_seen", T.TimestampNTZType(), True),
])


def ensure_columns(df: DataFrame, schema: T.StructType = RAW_SCHEMA, keep_extra: bool = True) -> DataFrame:
    """Add every column of ``schema`` that ``df`` lacks as a typed null, so
    operators can reference any known column.  Present columns are kept as
    they are; ``id`` is cast to long when present as text."""
    have = set(df.columns)
    cols = [F.col(c) for c in df.columns] if keep_extra else []
    for f in schema.fields:
        if f.name not in have:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif not keep_extra:
            cols.append(F.col(f.name))
    return df.select(*cols)


def with_alias_columns(df: DataFrame) -> DataFrame:
    """Coordinate column name variants: ``lat``/``lon`` are accepted for
    ``latitude``/``longitude``."""
    if "latitude" not in df.columns and "lat" in df.columns:
        df = df.withColumnRenamed("lat", "latitude")
    if "longitude" not in df.columns and "lon" in df.columns:
        df = df.withColumnRenamed("lon", "longitude")
    return df


def order_key(df: DataFrame):
    """The column that orders records in every "first seen" rule: ``seq`` (position in
    the input, see ``with_sequence``), or ``id`` of frames that have none."""
    return F.col("seq") if "seq" in df.columns else F.col("id")


def with_sequence(raw: DataFrame) -> DataFrame:
    """``raw`` plus ``seq``, the long that orders its records.  A frame that has one (a
    reader's file positions) keeps it; whole-number ids are their own order; other ids
    are ranked over the whole table, whole numbers first by value, then texts, then
    missing ids (a distributed sort; equal ids in the order of all their columns)."""
    if "seq" in raw.columns:
        return raw
    if "id" not in raw.columns:
        return raw.withColumn("seq", F.lit(None).cast("long"))
    text = F.nullif(F.col("id").cast("string"), F.lit(""))
    number = text.try_cast("long")
    if not isinstance(raw.schema["id"].dataType, T.StringType) or raw.filter(number.isNull() & text.isNotNull()).isEmpty():
        return raw.withColumn("seq", number)
    from kerbside.functions.ordering import global_index

    # maps cannot be ordered or hashed and do not count
    plain = [F.col(f"`{f.name}`") for f in raw.schema.fields if "map<" not in f.dataType.simpleString()]
    return global_index(raw, [number.asc_nulls_last(), text.asc_nulls_last(), F.xxhash64(*plain)], "seq")
