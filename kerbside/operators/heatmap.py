"""Heat-map cells, thinned heat points and the repeatable map sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.ordering import global_index
from kerbside.schema import order_key, with_alias_columns

HEAT_POINT_CAP = 5000     # fixed value: most heat points returned
MAP_SAMPLE_SIZE = 3000    # fixed value: map sample size
MAP_SAMPLE_SEED = 42      # fixed value: map sample seed


def quantise(c, places: int = 4):
    """Round half-to-even on the scaled binary value (numpy ``round``)."""
    scale = float(10 ** places)
    return F.rint(c * scale) / scale


def heat_cells(df: DataFrame) -> DataFrame:
    """Count of records per coordinate cell (4-decimal rounding) and
    ``weight = count / max count``.  Map-side partial counts, one shuffle on the
    cell; the maximum is a one-row aggregate joined by broadcast."""
    df = with_alias_columns(df)
    cells = (df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
               .groupBy(quantise(F.col("latitude")).alias("lat"), quantise(F.col("longitude")).alias("lon"))
               .agg(F.count(F.lit(1)).alias("count")))
    mx = cells.agg(F.greatest(F.max("count"), F.lit(1)).alias("_max"))
    return (cells.crossJoin(F.broadcast(mx))
                 .select("lat", "lon", "count", (F.col("count") / F.col("_max")).alias("weight")))


def heat_points(df: DataFrame, cap: int = HEAT_POINT_CAP) -> DataFrame:
    """Heat cells in count-descending order (ties: lat, lon), thinned to at
    most ``cap`` points by keeping positions ``int(i·n/cap)``, i < cap.

    The position index is global but distributed (see ``global_index``); the
    ``cap`` wanted positions are a ``cap``-row frame joined by broadcast."""
    cells = heat_cells(df)
    indexed = global_index(cells, [F.desc("count"), F.asc("lat"), F.asc("lon")], "position")
    n = indexed.agg(F.count(F.lit(1)).alias("_n"))
    spark = df.sparkSession
    wanted = (spark.range(cap).crossJoin(F.broadcast(n))
                   .select(F.when(F.col("_n") > cap,
                                  F.floor(F.col("id") * (F.col("_n") / F.lit(float(cap))))).otherwise(F.col("id"))
                           .cast("long").alias("position"))
                   .distinct())
    return (indexed.join(F.broadcast(wanted), "position")
                   .select("position", "lat", "lon", "count", "weight"))


_P = 2147483647  # fixed value: the prime 2^31 - 1 of the sample hash


def sample_hash(id_col, seed: int):
    """Seeded pseudo-random key of an integer id from exact long arithmetic
    (an LCG step, a squaring step and a mix modulo 2^31−1; every product stays
    below 2^63), so any engine computes the same key and the sample does not
    depend on partitioning."""
    x = F.pmod(id_col.cast("long"), F.lit(_P))
    h1 = F.pmod(x * F.lit(1103515245) + F.lit(12345), F.lit(_P))
    h2 = F.pmod(h1 * h1, F.lit(_P))
    return F.pmod(h2 * F.lit(48271) + h1 * F.lit(16807) + F.lit(seed), F.lit(_P))


def round_decimal(c, places: int):
    """Half-to-even rounding of the value's 7-decimal text (engine-independent)."""
    return F.bround(c.cast("decimal(18,7)"), places).cast("double")


def map_sample(df: DataFrame, n: int = MAP_SAMPLE_SIZE, seed: int = MAP_SAMPLE_SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` records, chosen by a seeded hash of their order key —
    the same rows under any partitioning.  Top-k per partition, then merge."""
    pick = df.orderBy(sample_hash(order_key(df), seed), order_key(df)).limit(n)
    j = F.col("junction_name")
    return pick.select(
        round_decimal(F.col("latitude"), 6).alias("latitude"),
        round_decimal(F.col("longitude"), 6).alias("longitude"),
        F.col("violation_type"),
        F.col("hour_of_day").alias("hour"),
        F.when(j.isNull() | (j == "No Junction"), F.lit("")).otherwise(j).alias("junction_name"),
    )
