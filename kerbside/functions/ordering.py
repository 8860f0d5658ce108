"""Distributed global row index (0..n−1) in a declared order.

Range-partition on the order key, sort within partitions and tag every row
with ``monotonically_increasing_id`` (partition id in the high bits, position
in the low bits) in the same stage.  The tagged rows are checkpointed to the
cluster's checkpoint folder so both uses below read identical partitions;
per-partition row counts (one row per partition) give exclusive offsets.
No step sorts everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kerbside.session import ensure_checkpoint_dir

_LOW_BITS = 33


def global_index(df: DataFrame, order: list[Column], name: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """``df`` plus a long column ``name`` = 0-based position in ``order``.

    ``order`` must be a total order (end it with a unique key) for the index
    to be deterministic."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *order)
                .sortWithinPartitions(*order)
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    tagged = tagged.withColumns({
        "_pid": F.shiftright(F.col("_mid"), _LOW_BITS),
        "_pos": F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)),
    })
    # one row per partition: bounded by the partition count, safe to broadcast
    counts = tagged.groupBy("_pid").agg((F.max("_pos") + 1).alias("_cnt"))
    offsets = counts.select(
        "_pid",
        (F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    )
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_pos"))
                  .drop("_mid", "_pid", "_pos", "_off"))
