"""Temporal and categorical statistics over cleaned records.

Each statistic is one grouped aggregate (partial aggregation map-side, one
shuffle of at most #groups rows per task).  Fixed dimensions (24 hours, 7
days, 5 buckets) are tiny literal frames joined with a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kerbside.functions.numeric import COORD_SCALE, exact_mean, ratio_half_even, ratio_half_up
from kerbside.profiles import DAY_ORDER, JUNCTION_SENTINELS, PEAK_HOURS, Profile, get_profile
from kerbside.schema import order_key
from kerbside.session import materialize


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def hourly(df: DataFrame, profile: Profile | str = "live") -> DataFrame:
    """Violations per hour of day.  live: all 24 hours, zero-filled;
    batch: only hours that occur.  Columns ``hour``, ``count``; ascending."""
    p = get_profile(profile)
    counts = (df.filter(F.col("hour_of_day").isNotNull())
                .groupBy(F.col("hour_of_day").cast("int").alias("hour"))
                .agg(F.count(F.lit(1)).alias("count")))
    if p.name == "batch":
        return counts.orderBy("hour")
    hours = _spark(df).range(24).select(F.col("id").cast("int").alias("hour"))
    return (hours.join(F.broadcast(counts), "hour", "left")
                 .select("hour", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
                 .orderBy("hour"))


def day_of_week(df: DataFrame, profile: Profile | str = "live") -> DataFrame:
    """Violations per weekday name.  live: Monday..Sunday zero-filled, in
    calendar order (``day_index`` 0..6); batch: seen days only, count desc."""
    p = get_profile(profile)
    counts = (df.filter(F.col("day_of_week").isNotNull())
                .groupBy("day_of_week").agg(F.count(F.lit(1)).alias("count")))
    days = _spark(df).createDataFrame([(i, d) for i, d in enumerate(DAY_ORDER)], "day_index int, day_of_week string")
    if p.name == "batch":
        return (counts.join(F.broadcast(days), "day_of_week", "left")
                      .orderBy(F.desc("count"), "day_index")
                      .select("day_of_week", "count"))
    return (days.join(F.broadcast(counts), "day_of_week", "left")
                .select("day_index", "day_of_week", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
                .orderBy("day_index"))


def weekly_trend(df: DataFrame) -> DataFrame:
    """Violations per ISO week number (years merged), null weeks dropped."""
    return (df.filter(F.col("week_number").isNotNull())
              .groupBy(F.col("week_number").cast("int").alias("week"))
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy("week"))


def top_junctions(df: DataFrame, profile: Profile | str = "live", n: int | None = None,
                  keep_first_id: bool = False) -> DataFrame:
    """Busiest junctions.

    live: top 10 by count with mean latitude/longitude (``No Junction`` is a
    junction here); ties keep first appearance (smallest record id).
    batch: top 15 by count after dropping sentinel names, no coordinates.
    One aggregate gives count, means and first id together (no self-merge)."""
    p = get_profile(profile)
    base = df.filter(F.col("junction_name").isNotNull())
    if p.name == "batch":
        base = base.filter(~F.col("junction_name").isin(*[s for s in JUNCTION_SENTINELS if s]))
        n = n or 15
        g = base.groupBy("junction_name").agg(F.count(F.lit(1)).alias("count"), F.min(order_key(df)).alias("_first"))
        return g.orderBy(F.desc("count"), "_first").limit(n).select("junction_name", "count")
    n = n or 10
    g = base.groupBy("junction_name").agg(
        F.count(F.lit(1)).alias("count"),
        exact_mean(F.col("latitude"), COORD_SCALE).alias("lat"),
        exact_mean(F.col("longitude"), COORD_SCALE).alias("lon"),
        F.min(order_key(df)).alias("_first"),
    )
    extra = [F.col("_first").alias("first_id")] if keep_first_id else []
    return g.orderBy(F.desc("count"), "_first").limit(n).select("junction_name", "count", "lat", "lon", *extra)


def vehicle_mix(df: DataFrame, profile: Profile | str = "live", keep_first_id: bool = False) -> DataFrame:
    """Vehicle-type counts.  live: with percentage of all rows (null types
    included in the denominator, at least 1), 1 decimal; batch: top 8 and the
    key named ``type``.  Order: count desc, then first appearance."""
    p = get_profile(profile)
    g = df.groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("count"), F.min(order_key(df)).alias("_first"))
    if p.name == "batch":
        return (g.filter(F.col("vehicle_type").isNotNull()).orderBy(F.desc("count"), "_first").limit(8)
                 .select(F.col("vehicle_type").alias("type"), "count"))
    # the groups (a handful, the null one among them) add up to the total: no second scan
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return (g.withColumn("_total", total).filter(F.col("vehicle_type").isNotNull())
             .select("vehicle_type", "count",
                     ratio_half_even(F.col("count") * 100, F.col("_total"), 10).alias("percentage"), "_first")
             .orderBy(F.desc("count"), "_first")
             .withColumnRenamed("_first", "first_id")
             .drop(*([] if keep_first_id else ["first_id"])))


def violation_mix(df: DataFrame, profile: Profile | str = "live", keep_first_id: bool = False) -> DataFrame:
    """Violation-type counts, descending (batch: top 10)."""
    p = get_profile(profile)
    g = (df.filter(F.col("violation_type").isNotNull())
           .groupBy("violation_type")
           .agg(F.count(F.lit(1)).alias("count"), F.min(order_key(df)).alias("_first")))
    out = g.orderBy(F.desc("count"), "_first")
    if p.name == "batch":
        out = out.limit(10)
    extra = [F.col("_first").alias("first_id")] if keep_first_id else []
    return out.select("violation_type", "count", *extra)


def resolution_buckets(df: DataFrame, profile: Profile | str = "live") -> DataFrame:
    """Resolution-time histogram, always all 5 buckets.

    live: left-closed ``[lo, hi)`` on minutes ≥ 0, unbounded above.
    batch: right-closed ``(lo, hi]`` on 0 ≤ minutes ≤ 1440.
    Null resolutions are skipped.  One aggregate with conditional counts,
    unpivoted with ``stack``."""
    p = get_profile(profile)
    m = F.col("resolution_minutes")
    valid = m.isNotNull() & (m >= 0)
    if p.bucket_max is not None:
        valid = valid & (m <= p.bucket_max)
    aggs = []
    for i, (label, lo, hi) in enumerate(p.res_buckets):
        cond = valid
        if p.bucket_right_closed:
            if lo is not None:
                cond = cond & (m > lo)
            if hi is not None:
                cond = cond & (m <= hi)
        else:
            if lo is not None:
                cond = cond & (m >= lo)
            if hi is not None:
                cond = cond & (m < hi)
        aggs.append(F.count_if(cond).alias(f"b{i}"))
    wide = df.agg(*aggs)
    stack = "stack({n}, {args}) as (bucket_index, bucket, count)".format(
        n=len(p.res_buckets),
        args=", ".join(f"{i}, '{label}', b{i}" for i, (label, _, _) in enumerate(p.res_buckets)),
    )
    return wide.selectExpr(stack).select(F.col("bucket_index").cast("int"), "bucket", F.col("count").cast("long"))


def data_profile(df: DataFrame) -> DataFrame:
    """One-row data profile: rows, date range, distinct junctions and the five
    most common violation types (as ``type:count`` text, count desc)."""
    # one aggregate by (type) and in all: the few groups are written, the five most common read from them
    agg = materialize(df.groupingSets([["violation_type"], []], "violation_type").agg(
        F.count(F.lit(1)).alias("count"), F.min("created_datetime").alias("date_from"), F.max("created_datetime").alias("date_to"),
        F.when(F.grouping("violation_type") == 1, F.countDistinct("junction_name")).alias("unique_junctions"),
        F.min(order_key(df)).alias("_first"), F.grouping("violation_type").alias("_all")), "data_profile")
    head = agg.filter("_all = 1").select(F.col("count").alias("total_records"), "date_from", "date_to", "unique_junctions")
    top5 = (agg.filter("_all = 0 AND violation_type IS NOT NULL").orderBy(F.desc("count"), "_first").limit(5)
            .agg(F.collect_list(F.struct(F.col("count"), F.col("violation_type"))).alias("_t")))
    top5 = top5.select(F.array_join(F.transform(
        F.array_sort(F.col("_t"), lambda a, b: F.when(a["count"] > b["count"], -1).when(a["count"] < b["count"], 1)
                     .when(a["violation_type"] < b["violation_type"], -1).when(a["violation_type"] > b["violation_type"], 1)
                     .otherwise(0)),
        lambda x: F.concat(x["violation_type"], F.lit(":"), x["count"].cast("string"))), "|").alias("top_violation_types"))
    return head.crossJoin(top5)


def peak_kpi(df: DataFrame) -> DataFrame:
    """Total violations in peak hours (one row)."""
    return df.agg(
        F.count_if(F.col("hour_of_day").isin(*PEAK_HOURS)).alias("peak_violations"),
        F.count(F.lit(1)).alias("total_violations"),
    )


def top6_share(df: DataFrame) -> DataFrame:
    """Share (whole percent) of each of the six most common violation types
    within those six."""
    top = violation_mix(df, "live").limit(6)
    tot = top.agg(F.sum("count").alias("_sum"))
    return (top.crossJoin(F.broadcast(tot))
               .select("violation_type", "count",
                       ratio_half_up(F.col("count") * 100, F.col("_sum")).alias("share_pct")))


def _bucket_index(p: Profile):
    """Resolution bucket index 0..4 (null: skipped value)."""
    m = F.col("resolution_minutes")
    valid = m.isNotNull() & (m >= 0)
    if p.bucket_max is not None:
        valid = valid & (m <= p.bucket_max)
    expr = None
    for i, (_label, lo, hi) in enumerate(p.res_buckets):
        if p.bucket_right_closed:
            cond = (m > lo) if lo is not None else F.lit(True)
            cond = cond & ((m <= hi) if hi is not None else F.lit(True))
        else:
            cond = (m >= lo) if lo is not None else F.lit(True)
            cond = cond & ((m < hi) if hi is not None else F.lit(True))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return F.when(valid, expr)


_DIMS = ("hour", "day", "week", "vehicle", "violation", "junction", "bucket")


def bundle(df: DataFrame, profile: Profile | str = "live", keep_first_id: bool = False, totals: bool = False) -> dict[str, DataFrame]:
    """All temporal/categorical statistics from **one scan**: a single
    ``GROUPING SETS`` aggregate (one Expand, map-side partial aggregation, one
    shuffle of at most #groups rows per task) over hour, weekday, week,
    vehicle type, violation type, junction and resolution bucket, plus the
    grand total.  The aggregate is tiny (one row per distinct key) and is
    materialised once; each statistic is derived from it and equals the
    single-statistic functions above.  ``keep_first_id`` keeps the order key of first
    appearance, ``totals`` adds a one-row table of the record count and date range."""
    p = get_profile(profile)
    junction = F.col("junction_name")
    if p.name == "batch":
        junction = F.when(~junction.isin(*[s for s in JUNCTION_SENTINELS if s]), junction)
    base = df.select(
        F.col("hour_of_day").cast("int").alias("hour"), F.col("day_of_week").alias("day"),
        F.col("week_number").cast("int").alias("week"), F.col("vehicle_type").alias("vehicle"),
        F.col("violation_type").alias("violation"), junction.alias("junction"),
        _bucket_index(p).alias("bucket"), "latitude", "longitude", "created_datetime", order_key(df).alias("id"))
    sets = [[d] for d in _DIMS] + [[]]
    agg = (base.groupingSets(sets, *_DIMS)
               .agg(F.count(F.lit(1)).alias("count"), exact_mean(F.col("latitude"), COORD_SCALE).alias("lat"),
                    exact_mean(F.col("longitude"), COORD_SCALE).alias("lon"),
                    F.min("id").alias("first_id"), F.min("created_datetime").alias("date_from"), F.max("created_datetime").alias("date_to"),
                    *[F.grouping(d).alias(f"g_{d}") for d in _DIMS]))
    agg = materialize(agg, f"stats_bundle_{p.name}")

    def one(d):
        return agg.filter((F.col(f"g_{d}") == 0) & F.col(d).isNotNull())

    whole = agg.filter(sum(F.col(f"g_{d}") for d in _DIMS) == len(_DIMS))
    total = whole.select(F.col("count").alias("_total"))
    spark = df.sparkSession
    extra = ["first_id"] if keep_first_id else []
    out = {"totals": whole.select(F.col("count").alias("total_violations"), "date_from", "date_to")} if totals else {}
    hours = one("hour").select("hour", "count")
    if p.name == "batch":
        out["hourly"] = hours.orderBy("hour")
    else:
        out["hourly"] = (spark.range(24).select(F.col("id").cast("int").alias("hour"))
                              .join(F.broadcast(hours), "hour", "left")
                              .select("hour", F.coalesce("count", F.lit(0)).cast("long").alias("count")).orderBy("hour"))
    days = spark.createDataFrame([(i, d) for i, d in enumerate(DAY_ORDER)], "day_index int, day_of_week string")
    dcount = one("day").select(F.col("day").alias("day_of_week"), "count")
    if p.name == "batch":
        out["day_of_week"] = (dcount.join(F.broadcast(days), "day_of_week", "left")
                                    .orderBy(F.desc("count"), "day_index").select("day_of_week", "count"))
    else:
        out["day_of_week"] = (days.join(F.broadcast(dcount), "day_of_week", "left")
                                  .select("day_index", "day_of_week", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
                                  .orderBy("day_index"))
    out["weekly_trend"] = one("week").select("week", "count").orderBy("week")
    j = one("junction").orderBy(F.desc("count"), "first_id")
    out["top_junctions"] = (j.limit(15).select(F.col("junction").alias("junction_name"), "count") if p.name == "batch"
                            else j.limit(10).select(F.col("junction").alias("junction_name"), "count", "lat", "lon", *extra))
    v = one("vehicle").orderBy(F.desc("count"), "first_id")
    if p.name == "batch":
        out["vehicle_types"] = v.limit(8).select(F.col("vehicle").alias("type"), "count")
    else:
        out["vehicle_types"] = (one("vehicle").crossJoin(F.broadcast(total)).orderBy(F.desc("count"), "first_id")
                                 .select(F.col("vehicle").alias("vehicle_type"), "count",
                                         ratio_half_even(F.col("count") * 100, F.greatest(F.col("_total"), F.lit(1)), 10)
                                         .alias("percentage"), *extra))
    vio = one("violation").orderBy(F.desc("count"), "first_id")
    out["violation_types"] = (vio.limit(10) if p.name == "batch" else vio).select(F.col("violation").alias("violation_type"), "count", *(extra if p.name == "live" else []))
    labels = spark.createDataFrame([(i, lbl) for i, (lbl, _, _) in enumerate(p.res_buckets)], "bucket_index int, bucket string")
    bcount = one("bucket").select(F.col("bucket").alias("bucket_index"), "count")
    out["resolution_buckets"] = (labels.join(F.broadcast(bcount), "bucket_index", "left")
                                       .select("bucket_index", "bucket", F.coalesce("count", F.lit(0)).cast("long").alias("count")))
    return out
