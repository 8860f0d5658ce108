"""Result tables for dashboards, GeoJSON, question context and reports.

All are small aggregates over the published tables; multi-item outputs are
row-per-item DataFrames (written line by line), never one collected value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kerbside.functions.text import finite_columns
from kerbside.functions.numeric import MICROS_PER_MINUTE, exact_mean
from kerbside.profiles import DAY_ORDER, Profile, get_profile

JSON_OPTS = {"ignoreNullFields": "false"}


def ts_text(c: Column) -> Column:
    """Timestamp text as ``YYYY-MM-DD hh:mm:ss[.ffffff]`` (fraction only when
    non-zero), the display form used in every output."""
    frac = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), F.lit(None).cast("string")).when(
        frac == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def dashboard(records: DataFrame, scored: DataFrame, profile: Profile | str = "live",
              as_of: Column | None = None) -> DataFrame:
    """One row: total records, cluster count, Critical clusters, mean
    resolution (live: every non-null value, negatives included; batch: values
    in 0..10000) rounded to 1 place, and (live) the date range."""
    p = get_profile(profile)
    res = F.col("resolution_minutes")
    if p.name == "batch":
        res = F.when((res >= 0) & (res <= 10000), res)
    rec = records.agg(
        F.count(F.lit(1)).alias("total_violations"),
        F.coalesce(F.bround(exact_mean(res, MICROS_PER_MINUTE), 1), F.lit(0.0)).alias("avg_resolution_minutes"),
        F.min("created_datetime").alias("_from"), F.max("created_datetime").alias("_to"))
    cl = scored.agg(F.count(F.lit(1)).alias("active_clusters"),
                    F.count_if(F.col("priority_tier") == "Critical").alias("critical_zones"))
    cols = [F.col("total_violations"), F.col("active_clusters"), F.col("critical_zones"), F.col("avg_resolution_minutes")]
    if as_of is not None:
        cols.append(as_of.alias("last_updated"))
    if p.name == "live":
        cols.append(F.struct(F.coalesce(ts_text(F.col("_from")), F.lit("")).alias("from"),
                             F.coalesce(ts_text(F.col("_to")), F.lit("")).alias("to")).alias("date_range"))
    return rec.crossJoin(cl).select(*cols)


def ingest_summary(labeled: DataFrame, scored: DataFrame) -> DataFrame:
    """Upload response: records processed, clusters found, critical zones."""
    rec = labeled.agg(F.count(F.lit(1)).alias("records_processed"))
    cl = scored.agg(F.count(F.lit(1)).alias("clusters_found"),
                    F.count_if(F.col("priority_tier") == "Critical").alias("critical_zones"))
    return rec.crossJoin(cl).select(F.lit("success").alias("status"), "records_processed", "clusters_found", "critical_zones")


def geojson_features(scored: DataFrame) -> DataFrame:
    """One GeoJSON Feature per cluster (``cluster_id``, ``feature`` text):
    Point at ``[lon, lat]`` with 13 properties.  Written one feature per line
    (GeoJSON text sequence), so no step holds the whole collection."""
    scored = finite_columns(scored)
    props = F.struct(
        F.col("cluster_id"), F.col("violation_count"),
        F.coalesce(F.col("dominant_violation_type"), F.lit("")).alias("dominant_violation_type"),
        F.col("peak_hour_ratio"), F.col("avg_resolution_minutes"), F.col("impact_score"),
        F.coalesce(F.col("priority_tier"), F.lit("")).alias("priority_tier"),
        F.coalesce(F.col("priority_color"), F.lit("")).alias("priority_color"),
        F.coalesce(F.col("recommended_enforcement_time"), F.lit("")).alias("recommended_enforcement_time"),
        F.col("junctions_covered"), F.col("police_stations_involved"),
        ts_text(F.col("first_seen")).alias("first_seen"), ts_text(F.col("last_seen")).alias("last_seen"),
    )
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(F.col("centroid_lon"), F.col("centroid_lat")).alias("coordinates")).alias("geometry"),
        props.alias("properties"),
    )
    return scored.select("cluster_id", F.to_json(feat, JSON_OPTS).alias("feature"))


def _totals(labeled: DataFrame, totals: DataFrame | None) -> DataFrame:
    """Record count and date range: of the statistics bundle where it is given, else one scan."""
    if totals is not None:
        return totals
    return labeled.agg(F.count(F.lit(1)).alias("total_violations"), F.min("created_datetime").alias("date_from"), F.max("created_datetime").alias("date_to"))


def _ranked_text(df: DataFrame, order: list[Column], item: Column, n: int | None, name: str) -> DataFrame:
    """First ``n`` items of a small ranked table as one ``|``-joined text.
    With ``n`` the window runs after the top-k; without ``n`` the input is a
    fixed dimension (24 hours, 7 days, 5 buckets)."""
    d = df.orderBy(*order)
    if n is not None:
        d = d.limit(n)
    d = d.withColumn("_o", F.row_number().over(Window.orderBy(*order)))
    arr = F.array_sort(F.collect_list(F.struct(F.col("_o"), item.alias("_v"))))
    return d.agg(F.array_join(F.transform(arr, lambda x: x["_v"]), "|").alias(name))


def insight_context(labeled: DataFrame, clusters: DataFrame, hourly: DataFrame, dow: DataFrame,
                    junctions: DataFrame, vehicles: DataFrame, violations: DataFrame,
                    buckets: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """One row of context for a question about the data: totals, date range,
    the first five clusters (violation count order), the five busiest hours,
    busiest hour and weekday (ties: calendar order), the first 10 junctions and
    6 vehicle/violation types (count order, ties by first appearance via the
    ``first_id`` column) and the resolution histogram.  Every part is a small
    aggregate joined to a one-row result."""
    base = _totals(labeled, totals).select("total_violations", ts_text(F.col("date_from")).alias("date_from"), ts_text(F.col("date_to")).alias("date_to"))
    by_count_hour = [F.desc("count"), F.asc("hour")]
    parts = [
        _ranked_text(clusters, [F.desc("violation_count"), F.asc("cluster_id")],
                     F.col("cluster_id").cast("string"), 5, "top_cluster_ids"),
        _ranked_text(hourly, by_count_hour, F.format_string("%s=%d", hour_label(F.col("hour")), F.col("count")),
                     5, "top_5_hours"),
        _ranked_text(hourly, by_count_hour,
                     F.format_string("%d:00 with %d violations", F.col("hour"), F.col("count")), 1, "peak_hour"),
        _ranked_text(dow, [F.desc("count"), F.asc("day_index")],
                     F.format_string("%s with %d violations", F.col("day_of_week"), F.col("count")), 1, "peak_day"),
        _ranked_text(dow, [F.asc("day_index")], F.format_string("%s=%d", F.col("day_of_week"), F.col("count")),
                     None, "day_of_week_breakdown"),
        _ranked_text(junctions, [F.desc("count"), F.asc("first_id")],
                     F.format_string("%s=%d", F.col("junction_name"), F.col("count")), 10, "top_junctions"),
        _ranked_text(vehicles, [F.desc("count"), F.asc("first_id")],
                     F.format_string("%s=%d", F.col("vehicle_type"), F.col("count")), 6, "vehicle_types"),
        _ranked_text(violations, [F.desc("count"), F.asc("first_id")],
                     F.format_string("%s=%d", F.col("violation_type"), F.col("count")), 6, "violation_types"),
        _ranked_text(buckets, [F.asc("bucket_index")], F.format_string("%s=%d", F.col("bucket"), F.col("count")),
                     None, "resolution_time_distribution"),
    ]
    out = base
    for part in parts:
        out = out.crossJoin(part)
    return out


def hour_label(hour: Column) -> Column:
    return F.format_string("%d:00-%d:59", hour, hour)


def _top_list(df: DataFrame, order: list[Column], n: int | None, item: Column) -> DataFrame:
    """First ``n`` rows (or a fixed dimension) as one ordered array column."""
    d = df.orderBy(*order)
    if n is not None:
        d = d.limit(n)
    d = d.withColumn("_o", F.row_number().over(Window.orderBy(*order)))
    return d.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_o"), item.alias("_v")))),
                             lambda x: x["_v"]).alias("_list"))


def insight_context_json(labeled: DataFrame, clusters: DataFrame, hourly: DataFrame, dow: DataFrame,
                         junctions: DataFrame, vehicles: DataFrame, violations: DataFrame,
                         buckets: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """The question context as one JSON document (``context`` column):
    totals, date range, the first five clusters (8 fields each), the five
    busiest hours, busiest hour and day, the weekday breakdown, the first 10
    junctions, 6 vehicle and 6 violation types and the resolution histogram.
    Each list is a top-k or a fixed dimension, so the document is bounded."""
    base = _totals(labeled, totals).select("total_violations", F.struct(ts_text(F.col("date_from")).alias("from"), ts_text(F.col("date_to")).alias("to")).alias("date_range"))
    cl_item = F.struct("cluster_id", "violation_count",
                       F.coalesce("dominant_violation_type", F.lit("")).alias("dominant_violation_type"),
                       "impact_score", "priority_tier", "avg_resolution_minutes", "peak_hour_ratio",
                       F.coalesce("junctions_covered", F.array().cast("array<string>")).alias("junctions_covered"))
    parts = {
        "top_clusters": _top_list(clusters, [F.desc("violation_count"), F.asc("cluster_id")], 5, cl_item),
        "top_5_hours": _top_list(hourly, [F.desc("count"), F.asc("hour")], 5,
                                 F.struct(hour_label(F.col("hour")).alias("hour"), F.col("count").alias("violations"))),
        "peak_hour": _top_list(hourly, [F.desc("count"), F.asc("hour")], 1,
                               F.format_string("%d:00 with %d violations", F.col("hour"), F.col("count"))),
        "peak_day": _top_list(dow, [F.desc("count"), F.asc("day_index")], 1,
                              F.format_string("%s with %d violations", F.col("day_of_week"), F.col("count"))),
        "day_of_week_breakdown": _top_list(dow, [F.asc("day_index")], None, F.struct("day_of_week", "count")),
        "top_junctions": _top_list(junctions, [F.desc("count"), F.asc("first_id")], 10,
                                   F.struct("junction_name", "count", "lat", "lon")),
        "vehicle_types": _top_list(vehicles, [F.desc("count"), F.asc("first_id")], 6,
                                   F.struct("vehicle_type", "count", "percentage")),
        "violation_types": _top_list(violations, [F.desc("count"), F.asc("first_id")], 6,
                                     F.struct("violation_type", "count")),
        "resolution_time_distribution": _top_list(buckets, [F.asc("bucket_index")], None, F.struct("bucket", "count")),
    }
    out = base
    for name, part in parts.items():
        out = out.crossJoin(part.withColumnRenamed("_list", name))
    ctx = F.struct(
        "total_violations", "date_range", "top_clusters", "top_5_hours",
        F.get(F.col("peak_hour"), 0).alias("peak_hour"), F.get(F.col("peak_day"), 0).alias("peak_day"),
        F.map_from_entries(F.col("day_of_week_breakdown")).alias("day_of_week_breakdown"),
        "top_junctions", "vehicle_types", "violation_types",
        F.map_from_entries(F.col("resolution_time_distribution")).alias("resolution_time_distribution"),
    )
    return finite_columns(out.select(ctx.alias("ctx"))).select(F.to_json("ctx", JSON_OPTS).alias("context"))
