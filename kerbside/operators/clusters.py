"""Clustering wrapper and per-cluster summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.numeric import COORD_SCALE, MICROS_PER_MINUTE, exact_sum, mean_of_parts, ratio
from kerbside.operators.dbscan import dbscan
from kerbside.profiles import JUNCTION_SENTINELS, SENTINEL_TEXT, Profile, get_profile
from kerbside.schema import CLUSTER_SCHEMA, order_key


def label_points(df: DataFrame, profile: Profile | str = "live") -> DataFrame:
    """Cleaned records + ``cluster_label`` using the profile's eps/min_samples."""
    p = get_profile(profile)
    return dbscan(df, p.eps_deg, p.min_samples, id_col="seq" if "seq" in df.columns else "id")


def cluster_summary(labeled: DataFrame, profile: Profile | str = "live") -> DataFrame:
    """One row per cluster (noise dropped), ``violation_count`` descending.

    live:  vehicle types and junction/station sets ignore sentinel text; mean
           resolution over finite values ≥ 0; full sorted sets.
    batch: sentinel junction names dropped, first 6 in sorted order; first 4
           stations in order of appearance; mean resolution on 0..10000.

    One scan: records are reduced to a cube over (cluster, violation type, vehicle type,
    junction, station) with sums, counts and first keys (map-side partial
    aggregates, no sets and no distinct counts over records); the cube is written
    once, and counts, sets, the dominant type (ties → first seen) and, in batch, the
    first-appearance order of stations are derived from it.  Centroids and mean
    resolution are exact means (order-independent, see ``exact_mean``), so a summary
    does not change with partitioning."""
    from kerbside.session import materialize

    p = get_profile(profile)
    live = p.name == "live"
    df = labeled.filter(F.col("cluster_label") >= 0)

    def clean_text(c):
        col = F.col(c)
        return F.when(col.isNotNull() & ~col.isin(*SENTINEL_TEXT), col) if live else col

    res = F.col("resolution_minutes")
    res_ok = res.isNotNull() & ~F.isnan(res) & (F.abs(res) != float("inf")) & (res >= p.res_lo)
    if p.res_hi is not None:
        res_ok = res_ok & (res <= p.res_hi)
    junction = F.col("junction_name")
    if p.summary_junction_filter:
        junction = F.when(~junction.isin(*JUNCTION_SENTINELS), junction)
    elif live:
        junction = clean_text("junction_name")
    vt, station = F.col("violation_type"), F.col("police_station")
    cube = df.groupBy(
        "cluster_label", (F.when(vt.isNotNull() & ~vt.isin(*SENTINEL_TEXT), vt) if live else vt).alias("_vt"), clean_text("vehicle_type").alias("_vehicle"),
        junction.alias("_junction"), (station if p.station_cap else clean_text("police_station")).alias("_st"),
    ).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_peak_hour")).alias("peak"), F.min(order_key(df)).alias("first_id"),
        F.min("created_datetime").alias("first_seen"), F.max("created_datetime").alias("last_seen"),
        *[part for name, c, scale in (("lat", F.col("latitude"), COORD_SCALE), ("lon", F.col("longitude"), COORD_SCALE), ("res", F.when(res_ok, res), MICROS_PER_MINUTE))
          for part in (exact_sum(c, scale).alias(f"{name}_sum"), F.count(c).alias(f"{name}_n"))])
    cube = materialize(cube, f"cluster_cube_{p.name}")

    def mean(name: str, scale: float):
        return mean_of_parts(F.sum(f"{name}_sum"), F.sum(f"{name}_n"), scale)

    junctions = F.array_sort(F.collect_set("_junction"))
    main = cube.groupBy("cluster_label").agg(
        mean("lat", COORD_SCALE).alias("centroid_lat"), mean("lon", COORD_SCALE).alias("centroid_lon"), F.sum("n").alias("violation_count"),
        F.size(F.collect_set("_vehicle")).cast("long").alias("unique_vehicle_types"), ratio(F.sum("peak"), F.sum("n")).alias("peak_hour_ratio"),
        F.coalesce(mean("res", MICROS_PER_MINUTE), F.lit(0.0)).alias("avg_resolution_minutes"),
        (F.slice(junctions, 1, p.junction_cap) if p.junction_cap else junctions).alias("junctions_covered"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *([] if p.station_cap else [F.array_sort(F.collect_set("_st")).alias("police_stations_involved")]))
    dom = (cube.filter(F.col("_vt").isNotNull()).groupBy("cluster_label", "_vt").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
               .groupBy("cluster_label")
               .agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("first_id"), F.col("_vt"))).getField("_vt").alias("dominant_violation_type")))
    if p.station_cap:
        st = (cube.filter(F.col("_st").isNotNull()).groupBy("cluster_label", "_st").agg(F.min("first_id").alias("first_id"))
                  .groupBy("cluster_label")
                  .agg(F.slice(F.array_sort(F.collect_list(F.struct("first_id", "_st"))), 1, p.station_cap).alias("_s")))
        main = main.join(st.select("cluster_label", F.transform("_s", lambda x: x["_st"]).alias("police_stations_involved")), "cluster_label", "left")
    out = (main.join(dom, "cluster_label", "left")
               .select(
                   F.col("cluster_label").cast("int").alias("cluster_id"), "centroid_lat", "centroid_lon",
                   "violation_count", "unique_vehicle_types",
                   F.coalesce("dominant_violation_type", F.lit("Unknown")).alias("dominant_violation_type"),
                   F.coalesce("peak_hour_ratio", F.lit(0.0)).alias("peak_hour_ratio"), "avg_resolution_minutes",
                   "junctions_covered",
                   F.coalesce("police_stations_involved", F.array().cast("array<string>")).alias("police_stations_involved"),
                   "first_seen", "last_seen"))
    return out.orderBy(F.desc("violation_count"), "cluster_id")


def empty_clusters(spark) -> DataFrame:
    return spark.createDataFrame([], CLUSTER_SCHEMA)
