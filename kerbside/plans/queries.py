"""The query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per
operator.  Each reads the test-data tables and runs library operators on the
whole input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import clean as clean_ops
from kerbside.operators import timestats as ts
from kerbside.plans.inputs import violations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("clean_live")
def clean_live(spark, sf_dir):
    return clean_ops.clean_projection(violations(spark, sf_dir, "live"))


@query("clean_batch")
def clean_batch(spark, sf_dir):
    return clean_ops.clean_projection(violations(spark, sf_dir, "batch"))


@query("hourly")
def hourly(spark, sf_dir):
    return ts.hourly(violations(spark, sf_dir, "live"), "live")


@query("violation_type_norm")
def violation_type_norm(spark, sf_dir):
    from kerbside.functions.text import normalize_violation_type
    from kerbside.profiles import BATCH, LIVE
    from kerbside.plans.inputs import raw_records
    raw = raw_records(spark, sf_dir)
    vt = F.nullif(F.col("violation_type"), F.lit(""))
    return raw.select("id", normalize_violation_type(vt, LIVE).alias("type_live"),
                      normalize_violation_type(vt, BATCH).alias("type_batch"))


@query("finite_or_null")
def finite_or_null_q(spark, sf_dir):
    from kerbside.functions.text import finite_or_null
    v = violations(spark, sf_dir, "live")
    return v.select("id", finite_or_null(F.sqrt("resolution_minutes")).alias("root_minutes"))


@query("junction_label")
def junction_label_q(spark, sf_dir):
    from kerbside.functions.text import junction_label
    v = violations(spark, sf_dir, "live")
    g = v.filter(F.col("junction_name").isNotNull()).groupBy("junction_name").agg(F.count(F.lit(1)).alias("count"))
    lbl = junction_label(F.col("junction_name"))
    return g.select("junction_name", lbl.alias("label"),
                    F.when(F.char_length(lbl) > 18, F.concat(F.substring(lbl, 1, 16), F.lit("…"))).otherwise(lbl).alias("kpi_label"),
                    "count")


@query("data_profile")
def data_profile(spark, sf_dir):
    return ts.data_profile(violations(spark, sf_dir, "live"))


@query("day_of_week")
def day_of_week(spark, sf_dir):
    return ts.day_of_week(violations(spark, sf_dir, "live"), "live")


@query("day_of_week_batch")
def day_of_week_batch(spark, sf_dir):
    return ts.day_of_week(violations(spark, sf_dir, "batch"), "batch")


@query("hourly_batch")
def hourly_batch(spark, sf_dir):
    return ts.hourly(violations(spark, sf_dir, "batch"), "batch")


@query("weekly_trend")
def weekly_trend(spark, sf_dir):
    return ts.weekly_trend(violations(spark, sf_dir, "live"))


@query("top_junctions")
def top_junctions(spark, sf_dir):
    return ts.top_junctions(violations(spark, sf_dir, "live"), "live")


@query("top_junctions_batch")
def top_junctions_batch(spark, sf_dir):
    return ts.top_junctions(violations(spark, sf_dir, "batch"), "batch")


@query("vehicle_mix")
def vehicle_mix(spark, sf_dir):
    return ts.vehicle_mix(violations(spark, sf_dir, "live"), "live")


@query("vehicle_mix_batch")
def vehicle_mix_batch(spark, sf_dir):
    return ts.vehicle_mix(violations(spark, sf_dir, "batch"), "batch")


@query("violation_mix")
def violation_mix(spark, sf_dir):
    return ts.violation_mix(violations(spark, sf_dir, "live"), "live")


@query("violation_mix_batch")
def violation_mix_batch(spark, sf_dir):
    return ts.violation_mix(violations(spark, sf_dir, "batch"), "batch")


@query("resolution_buckets")
def resolution_buckets(spark, sf_dir):
    return ts.resolution_buckets(violations(spark, sf_dir, "live"), "live")


@query("resolution_buckets_batch")
def resolution_buckets_batch(spark, sf_dir):
    return ts.resolution_buckets(violations(spark, sf_dir, "batch"), "batch")


@query("peak_kpi")
def peak_kpi(spark, sf_dir):
    return ts.peak_kpi(violations(spark, sf_dir, "live"))


@query("top6_share")
def top6_share(spark, sf_dir):
    return ts.top6_share(violations(spark, sf_dir, "live"))


@query("heatmap")
def heatmap(spark, sf_dir):
    from kerbside.operators.heatmap import heat_cells
    return heat_cells(violations(spark, sf_dir, "live"))


@query("heatmap_thinned")
def heatmap_thinned(spark, sf_dir):
    from kerbside.operators.heatmap import heat_points
    return heat_points(violations(spark, sf_dir, "live"))


@query("map_sample")
def map_sample(spark, sf_dir):
    from kerbside.operators.heatmap import map_sample as ms
    return ms(violations(spark, sf_dir, "batch"))


def _cluster_out(df):
    """Cluster rows for comparison: sets as sorted ``|`` text."""
    cols = []
    for c in df.columns:
        if c in ("junctions_covered", "police_stations_involved"):
            cols.append(F.array_join(F.col(c), "|").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


@query("eps_neighbors")
def eps_neighbors(spark, sf_dir):
    from kerbside.operators.density import neighbor_counts
    v = violations(spark, sf_dir, "live").select("id", "latitude", "longitude")
    return neighbor_counts(v, 8e-4)


@query("dbscan_live")
def dbscan_live(spark, sf_dir):
    from kerbside.plans.inputs import labeled
    return labeled(spark, sf_dir, "live").select("id", "cluster_label")


@query("dbscan_batch")
def dbscan_batch(spark, sf_dir):
    from kerbside.plans.inputs import labeled
    return labeled(spark, sf_dir, "batch").select("id", "cluster_label")


@query("cluster_summary")
def cluster_summary_q(spark, sf_dir):
    from kerbside.plans.inputs import clusters
    return _cluster_out(clusters(spark, sf_dir, "live"))


@query("cluster_summary_batch")
def cluster_summary_batch_q(spark, sf_dir):
    from kerbside.plans.inputs import clusters
    return _cluster_out(clusters(spark, sf_dir, "batch"))


@query("impact_live")
def impact_live(spark, sf_dir):
    from kerbside.plans.inputs import scored
    return _cluster_out(scored(spark, sf_dir, "live"))


@query("impact_batch")
def impact_batch(spark, sf_dir):
    from kerbside.plans.inputs import scored
    return _cluster_out(scored(spark, sf_dir, "batch"))


@query("dashboard_live")
def dashboard_live(spark, sf_dir):
    from kerbside.operators.outputs import dashboard
    from kerbside.plans.inputs import labeled, scored
    d = dashboard(labeled(spark, sf_dir, "live"), scored(spark, sf_dir, "live"), "live")
    return d.select("total_violations", "active_clusters", "critical_zones", "avg_resolution_minutes",
                    F.col("date_range.from").alias("date_from"), F.col("date_range.to").alias("date_to"))


@query("dashboard_batch")
def dashboard_batch(spark, sf_dir):
    from kerbside.operators.outputs import dashboard
    from kerbside.plans.inputs import labeled, scored
    return dashboard(labeled(spark, sf_dir, "batch"), scored(spark, sf_dir, "batch"), "batch")


@query("ingest_summary")
def ingest_summary(spark, sf_dir):
    from kerbside.operators.outputs import ingest_summary as ing
    from kerbside.plans.inputs import labeled, scored
    return ing(labeled(spark, sf_dir, "live"), scored(spark, sf_dir, "live"))


REC_OUT = ["rank", "cluster_id", "violation_count", "impact_score", "priority_tier", "recommended_enforcement_time",
           "description", "patrol_time_window", "enforcement_action", "estimated_congestion_reduction", "mock"]


@query("recommend_template")
def recommend_template(spark, sf_dir):
    from kerbside.operators.recommend import recommend_from_templates
    from kerbside.plans.inputs import scored
    return recommend_from_templates(scored(spark, sf_dir, "live"), 5).select(*REC_OUT)


def standin_responses(prompt):
    """Stand-in for model answers (the model call is outside the engine): one
    response text for the prompt rows, entries in reverse order, rank 1 with
    an unknown cluster id, rank 3 without a congestion figure, rank 4 absent,
    wrapped in a code fence with prose around it.  Only formats rows."""
    e = prompt.filter(F.col("rank") <= 3).select(
        "rank",
        F.struct(
            F.when(F.col("rank") == 1, F.lit(-1)).otherwise(F.col("cluster_id")).alias("cluster_id"),
            F.concat(F.lit("Model note for hotspot "), F.col("cluster_id").cast("string")).alias("description"),
            F.concat(F.lit("Window "), F.col("recommended_enforcement_time")).alias("patrol_time_window"),
            F.concat(F.lit("Action for "), F.col("dominant_violation_type")).alias("enforcement_action"),
            F.when(F.col("rank") == 3, F.lit(None).cast("string"))
             .otherwise(F.concat((F.col("rank") * 5 + 10).cast("string"), F.lit("%"))).alias("estimated_congestion_reduction"),
        ).alias("e"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("k"), F.col("e")))), lambda x: x["e"])
    return e.agg(F.concat(F.lit("Here are the recommendations:\n```json\n"), F.to_json(arr),
                          F.lit("\n```\nLet me know [if] you need more.")).alias("response"))


@query("recommend_overlay")
def recommend_overlay(spark, sf_dir):
    from kerbside.operators.recommend import prompt_rows, recommend_with_responses, top_clusters
    from kerbside.plans.inputs import scored
    s = scored(spark, sf_dir, "live")
    responses = standin_responses(prompt_rows(top_clusters(s, 5)))
    return recommend_with_responses(s, responses, 5).select(*REC_OUT)


def _rounded_scored(df):
    """Scored clusters as written (means are exact, nothing to round)."""
    return df


@query("geojson_features")
def geojson_features(spark, sf_dir):
    from kerbside.operators.outputs import geojson_features as gj
    from kerbside.plans.inputs import scored
    return gj(_rounded_scored(scored(spark, sf_dir, "live")))


def _context_parts(spark, sf_dir):
    """Statistics of the labelled records from one scan, with totals and order keys."""
    from kerbside.plans.inputs import labeled
    lab = labeled(spark, sf_dir, "live")
    b = ts.bundle(lab, "live", keep_first_id=True, totals=True)
    return lab, [b[k] for k in ("hourly", "day_of_week", "top_junctions", "vehicle_types", "violation_types", "resolution_buckets")], b["totals"]


@query("insight_context")
def insight_context(spark, sf_dir):
    from kerbside.operators.outputs import insight_context as ic
    from kerbside.plans.inputs import scored
    lab, parts, totals = _context_parts(spark, sf_dir)
    return ic(lab, scored(spark, sf_dir, "live"), *parts, totals=totals)


@query("insight_document")
def insight_document(spark, sf_dir):
    """The question context as its JSON document."""
    from kerbside.operators.outputs import insight_context_json
    from kerbside.plans.inputs import scored
    lab, parts, totals = _context_parts(spark, sf_dir)
    return insight_context_json(lab, scored(spark, sf_dir, "live"), *parts, totals=totals)


@query("prompt_rows")
def prompt_rows_q(spark, sf_dir):
    """The rounded projection of the top clusters that a model is asked about."""
    from kerbside.operators.recommend import prompt_rows, top_clusters
    from kerbside.plans.inputs import scored
    return prompt_rows(top_clusters(scored(spark, sf_dir, "live"), 5)).withColumn("junctions_covered", F.array_join("junctions_covered", "|"))


@query("job_sections")
def job_sections(spark, sf_dir):
    """The whole job on raw records: rows of each of its sections, and the summary."""
    from kerbside.plans.inputs import raw_records
    from kerbside.plans.job import run_job
    out = run_job(spark, raw_records(spark, sf_dir), "live")
    rows = None
    for name in ("labeled", "clusters", "recommendations", "hourly", "weekly_trend", "vehicle_types", "violation_types", "heat_points", "features"):
        part = out[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("section"), "rows")
        rows = part if rows is None else rows.unionByName(part)
    summary = out["summary"].select(F.explode(F.array(*[F.struct(F.lit(f"summary.{c}").alias("section"), F.col(c).alias("rows")) for c in (
        "records_processed", "clusters_found", "critical_zones")])).alias("s")).select("s.*")
    return rows.unionByName(summary)


@query("clean_missing_columns")
def clean_missing_columns(spark, sf_dir):
    """Raw records whose coordinates go by short names and that lack columns."""
    from kerbside.plans.inputs import raw_records
    raw = raw_records(spark, sf_dir).drop("vehicle_type", "police_station").withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    return clean_ops.clean(raw, "live").select("id", "latitude", "longitude", "vehicle_type", "police_station", "hour_of_day")


@query("junction_count_text")
def junction_count_text_q(spark, sf_dir):
    """Items of list-valued text cells (the violation types of the raw records)."""
    from kerbside.operators.score import junction_count_text
    from kerbside.plans.inputs import raw_records
    return raw_records(spark, sf_dir).select("id", junction_count_text(F.col("violation_type")).alias("items"))


@query("csv_records")
def csv_records(spark, sf_dir):
    """Raw records written as CSV files (quotes doubled inside cells) beside a file that
    is no CSV, read back as records and cleaned."""
    import uuid
    from kerbside.plans.inputs import raw_records
    from kerbside.session import ensure_checkpoint_dir
    from kerbside.sources.csv import read_records_csv
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    raw = raw_records(spark, sf_dir)
    raw.write.option("header", True).option("escape", '"').csv(f"{root}/csv")
    raw.select("id").write.json(f"{root}/json")
    return clean_ops.clean(read_records_csv(spark, root), "live").select(
        F.col("seq").alias("id"), "latitude", "longitude", "violation_type", "created_datetime", "closed_datetime", "junction_name", "resolution_minutes")


@query("snapshot_backfill")
def snapshot_backfill(spark, sf_dir):
    """Batch cluster summary stored as an older snapshot (no score columns),
    read back and back-filled."""
    import uuid
    from kerbside.plans.inputs import clusters
    from kerbside.session import ensure_checkpoint_dir
    from kerbside.sources.snapshot import backfill_clusters, publish, read_published
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshots/{uuid.uuid4().hex}"
    publish(spark, root, "r1", {"clusters": clusters(spark, sf_dir, "batch")})
    back = backfill_clusters(read_published(spark, root, "clusters"))
    return back.select(F.col("cluster_id").cast("int").alias("cluster_id"), "violation_count",
                       "peak_hour_ratio", "impact_score", "priority_tier",
                       "priority_color", "recommended_enforcement_time", "first_seen")


@query("report_sections")
def report_sections(spark, sf_dir):
    from kerbside.operators.outputs import dashboard
    from kerbside.operators.recommend import recommend_from_templates
    from kerbside.plans.inputs import labeled, scored
    from kerbside.sources.report import report_rows
    lab = labeled(spark, sf_dir, "live")
    sc = _rounded_scored(scored(spark, sf_dir, "live"))
    b = ts.bundle(lab, "live")  # one scan for all statistics
    keys = {"hourly": "hour", "day_of_week": "day_of_week", "weekly_trend": "week", "top_junctions": "junction_name", "vehicle_types": "vehicle_type",
            "violation_types": "violation_type", "resolution_buckets": "bucket"}
    stats = {k: (b[k], key) for k, key in keys.items()}
    return report_rows(dashboard(lab, sc, "live"), sc, stats, recommend_from_templates(sc, 5))


@query("temporal_stats")
def temporal_stats(spark, sf_dir):
    """All seven statistics from one grouping-sets scan, in long form."""
    b = ts.bundle(violations(spark, sf_dir, "live"), "live")
    key_col = {"hourly": "hour", "day_of_week": "day_of_week", "weekly_trend": "week",
               "top_junctions": "junction_name", "vehicle_types": "vehicle_type",
               "violation_types": "violation_type", "resolution_buckets": "bucket"}
    parts = []
    for stat, df in b.items():
        cols = set(df.columns)
        parts.append(df.select(
            F.lit(stat).alias("stat"), F.col(key_col[stat]).cast("string").alias("key"), F.col("count").cast("long"),
            (F.col("lat") if "lat" in cols else F.lit(None).cast("double")).alias("lat"),
            (F.col("lon") if "lon" in cols else F.lit(None).cast("double")).alias("lon"),
            (F.col("percentage") if "percentage" in cols else F.lit(None).cast("double")).alias("percentage")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
