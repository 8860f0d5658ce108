"""Enforcement recommendations for the top clusters.

Top-N by impact score (a top-k: per-partition top N, then merge), a
template per rank, and an optional overlay of model responses.  Model calls
themselves are outside the engine: the engine prepares the compact prompt
rows and parses/joins the response text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

# fixed values: the five template recommendations, used in rank order (rank % 5)
TEMPLATES = [
    {
        "description": (
            "This area shows a high concentration of parking violations that "
            "regularly obstruct traffic flow. Vehicles are frequently parked "
            "in no-parking zones, causing significant congestion during peak hours."
        ),
        "patrol_time_window": "7-9 AM and 5-8 PM on weekdays",
        "enforcement_action": "Penalty notice blitz with tow truck on standby",
        "estimated_congestion_reduction": "25-35%",
    },
    {
        "description": (
            "Illegal parking near commercial establishments creates recurring "
            "bottlenecks throughout the day. The high volume of mixed vehicle "
            "types suggests this is a busy commercial corridor that needs "
            "stricter enforcement."
        ),
        "patrol_time_window": "10 AM - 1 PM and 4-7 PM daily",
        "enforcement_action": "Tow truck deployment for repeat offenders",
        "estimated_congestion_reduction": "20-30%",
    },
    {
        "description": (
            "Persistent double-parking and footpath encroachment are the "
            "dominant violation patterns here. These violations slow emergency "
            "vehicle access and force pedestrians onto the road."
        ),
        "patrol_time_window": "8-10 AM on weekdays",
        "enforcement_action": "Challan drive with traffic warden deployment",
        "estimated_congestion_reduction": "15-25%",
    },
    {
        "description": (
            "This hotspot is characterised by vehicles blocking junction "
            "approaches during morning rush hours. Short but high-frequency "
            "violations suggest commuters stopping for quick errands."
        ),
        "patrol_time_window": "7-9 AM and 6-8 PM weekdays",
        "enforcement_action": "Visible police presence + instant challan",
        "estimated_congestion_reduction": "30-40%",
    },
    {
        "description": (
            "Late-evening parking violations dominate this zone, mostly near "
            "restaurants and entertainment venues. Vehicles parked on service "
            "roads reduce lane capacity significantly after sunset."
        ),
        "patrol_time_window": "7-11 PM on weekends",
        "enforcement_action": "Night patrol with penalty notice blitz",
        "estimated_congestion_reduction": "20-28%",
    },
]
REC_FIELDS = ("description", "patrol_time_window", "enforcement_action", "estimated_congestion_reduction")
RESPONSE_SCHEMA = ("array<struct<cluster_id:int, description:string, patrol_time_window:string, "
                   "enforcement_action:string, estimated_congestion_reduction:string, mock:boolean>>")


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, *[t[f] for f in REC_FIELDS]) for i, t in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template_id int, " + ", ".join(f"{f} string" for f in REC_FIELDS))


def top_clusters(scored: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` clusters by impact score (ties: cluster id) with ``rank``
    0..n−1.  ``orderBy().limit(n)`` is a top-k; the rank window then runs
    over at most ``n`` rows."""
    top = scored.orderBy(F.desc("impact_score"), F.asc("cluster_id")).limit(n)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("impact_score"), F.asc("cluster_id"))) - 1).cast("int"))


def prompt_rows(top: DataFrame) -> DataFrame:
    """Compact per-cluster projection sent to a model (10 fields)."""
    return top.select(
        "rank", "cluster_id", "violation_count", "dominant_violation_type",
        F.bround("peak_hour_ratio", 4).alias("peak_hour_ratio"),
        F.bround("avg_resolution_minutes", 2).alias("avg_resolution_minutes"),
        "unique_vehicle_types",
        F.bround("impact_score", 2).alias("impact_score"),
        "priority_tier", "recommended_enforcement_time", "junctions_covered",
    )


def recommend_from_templates(scored: DataFrame, n: int = 5) -> DataFrame:
    """Top clusters + template fields by ``rank % 5``, ``mock = true``."""
    top = top_clusters(scored, n)
    t = templates(scored.sparkSession)
    return (top.join(F.broadcast(t), F.pmod(top["rank"], F.lit(len(TEMPLATES))) == t["template_id"])
               .drop("template_id").withColumn("mock", F.lit(True)))


def extract_json_array(text_col) -> "F.Column":
    """First JSON array in a model response: of the fenced block where there is a
    closed one (its language tag goes), else of the whole text; from the first ``[``.
    ``from_json`` stops at the end of the array, so text after it does not matter.
    No array or invalid JSON → null."""
    blocks = F.split(text_col, "```", 3)
    inside = F.regexp_replace(F.get(blocks, 1), "^json", "")
    body = F.when((F.size(blocks) == 3) & (F.trim(inside) != ""), inside).otherwise(text_col)
    begin = F.instr(body, "[")
    return F.from_json(F.when(begin > 0, F.substr(body, begin)), RESPONSE_SCHEMA, {"allowSingleQuotes": "false"})


def parse_responses(responses: DataFrame, text: str = "response") -> tuple[DataFrame, DataFrame]:
    """Response texts → (entries(pos, cluster_id, fields…, mock), rejects).

    Each response text is one model answer; ``pos`` is the entry position
    within it."""
    parsed = responses.withColumn("_arr", extract_json_array(F.col(text)))
    rejects = parsed.filter(F.col("_arr").isNull()).drop("_arr")
    entries = (parsed.filter(F.col("_arr").isNotNull())
                     .select(F.posexplode("_arr").alias("pos", "e"))
                     .select("pos", "e.*"))
    return entries, rejects


def recommend_with_responses(scored: DataFrame, responses: DataFrame, n: int = 5, text: str = "response") -> DataFrame:
    """Overlay parsed model entries on the top clusters: the first entry with
    the same cluster id, else the entry at the same position, else the rank's
    template.  Missing fields become ``''``; ``mock`` is true only for
    templates.  A response that cannot be parsed gives templates for all."""
    top = top_clusters(scored, n)
    entries, _ = parse_responses(responses, text)
    # both overlay tables are cut to at most n rows before any broadcast:
    # entries naming a top cluster (semi-join with the broadcast top-n ids) and
    # entries at positions < n
    ids = F.broadcast(top.select("cluster_id"))
    by_id = (entries.join(ids, "cluster_id", "left_semi")
                    .groupBy("cluster_id")
                    .agg(F.min(F.struct("pos", *REC_FIELDS, "mock")).alias("m")))
    by_pos = (entries.filter(F.col("pos") < n)
                     .groupBy(F.col("pos").alias("rank"))
                     .agg(F.min(F.struct("pos", *REC_FIELDS, "mock")).alias("p")))
    t = templates(scored.sparkSession)
    joined = (top.join(F.broadcast(by_id), "cluster_id", "left")
                 .join(F.broadcast(by_pos), "rank", "left")
                 .join(F.broadcast(t), F.pmod(F.col("rank"), F.lit(len(TEMPLATES))) == t["template_id"]))
    rec = F.coalesce(F.col("m"), F.col("p"))
    cols = [F.when(rec.isNotNull(), F.coalesce(rec[f], F.lit(""))).otherwise(t[f]).alias(f) for f in REC_FIELDS]
    mock = F.when(rec.isNotNull(), F.coalesce(rec["mock"], F.lit(False))).otherwise(F.lit(True)).alias("mock")
    return joined.select(*top.columns, *cols, mock)
