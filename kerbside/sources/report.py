"""Full report as rows: one row per item of every section (dashboard,
clusters, time statistics, recommendations) with the item as JSON text.
Written as JSON lines, it never passes whole through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.sources.snapshot import _json_ready

JSON_OPTS = {"ignoreNullFields": "false"}


def _rows(section: str, df: DataFrame, key: str | None) -> DataFrame:
    d = _json_ready(df)
    k = F.col(key).cast("string") if key else F.lit("")
    return d.select(F.lit(section).alias("section"), k.alias("item"),
                    F.to_json(F.struct(*[F.col(c) for c in d.columns]), JSON_OPTS).alias("payload"))


def report_rows(dashboard: DataFrame, clusters: DataFrame, time_stats: dict[str, tuple[DataFrame, str]],
                recommendations: DataFrame, generated_at: str | None = None) -> DataFrame:
    """``time_stats`` maps a statistic name to (table, key column).  With
    ``generated_at`` a first ``meta`` row carries the report time."""
    out = _rows("dashboard", dashboard, None).union(_rows("clusters", clusters, "cluster_id"))
    if generated_at is not None:
        meta = dashboard.sparkSession.createDataFrame([(generated_at,)], "generated_at string")
        out = _rows("meta", meta, None).union(out)
    for name, (df, key) in time_stats.items():
        out = out.union(_rows(f"time_stats.{name}", df, key))
    return out.union(_rows("recommendations", recommendations, "rank"))


def write_report(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("section", "item", F.col("payload"))).alias("value")).write.mode("overwrite").text(path)
