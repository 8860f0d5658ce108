"""The whole job: clean → cluster → summarise → score → statistics →
recommendations → outputs, optionally published as one snapshot run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import timestats as ts
from kerbside.operators.clean import clean
from kerbside.operators.clusters import cluster_summary, label_points
from kerbside.operators.heatmap import heat_points, map_sample
from kerbside.operators.outputs import dashboard, geojson_features, ingest_summary
from kerbside.operators.recommend import recommend_from_templates, recommend_with_responses
from kerbside.operators.score import score
from kerbside.profiles import get_profile
from kerbside.schema import with_sequence
from kerbside.session import ensure_checkpoint_dir, materialize
from kerbside.sources.snapshot import publish


def run_job(spark: SparkSession, raw: DataFrame, profile: str = "live", out_root: str | None = None,
                 run_id: str | None = None, responses: DataFrame | None = None, top_n: int = 5,
                 time_formats: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Run every stage on raw records, in the order of ``schema.with_sequence``;
    ``time_formats`` are tried before the written forms of timestamps.  Labels and scored clusters are
    checkpointed once and reused by every later output.  With ``out_root``
    the sections are written as one run and the run pointer is moved last."""
    p = get_profile(profile)
    ensure_checkpoint_dir(spark)
    records = clean(with_sequence(raw), p, time_formats)
    labeled = materialize(label_points(records, p), f"labeled_{p.name}")
    scored = materialize(score(cluster_summary(labeled, p), p), f"scored_{p.name}")
    recs = (recommend_with_responses(scored, responses, top_n) if responses is not None
            else recommend_from_templates(scored, top_n))
    out = {
        "labeled": labeled,
        "clusters": scored,
        "recommendations": recs,
        "dashboard": dashboard(labeled, scored, p, as_of=F.current_timestamp().cast("string")),
        # all seven statistics from one scan (one grouping-sets aggregate)
        **ts.bundle(labeled, p),
        "heat_points": heat_points(labeled),
        "features": geojson_features(scored),
        "summary": ingest_summary(labeled, scored),
    }
    if p.name == "batch":
        out["map_points"] = map_sample(labeled)
    if out_root:
        sections = {k: v for k, v in out.items() if k != "labeled"}
        publish(spark, out_root, run_id or uuid.uuid4().hex, sections)
    return out


def main(argv: list[str] | None = None) -> None:
    """``python -m kerbside.plans.job --input <csv folder> --out <folder>
    [--profile live|batch] [--run-id ID]``: read CSV records, run every stage
    and publish one snapshot run."""
    import argparse

    from kerbside.session import build_session
    from kerbside.sources.csv import read_records_csv

    ap = argparse.ArgumentParser(prog="kerbside.plans.job")
    ap.add_argument("--input", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--profile", default="live", choices=["live", "batch"])
    ap.add_argument("--run-id", default=None)
    ap.add_argument("--master", default=None)
    ap.add_argument("--order", default="file", choices=["file", "id", "position"], help="what orders the records")
    ap.add_argument("--time-format", action="append", default=[], help="timestamp pattern, may be repeated")
    ap.add_argument("--rows", default="file", choices=["file", "split", "line"],
                    help="newlines inside cells: each file by one task, in splits (two scans), or none (one scan, in splits)")
    args = ap.parse_args(argv)
    spark = build_session(args.master)
    out = run_job(spark, read_records_csv(spark, args.input, multi_line={"file": True, "split": "split", "line": False}[args.rows], order_key=args.order), args.profile,
                  out_root=args.out, run_id=args.run_id, time_formats=tuple(args.time_format))
    for r in out["summary"].collect():
        print(r.asDict())


if __name__ == "__main__":
    main()
