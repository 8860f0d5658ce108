"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Each query is fully executed with the ``noop`` sink.  Queries run in pipeline
order in one session, so cluster labels computed by the first clustering
query are reused by the later ones (as in a pipeline run); ``dbscan_live`` and
``dbscan_batch`` therefore carry the clustering time."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kerbside.plans.inputs import clear_memo  # noqa: E402
from kerbside.plans.queries import QUERIES  # noqa: E402
from kerbside.session import build_session  # noqa: E402

HEADLINE = [
    "clean_live", "clean_batch", "hourly", "resolution_buckets", "top_junctions", "vehicle_mix", "temporal_stats", "heatmap",
    "heatmap_thinned", "map_sample", "eps_neighbors", "dbscan_live", "cluster_summary", "impact_live",
    "dashboard_live", "recommend_template", "geojson_features", "insight_context", "dbscan_batch",
    "cluster_summary_batch", "impact_batch", "dashboard_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, 2 * cpus))))
    spark = build_session(f"local[{cpus}]", app="kerbside-bench", shuffle_partitions=parts,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    clear_memo()
    times: dict[str, float] = {}
    t_all = time.time()
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(time.time() - t_all, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
