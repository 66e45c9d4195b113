"""Benchmark: time the headline queries on one scale factor.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_ALL=1 to time every registered query. Each query is run
to completion with the ``noop`` sink (full execution, nothing collected).
Prints one JSON line.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meshwork.plans.registry import load_all  # noqa: E402
from meshwork.plans.session import build_session  # noqa: E402

HEADLINE = (
    "rate_by_dimension", "graph_edges", "relationship_patterns", "status_cross_count",
    "avg_by_dimension", "profile_distinct", "profile_top_values", "profile_numeric",
    "column_value_counts", "infer_contract", "contract_violations", "quality_duplicates",
    "quality_outliers", "quality_rare_values", "quality_report", "pii_columns",
    "access_decisions", "validate_queries", "extract_query_text", "resolve_terms",
    "enrich_queries", "usage_stats_columns", "quality_drop_alerts", "lineage_edge_labels",
    "run_status",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          extra={"spark.driver.memory": "16g"})
    queries, _ = load_all()
    keys = list(queries) if os.environ.get("BENCH_ALL") else list(HEADLINE)
    # warm-up: JIT and metadata caches, not timed
    queries["rate_by_dimension"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        t0 = time.time()
        queries[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
