"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up; its figure is the median of the runs after that, three for quick queries and
one for those that take longer than `QUICK` seconds. The stored prediction table is built and timed first."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "evidence_v15", "pathway_features", "extract_v04", "extract_v06", "activity_metadata", "evidence_spans", "lsr_candidates",
    "review_queue", "overview", "density_site", "top_hazards", "batch_audit", "tier_metrics", "review_stats",
    "duplicate_group_ids", "annotation_pool", "annotation_violations", "select_active_batch", "average_precision",
    "threshold_search_oof", "bootstrap_ci", "group_safe_split", "tfidf_weights",
]


QUICK = 4.0


def timed(build) -> float:
    start = time.time()
    build().write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    from hazardloom.plans import tables
    from hazardloom.plans.catalog import queries
    from hazardloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds = {}
    build = timed(lambda: tables.stored_predictions(spark, sf_dir))
    for name in HEADLINE:
        run = lambda: registered[name](spark, sf_dir)  # noqa: B023, E731
        cold = timed(run)
        seconds[name] = round(statistics.median(timed(run) for _ in range(3 if cold < QUICK else 1)), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir), "prediction_table_sec": round(build, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
