"""Headline queries in stage order; prints one JSON line.

Stages (transcript, memories, chunks, scores) are written once and shared, so a query's
time includes the stages it is the first to need.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnloom.plans.registry import QUERIES  # noqa: E402
from turnloom.plans.workspace import close_all  # noqa: E402
from turnloom.session import local_session  # noqa: E402

HEADLINE = [
    "text_tokens", "guard_families", "scan_findings", "eval_transcript", "memory_observed", "chunk_top_k",
    "retrieval_decisions", "context_stats", "aggregate_slices", "compare_modes", "failure_slices", "limit_run_budget",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "turnloom-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    timings = {}
    close_all()
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
