"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the median counts. The result of
a query is written to Spark's no-op sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import site_queries  # noqa: E402
from pagetrove.session import local_session  # noqa: E402

HEADLINE = (
    "article_text", "pack_chunks", "hashed_embedding", "dedup_hash", "dedup_sequential", "frontier_all",
    "ingest_chunks", "vector_topk", "vector_topk_lsh", "search_join", "rank_rules", "rank_partial_ratio",
    "served_page",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=8)
    registry = site_queries.registry()
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: cold {times[0]:.2f}s, warm {seconds[name]:.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "runs": runs,
    }))


if __name__ == "__main__":
    main()
