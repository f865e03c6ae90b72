"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores,
``BENCH_RUNS`` how often each query runs (the best time counts).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chunks",
    "chunk_upsert",
    "embed_text",
    "page_text",
    "extract_links",
    "parse_extractions",
    "similarity_join",
    "similarity_join_lsh",
    "topk_chunks",
    "resolve_entities",
    "build_graph",
    "adjacency",
    "one_hop_neighbours",
    "crawl_pages",
    "hybrid_query",
    "stream_ingest",
    "quota_flags",
    "duplicate_report",
]


def main() -> None:
    from corpusloom.checks.queries import REGISTRY
    from corpusloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session("bench", cpus, spark__ui__showConsoleProgress="false")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
