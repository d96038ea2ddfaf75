"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed completely with the ``noop`` sink (no collect to the
driver); the best of ``$BENCH_REPEAT`` runs is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "deal_screen", "triangulation_exact", "triangulation_approx", "rank_default", "rank_distributed",
    "top_deals", "ml_features", "layers_end_to_end",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from dealscreen.session import local_session

    spark = local_session(cpus, shuffle_partitions=2 * cpus, app="dealscreen-bench")
    from dealscreen.registry import QUERIES

    # Warm-up (JVM, codegen caches) on a cheap query, not timed.
    QUERIES["silver_listings"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        best = None
        try:
            for _ in range(repeat):
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
        except Exception as exc:  # keep the report whole; the failure goes to stderr
            print(f"{name} failed: {type(exc).__name__}: {exc}", file=sys.stderr)
        times[name] = None if best is None else round(best, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(t for t in times.values() if t), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
