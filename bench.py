"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is written to the ``noop`` sink (full execution, no output
cost). A first pass warms the JVM and Python workers; the reported time per
query is the median of ``BENCH_RUNS`` timed passes (default 1). Prints one
JSON line.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "redact_sensitive", "pii_counts", "clean_text", "chunk_documents", "sanitize_text", "trust_score",
    "screen_prompts", "cosine_topk", "retrieve", "guarded_batch", "event_kpis", "activity_timeline",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    from guardspark.plans.registry import load_all
    from guardspark.session import build_session
    spark = build_session(f"local[{cpus}]", app="guardspark-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = load_all()

    def run(name):
        t = time.perf_counter()
        qs[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    for n in names:          # warm-up pass
        run(n)
        spark.catalog.clearCache()
    out = {}
    for n in names:
        times = []
        for _ in range(runs):
            times.append(run(n))
            spark.catalog.clearCache()
        out[n] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
