"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Each query runs once to warm up and then twice; the
faster of the two is reported, as seconds to materialise the whole result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.plans.catalog import load  # noqa: E402
from tickloom.session import local_session  # noqa: E402

HEADLINE = (
    "CAL-04", "WIN-03", "AGG-04", "XS-03", "TSS-06", "EVT-01", "SPR-03", "SM-01",
    "PNL-01", "DD-02", "TRD-01", "Q-08", "Q-10", "Q-15",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    keys = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tickloom-bench")
    catalog, _ = load()
    times = {}
    for key in keys:
        best = None
        for i in range(repeats + 1):
            start = time.perf_counter()
            catalog[key](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if i:
                best = took if best is None else min(best, took)
        times[key] = round(best if best is not None else took, 3)
    total = round(sum(times.values()), 3)
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
