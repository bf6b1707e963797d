"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built and fully executed (``noop`` sink: every row computed, nothing collected)
once as a warm-up and then ``BENCH_REPS`` times; the median is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "segment_summary",      # flagship: fact -> RFM scores -> segments + lapse label
    "rfm_segments",
    "lapsed_customers",
    "cohort_retention",
    "sessions",
    "customer_info",
    "association_rules",
    "recommendations",
    "lapse_roc",
    "amount_mann_whitney",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE

    from lapsekit.plans.catalog import QUERIES
    from lapsekit.session import get_session

    spark = get_session(f"local[{cpus}]", int(cpus) * 2, app_name="lapsekit-bench",
                        extra={"spark.driver.memory": "16g"})
    times = {}
    if not sys.argv[1:]:
        # building the prepared tables (what every query then reads) is timed on its own: the fact table,
        # then the customer states, scores and labels made from it and from the click log
        from lapsekit.sources import testdata as td
        builds = {"fact_build": [td.fact_all], "customer_build": [td.purchases, td.clicks, td.verdicts]}
        for build, tables in builds.items():
            runs = []
            for i in range(reps + 1):
                t0 = time.time()
                for table in tables:
                    table(spark, sf_dir, rebuild=True)
                if i:
                    runs.append(time.time() - t0)
            times[build] = round(statistics.median(runs), 3)
            print(f"# {build}: {times[build]}s", file=sys.stderr, flush=True)
    for name in names:
        runs = []
        for i in range(reps + 1):
            t0 = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.time() - t0)
        times[name] = round(statistics.median(runs), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "reps": reps}))


if __name__ == "__main__":
    main()
