"""Physical-plan shape of the headline queries (run after the query so AQE's final plan is shown).

    python scripts/plan_report.py [--sf /root/testdata/sf0.1] > PLANS.md
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from bench import HEADLINE
    from lapsekit.plans.catalog import QUERIES
    from lapsekit.session import get_session
    spark = get_session("local[8]", 16)
    print("# Plan report\n")
    print(f"Physical plans after execution (AQE final plans) on `{a.sf}`. Produced by `scripts/plan_report.py`.\n")
    print("| Query | Parquet scans | widest ReadSchema (cols) | pushed filters | exchanges | broadcast joins | "
          "sort-merge joins | windows | scalar subqueries | checkpoint reads | Python UDF |")
    print("|---|---|---|---|---|---|---|---|---|---|---|")
    for n in a.names or HEADLINE:
        df = QUERIES[n](spark, a.sf)
        execution = df._jdf.queryExecution()
        execution.toRdd().count()     # runs this very plan, so that it is final
        plan = execution.executedPlan().toString()
        assert "isFinalPlan=true" in plan or "AdaptiveSparkPlan" not in plan, n
        plan = plan.split("== Initial Plan ==")[0]
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        widest = max((s.count(":") for s in schemas), default=0)
        pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p})
        print(f"| `{n}` | {plan.count('FileScan parquet')} | {widest} | {'; '.join(pushed)[:80] or '-'} | "
              f"{len(re.findall(r'Exchange (?:hash|range|Single|Round)', plan))} | {plan.count('BroadcastHashJoin')} | "
              f"{plan.count('SortMergeJoin')} | {len(re.findall(r'Window ', plan))} | {plan.count('Subquery subquery')} | "
              f"{plan.count('Scan ExistingRDD')} | {plan.count('ArrowEvalPython') + plan.count('BatchEvalPython')} |")


if __name__ == "__main__":
    main()
