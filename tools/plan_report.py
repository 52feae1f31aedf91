"""Per-query physical plan summary: exchanges, Python stages, broadcasts, scans.

Usage: python tools/plan_report.py [sf_dir] [name ...]
Runs each query once (AQE finalises the plan at execution) and prints one
line per query, so shuffle counts can be tracked from round to round.
"""

from __future__ import annotations

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakeshift.plans.catalog import QUERIES  # noqa: E402
from lakeshift.session import get_session  # noqa: E402


def summarize(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin"
                                   r"|Exchange SinglePartition", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "python": len(re.findall(r"FlatMapGroupsInPandas|ArrowEvalPython|MapInArrow|MapInPandas", plan)),
        "scans": plan.count("FileScan") + plan.count("Scan parquet"),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_session("local[8]", shuffle_partitions=16, extra={"spark.ui.enabled": "false"})
    print(f"{'query':24s} {'sec':>6s} {'shuffles':>8s} {'bcast':>6s} {'python':>6s} {'scans':>6s}")
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        sec = time.perf_counter() - t0
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        print(f"{name:24s} {sec:6.2f} {s['shuffles']:8d} {s['broadcasts']:6d} {s['python']:6d} {s['scans']:6d}")


if __name__ == "__main__":
    main()
