"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line. Each query is executed in
full through the ``noop`` sink (no collect to the driver). One warm-up pass
over all queries, then ``$BENCH_REPEAT`` (default 3) timed passes; the
median per query is reported. Timings include building the plan.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakeshift.plans.catalog import QUERIES  # noqa: E402
from lakeshift.session import get_session  # noqa: E402

HEADLINE = [
    "simple_breaks", "simple_breaks_jrc", "nrt_ar1", "nrt_range", "monthly_counts", "drained_month",
    "gap_report", "prepare_panel", "merge_both", "class_areas", "nearest_scene", "lake_at_points",
    "bbox_filter", "bayes_breaks", "nrt_arima",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def facts(spark, sf_dir: str) -> dict:
    """Figures beside the times: row groups that a look-up by id reads, exchanges of the flagship plan."""
    import re
    groups = [r.n_groups for r in QUERIES["lake_point_reads"](spark, sf_dir).collect()]
    plan = QUERIES["simple_breaks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    return {"row_groups_per_lookup": round(sum(groups) / max(len(groups), 1), 3),
            "simple_breaks_exchanges": len(re.findall(r"\bExchange ", plan))}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus * 2))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=parts,
                        extra={"spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    # one warm-up pass over every query (JIT, Python workers, file listing),
    # then ``repeat`` timed passes in round-robin order; median per query
    for name in names:
        run(QUERIES[name](spark, sf_dir))
    samples = {name: [] for name in names}
    for _ in range(repeat):
        for name in names:
            t0 = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            samples[name].append(time.perf_counter() - t0)
    times = {name: round(statistics.median(v), 3) for name, v in samples.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat,
                      "facts": facts(spark, sf_dir)}))


if __name__ == "__main__":
    main()
