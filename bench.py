"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Each query is executed to completion with the ``noop`` sink (full plan, no
collect). One warm-up run, then the median of ``$BENCH_REPEATS`` timed runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapeworks.catalog.queries import QUERIES  # noqa: E402
from tapeworks.session import local_session  # noqa: E402

HEADLINE = [
    "ds_1_feature_panel",
    "join_4_asof_backward",
    "join_7_trailing_news",
    "agg_1_daily_events",
    "ds_13_backtest_summary",
    "ds_12_scorecard",
    "agg_5_regression_metrics",
    "ds_9_predictions",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session("tapeworks-bench", cores=cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    times: dict[str, float] = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)  # warm-up (JIT, file listing, broadcast sizes)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeats)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
