"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion into Spark's ``noop`` sink (the whole plan
executes, nothing is collected), after one warm-up. The metric is the sum of
wall seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "baseline_eval_many",   # scan → daily mean → labels + baseline in one window → backtest
    "feature_frame_many",   # per-supplier frame + daily calendar of date-only drivers
    "lag_window_rows_many",  # 10-row windows of 8 drivers per supplier (exploded; lag_windows_many of earlier rounds)
    "robust_params_many",   # weighted exact percentiles per supplier and driver
    "predictions_long",     # scaled windows scored per supplier and horizon
    "labels_long",
    "feature_frame",
    "linear_eval",          # scaler → ridge fit per horizon → score → backtest
    "attribution_long",
    "driver_role",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidemark.session import get_session
    from tidemark.plans.registry import QUERIES

    spark = get_session(f"local[{cpus}]", app="tidemark-bench",
                        shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    # one untimed run: the first query would otherwise pay for start-up
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
