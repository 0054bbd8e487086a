"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution,
nothing collected to the driver), twice: ``cold`` (first run in the JVM, writes the
study's table steps) and warm (``queries``, the reported value, which reads them).  The eICU-shaped input tables are derived
from the driver tables once before timing (reported as ``prepare_sec``).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pipe_oxygen", "pipe_sofa", "pipe_compliance", "pipe_pf", "pipe_combined", "pipe_day12",
    "gap_sessions", "nearest_in_bucket", "three_way_match", "interval_pick", "pair_days",
    "six_number", "chisq", "transitions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from carelog.plans.catalog import QUERIES
    from carelog.session import get_spark
    from carelog.sources.fixtures import derive

    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, app="carelog-bench",
                      # local data is a few MB: without the second setting AQE folds each shuffle into
                      # one partition, and the stage after it onto one core
                      extra={"spark.driver.memory": "16g",
                             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    spark.sparkContext.setLogLevel("ERROR")
    t0 = time.time()
    derive(spark, sf_dir)
    prepare = time.time() - t0

    cold, warm = {}, {}
    for name in HEADLINE:
        for run in (cold, warm):  # first run includes JIT / codegen warm-up
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            run[name] = round(time.time() - t, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall_warm", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold_total": round(sum(cold.values()), 3), "cold": cold, "sf": sf,
                      "prepare_sec": round(prepare, 3), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
