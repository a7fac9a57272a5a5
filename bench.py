"""Time every query on the tables of $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

The time of a query is the best of $BENCH_REPEATS runs and covers planning as well as execution.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from utterscope.plans.queries import QUERIES, flagship

REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("utterscope-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for _ in range(2):
        flagship(spark, folder).collect()
    seconds = {}
    for name, query in QUERIES.items():
        if chosen and name not in chosen:
            continue
        best = None
        for _ in range(REPEATS):
            started = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
