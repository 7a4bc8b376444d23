"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

import navengine.plans  # noqa: F401  registers all queries
from navengine.plans.queries import QUERIES

HEADLINE = [
    "drawdown_and_vol", "asof_backward_anchor", "returns_panel", "jump_classification", "trailing_window", "rolling_returns",
    "rolling_summary", "persistence_pairs", "spliced_nav", "nav_upsert",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    QUERIES["dup_keys"](spark, sf).count()  # warm session
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(sorted(times)[1], 3)
    print(json.dumps({"metric": "headline queries, median of three", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
