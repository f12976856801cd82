"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one run to warm up, then the median of three. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

HEADLINE = {"q1": "bucket_mean", "q2": "pair_segments", "q3": "segment_cascade", "q4": "cumulants", "q5": "prediction_intervals", "q6": "winkler_scores", "q7": "tsga_embeddings", "q8": "backtest"}


def main() -> None:
    from pyspark.sql import SparkSession

    from tidegrid.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for q, name in HEADLINE.items():
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[q] = round(median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, warm median, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
