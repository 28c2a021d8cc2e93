"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from matchloom.plans.catalog import load
from matchloom.session import tune

HEADLINE = [
    "norm_skill", "phrases_extract", "contact_fields", "tenure_years", "experience_order", "pending_apps", "cosine_pairs",
    "layout_lines", "score_pairs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("matchloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.files.openCostInBytes", "131072").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    queries, _ = load()
    times = {}
    for name in HEADLINE:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "matchloom headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
