"""Headline queries on one data folder; prints one JSON line.

BENCH_SF_DIR selects the data, BENCH_CPUS the local cores. Every query is consumed in full.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from shelfglass.registry import QUERIES
from shelfglass.staging import drop_stages

HEADLINE = [
    "P03_products_filtered", "A06_analysed_status", "A12_run_summary_disjoint", "A15_majority_vote",
    "J09_top_scores", "R06_main_page", "S10_insert_update", "X04_type_iqr_flags",
    "F06_sku_score", "F09_gram_score_urls", "F13_custom_pair_score", "A16_match_summary",
    "U22_upserted_scores", "U28_recalculated_scores", "X08_dbscan_clusters", "X13_sweep_long",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/part.parquet").count()  # starts the session's threads
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 2)
        drop_stages(spark)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 2),
                      "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1],
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
