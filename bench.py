"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ["e1_study_panel", "e2_extended_panel", "c1_lag_horizon_map", "e6_gapped_sequences", "e5_itemset_support", "j12_nearest_prior",
            "j5_latest_quote", "r1_block_bootstrap", "r7_weighted_reestimates", "r11_step_down_p", "l3_path_downside", "m5_paired_losses",
            "x4_excerpt_merge", "a9_category_coverage", "t4_resampled_bars"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.plans import catalog
    from tidemark.session import clear

    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()
