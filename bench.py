"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names, optional).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """site_variables monthly_means extreme_quantile_max freeze_thaw_t1 moisture_season_summer
dedupe_last mask_visits daily_diagnostics apply_quality regularize interpolate daily_aggregate sensor_offsets
best_peer spike_features fill_spikes cleaned_readings impute_matrix combine_imputed holdout_test imputation_errors
availability correlation_matrix near_zero_variance importance_summary mosaic resample focal_mean slope
rasterize mask_polygon proximity d8_accumulation snow_effect buffer_extract canopy_grid""".split()


def main() -> None:
    from pyspark.sql import SparkSession

    from thawline.plans.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("thawline-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", os.environ.get("THAWLINE_SHARED", "/tmp/thawline-shared")).config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the executor
    times = {}
    for name in names:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
