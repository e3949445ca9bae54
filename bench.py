"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rasterlake.plans import bridge, registry

HEADLINE = ("bmp24_stats", "png_rgb_stats", "pcx_rgb_stats", "tiff_lzw_stats", "gif_lzw_stats", "png_adam7_stats", "jpeg_closeness", "top_colors", "mixed_deep_scan", "status_summary", "csv_report_rows", "grid_projection", "search_substring", "sort_topk_names", "human_sizes", "interval_union", "frame_rollup", "tag_lookup", "relational_stats")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["human_sizes"](spark, sf_dir).limit(1).collect()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    # what the pictures cost before the engine sees them
    encoders = {}
    for kind in ("bmp", "png", "pcx", "lzw.tif"):
        began = time.perf_counter()
        bridge.encoded(bridge.order_pictures(spark, sf_dir), F.lit(kind)).write.format("noop").mode("overwrite").save()
        encoders[kind] = round(time.perf_counter() - began, 3)
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
    deep = sum(took[n] for n in ("bmp24_stats", "png_rgb_stats", "pcx_rgb_stats", "tiff_lzw_stats"))
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "deep_images_per_sec": round(4 * orders / deep), "encoding_alone": encoders}))
    spark.stop()


if __name__ == "__main__":
    main()
