"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8). Each query is written to Spark's noop
sink, so all its rows are computed and none reach the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "environmental_fact", "economic_fact", "policy_fact", "gold_fact", "ranking_table", "top_20_cities", "master_panel",
    "executive_summary", "kpi_checks", "group_profile", "daily_to_monthly_market", "green_index", "rank_all_lines",
    "number_rows_all_orders", "describe_columns", "iqr_outliers", "median_composite", "join_version_valid_at",
    "nearest_site_within_radius", "sensor_harmonisation", "grid_interpolation_held_ends", "upsert_partial_columns",
    "slowly_changing_merge", "panel_fixed_effects", "panel_fit_quality", "silhouette_squared", "trend_and_season",
    "forecast_horizons", "page_links", "explode_series", "scan_typed_csv", "spearman",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from panelforge.queries import REGISTRY

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm the JVM
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
