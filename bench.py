"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from acceptance.queries import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "value_frequencies column_metadata column_metadata_typed column_metadata_documents "
    "dataset_summary numeric_stats numeric_stats_typed datetime_stats top_categories outliers_iqr "
    "bar_sum bar_mean line_daily line_period_ladder histogram scatter_sample correlation_pairs "
    "monthly_mean recommendations insights_all filter_combined filter_typed filtered_chart "
    "search_any_cell natural_sort page_rows_deep csv_round_trip catalog_checks analysis_checks "
    "saved_analysis"
).split()
#: Run once before timing, so that the first queries do not carry the JVM's start.
WARM_UP = ("column_metadata_typed", "numeric_stats")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", FOLDER)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else FOLDER,
            }
        )
    )


if __name__ == "__main__":
    main()
