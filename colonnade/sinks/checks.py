"""Cross-checks of analysis results, for any number of datasets at once.

Every frame carries ``dataset_id``. The result has one row per check and dataset; the
joins are on ``dataset_id`` (and column name), which spread over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade import config as C
from colonnade.plans.analysis import Analysis


def _all(frame: DataFrame, check: str, holds: Column) -> DataFrame:
    """A check holds for a dataset when it holds in each of its rows."""
    grouped = frame.groupBy("dataset_id").agg(
        F.bool_and(F.coalesce(holds, F.lit(False))).alias("ok"), F.count(F.lit(1)).alias("rows")
    )
    return grouped.select("dataset_id", F.lit(check).alias("check_name"), "ok", "rows")


def column_checks(summary: DataFrame, metadata: DataFrame, statistics: DataFrame) -> DataFrame:
    """Dimensions, missing totals, and the balance of valid, invalid and missing rows."""
    totals = metadata.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("columns"), F.sum("missing_count").alias("missing")
    )
    whole = summary.join(totals, "dataset_id", "left")
    rows = F.col("row_count")
    meta = metadata.join(summary.select("dataset_id", "row_count"), "dataset_id")
    stats = statistics.select(
        "dataset_id", "name", "count", "missing", F.col("unique_count").alias("s_unique"),
        F.coalesce("invalid_count", F.lit(0)).alias("invalid"),
        F.col("detected_type").alias("s_type"),
    )
    both = meta.join(stats, ["dataset_id", "name"], "full")
    same = (
        (F.col("detected_type") == F.col("s_type"))
        & (F.col("missing_count") == F.col("missing"))
        & (F.col("unique_count") == F.col("s_unique"))
    )
    checks = [
        _all(whole, "dimensions", (F.col("columns") == F.col("column_count"))
             & (F.col("total_cells") == rows * F.col("column_count"))
             & (F.col("complete_rows") <= rows)),
        _all(whole, "missing_total", F.col("missing") == F.col("missing_cells")),
        _all(meta, "unique_bound", (F.col("missing_count") <= rows)
             & (F.col("unique_count") <= rows - F.col("missing_count"))),
        _all(both, "statistics_match", same),
        _all(both, "row_balance", F.col("count") + F.col("missing") + F.col("invalid") == rows),
    ]
    return reduce(DataFrame.unionByName, checks)


def chart_checks(
    summary: DataFrame, metadata: DataFrame, recommendations: DataFrame, charts: DataFrame,
    points: DataFrame,
) -> DataFrame:
    """Axis types of recommendations, their row bounds, and alignment with chart data."""

    def side(axis: str) -> DataFrame:
        return metadata.select(
            "dataset_id", F.col("name").alias(f"{axis}_column"),
            F.col("detected_type").alias(f"{axis}_type"),
            F.col("missing_count").alias(f"{axis}_missing"),
            F.col("unique_count").alias(f"{axis}_unique"),
        )

    typed = (
        recommendations.join(side("x"), ["dataset_id", "x_column"], "left")
        .join(side("y"), ["dataset_id", "y_column"], "left")
        .join(summary.select("dataset_id", "row_count"), "dataset_id")
    )
    category = F.col("x_type").isin("categorical", "boolean")
    counted = F.col("y_column").isNull() & (F.col("aggregation") == "count")
    measured = (F.col("y_type") == "numeric") & F.col("aggregation").isin("sum", "mean")
    kind = F.col("chart_type")
    axes = (
        F.when(kind == "histogram", (F.col("x_type") == "numeric") & counted)
        .when(kind == "donut", category & counted & (F.col("x_unique") <= C.MAX_DONUT_CATEGORIES))
        .when(
            kind == "scatter",
            (F.col("x_type") == "numeric") & (F.col("y_type") == "numeric")
            & (F.col("x_column") != F.col("y_column")) & (F.col("aggregation") == "none"),
        )
        .when(kind == "line", (F.col("x_type") == "datetime") & (counted | measured))
        .when(kind == "bar", category & (counted | measured))
    )
    bound = (F.col("valid_rows") <= F.col("row_count") - F.col("x_missing")) & (
        F.col("y_column").isNull()
        | (F.col("valid_rows") <= F.col("row_count") - F.col("y_missing"))
    )
    sizes = points.groupBy("dataset_id", "recommendation_index").agg(
        F.count(F.lit(1)).alias("points"),
        F.bool_and(F.col("x_number").isNotNull()).alias("numbers"),
        F.bool_and(F.col("x_label").isNotNull()).alias("labels"),
    )
    placed = recommendations.select(
        "dataset_id", F.col("position").alias("recommendation_index"), "chart_type"
    )
    aligned = placed.join(charts, ["dataset_id", "recommendation_index"], "full").join(
        sizes, ["dataset_id", "recommendation_index"], "left"
    )
    empty = F.col("points").isNull()
    right_kind = F.when(F.col("chart_type") == "scatter", F.col("numbers")).otherwise(F.col("labels"))
    checks = [
        _all(typed, "axis_types", axes),
        _all(typed, "valid_row_bound", bound),
        _all(aligned, "chart_alignment", F.col("chart_type").isNotNull() & F.col("note").isNotNull()),
        _all(aligned, "chart_points",
             (F.col("error").isNull() | empty)
             & (empty | (right_kind & (F.col("points") <= C.MAX_POINTS)))),
    ]
    return reduce(DataFrame.unionByName, checks)


def field_checks(metadata: DataFrame, fields: DataFrame) -> DataFrame:
    """Filter fields name existing columns."""
    known = metadata.select("dataset_id", "name", F.lit(True).alias("known"))
    joined = fields.select("dataset_id", "name").join(known, ["dataset_id", "name"], "left")
    return _all(joined, "filter_columns", F.col("known"))


def analysis_checks(analysis: Analysis, dataset_id: str = "this") -> DataFrame:
    """All checks of one analysis."""

    def keyed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("dataset_id", F.lit(dataset_id))

    summary, metadata = keyed(analysis.summary), keyed(analysis.metadata)
    columns = column_checks(summary, metadata, keyed(analysis.statistics))
    charts = chart_checks(
        summary, metadata, keyed(analysis.recommendation_table()),
        keyed(analysis.chart_table()), keyed(analysis.point_table()),
    )
    return columns.unionByName(charts).unionByName(
        field_checks(metadata, keyed(analysis.filter_fields))
    )
