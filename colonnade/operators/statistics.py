"""Descriptive statistics over the full data, from value frequencies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions import finite_or_null, percentage
from colonnade.functions.instants import iso_text
from colonnade.operators.frequencies import COMPLETE, TOP_TYPE, gathered
from colonnade.operators.ranks import values_at_ranks
from colonnade.operators.schema import DOWN, SMALL, Profile
from colonnade.small import small_table

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
TYPES = ("numeric", "categorical", "datetime", "boolean", "text")


def numeric_entries(profile: Profile, positions: list[int]) -> DataFrame:
    """``(group, key, n)``: distinct texts of numeric columns as numbers."""
    chosen = profile.freq.where(F.col("position").isin(positions) & F.col("x").isNotNull())
    return chosen.select(F.col("position").alias("group"), F.col("x").alias("key"), "n")


def magnitude(fact) -> float:
    """Largest absolute value of a numeric column; 1 for all zeros."""
    return max(abs(fact["minimum"]), abs(fact["maximum"])) or 1.0


def mean_of(fact) -> float:
    """Mean of a numeric column from its two sums; see ``safe_sum``."""
    total, count = fact["total"], fact["numeric_valid"]
    if total["largest"] < SMALL:
        return total["plain"] / count
    return total["scaled"] / count / DOWN


def order_pairs(profile: Profile, facts: list, fractions: list[float]) -> dict:
    """``{(position, fraction): (lower, upper, weight)}`` around each quantile."""
    targets, wanted = {}, {}
    for fact in facts:
        group, last = fact["position"], fact["numeric_valid"] - 1
        for fraction in fractions:
            place = last * fraction
            wanted[group, fraction] = (math.floor(place), math.ceil(place), place - math.floor(place))
        targets[group] = sorted({r for f in fractions for r in wanted[group, f][:2]})
    if not targets:
        return {}
    sizes = {fact["position"]: fact["unique_count"] for fact in facts}
    found = values_at_ranks(
        numeric_entries(profile, list(targets)), targets, sizes, profile.config.rank_buffer
    )
    return {
        key: (found[key[0], lower], found[key[0], upper], weight)
        for key, (lower, upper, weight) in wanted.items()
    }


def quartiles(profile: Profile) -> DataFrame:
    """Quartiles by linear interpolation between exact order statistics."""
    facts = [f for f in profile.of_type("numeric") if f["numeric_valid"]]
    around = order_pairs(profile, facts, list(QUARTILES.values()))
    rows = []
    for fact in facts:
        row = [fact["position"]]
        for fraction in QUARTILES.values():
            lower, upper, weight = around[fact["position"], fraction]
            value = lower * (1 - weight) + upper * weight
            row.append(value if math.isfinite(value) else None)
        rows.append(tuple(row))
    return small_table(profile.ds.spark, 
        rows, "position int, q1 double, median double, q3 double"
    )


def numeric_statistics(profile: Profile) -> DataFrame:
    """Mean, sample deviation, extremes and quartiles of each numeric column."""
    facts = profile.of_type("numeric")
    centred = small_table(
        profile.ds.spark,
        [(f["position"], magnitude(f), mean_of(f)) for f in facts if f["numeric_valid"]],
        "position int, scale double, mean double",
    )
    # Squares of values divided by the largest one neither overflow nor vanish.
    spread = (
        numeric_entries(profile, [f["position"] for f in facts])
        .join(F.broadcast(centred), F.col("group") == F.col("position"))
        .groupBy("position", "scale", "mean")
        .agg(
            F.sum(F.pow(F.col("key") / F.col("scale") - F.col("mean") / F.col("scale"), 2) * F.col("n")).alias("squares"),
            F.sum("n").alias("count"),
        )
    )
    deviation = F.sqrt(F.try_divide("squares", F.col("count") - 1)) * F.col("scale")
    moments = spread.select(
        "position",
        finite_or_null(F.col("mean")).alias("mean"),
        finite_or_null(deviation).alias("standard_deviation"),
    )
    base = profile.counts.where(F.col("detected_type") == "numeric")
    return (
        base.join(F.broadcast(moments), "position", "left")
        .join(F.broadcast(quartiles(profile)), "position", "left")
        .select(
            "position", "name", F.col("numeric_valid").alias("count"),
            (F.col("rows") - F.col("missing_count") - F.col("numeric_valid")).alias("invalid_count"),
            "mean", "median", "standard_deviation", "minimum", "maximum", "q1", "q3",
        )
    )


def datetime_statistics(profile: Profile) -> DataFrame:
    """Earliest and latest instant and the days between them."""
    base = profile.counts.where(F.col("detected_type") == "datetime")
    micros = [F.floor(F.col(f"{end}_nanos") / 1000).cast("double") for end in ("latest", "earliest")]
    return base.select(
        "position", "name", F.col("datetime_valid").alias("count"),
        (F.col("rows") - F.col("missing_count") - F.col("datetime_valid")).alias("invalid_count"),
        iso_text(F.col("earliest_nanos")).alias("earliest"),
        iso_text(F.col("latest_nanos")).alias("latest"),
        ((micros[0] - micros[1]) / 86_400_000_000).alias("range_days"),
    )


def categorical_statistics(profile: Profile) -> DataFrame:
    """Most frequent values of categorical, boolean and text columns."""
    facts = profile.of_type("categorical", "boolean", "text")
    top = gathered(profile.top_values(facts), ["value", "n"], "top_categories")
    base = profile.counts.where(F.col("detected_type").isin("categorical", "boolean", "text"))
    best = F.get("top_categories", F.lit(0))
    return base.join(F.broadcast(top), "position", "left").select(
        "position", "name", (F.col("rows") - F.col("missing_count")).alias("count"),
        best["value"].alias("top_value"),
        F.coalesce(best["n"], F.lit(0)).alias("top_value_count"),
        F.coalesce("top_categories", F.array().cast(TOP_TYPE)).alias("top_categories"),
    )


def column_statistics(profile: Profile) -> DataFrame:
    """One wide row per column; fields of other types are null."""
    numeric = numeric_statistics(profile).drop("name")
    dates = datetime_statistics(profile).drop("name")
    labels = categorical_statistics(profile).drop("name")
    combined = numeric.unionByName(dates, allowMissingColumns=True).unionByName(
        labels, allowMissingColumns=True
    )
    base = profile.counts.select(
        "position", "name", "detected_type", F.col("missing_count").alias("missing"),
        "missing_percentage", "unique_count",
    )
    return base.join(F.broadcast(combined), "position")


def complete_rows(profile: Profile) -> DataFrame:
    """Rows without a missing cell, counted along with the frequencies."""
    entry = profile.all_counts.where((F.col("position") == COMPLETE) & (F.col("x") == 1))
    return entry.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("complete_rows"))


def dataset_summary(profile: Profile) -> DataFrame:
    """One row of dataset-wide counts."""
    width = len(profile.ds.columns)
    counted = profile.counts.agg(
        F.max("rows").alias("row_count"),
        F.lit(width).cast("bigint").alias("column_count"),
        (F.max("rows") * width).alias("total_cells"),
        F.sum("missing_count").alias("missing_cells"),
        percentage(F.sum("missing_count"), F.max("rows") * width).alias("missing_percentage"),
        *(F.count_if(F.col("detected_type") == kind).alias(f"{kind}_columns") for kind in TYPES),
    )
    return counted.withColumn("complete_rows", complete_rows(profile).scalar())


def missing_cells(ds) -> DataFrame:
    """Missing cells per column and complete rows straight from the rows."""
    return ds.frame.agg(*(F.count_if(~ds.present(name)).alias(name) for name in ds.columns))
