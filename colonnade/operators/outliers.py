"""Values outside the 1.5 x IQR fences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.operators.schema import Profile
from colonnade.operators.statistics import magnitude, numeric_entries, order_pairs
from colonnade.small import small_table


def _between(lower: float, upper: float, weight: float) -> float:
    step = upper - lower
    return upper - step * (1 - weight) if weight >= 0.5 else lower + step * weight


def iqr_outliers(profile: Profile, facts: list | None = None) -> DataFrame:
    """Count and fences per numeric column with at least four valid values.

    Quartiles and the comparison are taken on values divided by the largest magnitude,
    so that fences of huge values stay finite.
    """
    facts = profile.of_type("numeric") if facts is None else facts
    usable = [f for f in facts if f["numeric_valid"] >= 4]
    around = order_pairs(profile, usable, [0.25, 0.75])
    rows = []
    for fact in usable:
        scale = magnitude(fact)

        def scaled(fraction: float) -> float:
            lower, upper, weight = around[fact["position"], fraction]
            return _between(lower / scale, upper / scale, weight)

        q1, q3 = scaled(0.25), scaled(0.75)
        fences = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        shown = [v * scale if math.isfinite(v * scale) else None for v in (*fences, q1, q3)]
        rows.append((fact["position"], fact["name"], fact["numeric_valid"], scale, *fences, *shown))
    fenced = small_table(profile.ds.spark, 
        rows,
        "position int, name string, valid_rows bigint, scale double, low double, high double, "
        "lower double, upper double, q1 double, q3 double",
    )
    scaled_key = F.col("key") / F.col("scale")
    outside = (scaled_key < F.col("low")) | (scaled_key > F.col("high"))
    entries = numeric_entries(profile, [f["position"] for f in usable])
    counted = (
        entries.join(F.broadcast(fenced), F.col("group") == F.col("position"))
        .where(outside)
        .groupBy("position")
        .agg(F.sum("n").alias("count"))
    )
    return fenced.join(F.broadcast(counted), "position", "left").select(
        "position", "name", F.coalesce("count", F.lit(0)).alias("count"),
        "valid_rows", "lower", "upper", "q1", "q3",
    )
