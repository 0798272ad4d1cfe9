"""The data behind each chart, computed from all valid rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade import config as C
from colonnade.dataset import ROW, Dataset, parsing
from colonnade.functions.labels import short
from colonnade.operators.frequencies import entry_blank
from colonnade.operators.order import positioned
from colonnade.operators.ranks import even, values_at_ranks
from colonnade.operators.schema import Profile, safe_sum, total_of
from colonnade.operators.statistics import magnitude, numeric_entries
from colonnade.scratch import written
from colonnade.small import small_table


def aggregated(rows: DataFrame, key: str, aggregation: str) -> DataFrame:
    """``(key, y)``: count, sum or mean per key over ``(key, y, n)`` rows.

    A sum beyond the double range comes out infinite, which callers report.
    """
    if aggregation == "count":
        return rows.groupBy(key).agg(F.sum("n").cast("double").alias("y"))
    parts = rows.groupBy(key).agg(safe_sum(F.col("y"), F.col("n")).alias("s"), F.sum("n").alias("n"))
    divisor = F.col("n") if aggregation == "mean" else None
    return parts.select(key, total_of(F.col("s"), divisor).alias("y"))


def category_rows(source: Dataset | Profile, x: str, y: str | None) -> DataFrame:
    """``(x, y, n)`` rows; counts come from the written frequencies where there are any."""
    if y is None and isinstance(source, Profile):
        chosen = source.values_of([source.by_name[x]]).where(~entry_blank())
        return chosen.select(F.col("value").alias("x"), F.lit(1.0).alias("y"), "n")
    ds = source.rows if isinstance(source, Profile) else parsing(source, [y])
    number = ds.number(y) if y else F.lit(1.0)
    rows = ds.frame.select(ds.label(x).alias("x"), number.alias("y"), F.lit(1).alias("n"))
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def category_chart(
    source: Dataset | Profile, x: str, y: str | None = None, aggregation: str = "count"
) -> DataFrame:
    """``(x, y)`` per raw category label (bar and donut)."""
    return aggregated(category_rows(source, x, y), "x", aggregation)


def dated_rows(source: Dataset | Profile, x: str, y: str | None) -> DataFrame:
    """``(t, y, n)`` rows for a line chart."""
    if y is None and isinstance(source, Profile):
        position = source.by_name[x]["position"]
        chosen = source.freq.where(F.col("position") == position)
        instant = F.timestamp_micros(F.floor(F.col("nanos") / 1000).cast("bigint"))
        rows = chosen.select(instant.alias("t"), F.lit(1.0).alias("y"), "n")
    else:
        ds = source.rows if isinstance(source, Profile) else parsing(source, [x, y])
        number = ds.number(y) if y else F.lit(1.0)
        rows = ds.frame.select(ds.instant(x).alias("t"), number.alias("y"), F.lit(1).alias("n"))
    return rows.where(F.col("t").isNotNull() & F.col("y").isNotNull())


def period_label(day: Column, unit: str) -> Column:
    if unit == "centuries":
        century = F.floor(F.year(day) / 100) * 100
        return F.concat(F.lpad(century.cast("string"), 4, "0"), F.lit("s"))
    pattern = {"days": "yyyy-MM-dd", "months": "yyyy-MM", "years": "yyyy"}[unit]
    return F.date_format(day, pattern)


def line_chart(
    source: Dataset | Profile, x: str, y: str | None = None, aggregation: str = "count"
) -> tuple[DataFrame, str]:
    """``(x, y)`` per period and the unit: the finest of day, month and year with at
    most 120 observed periods, otherwise centuries.

    One pass reduces the rows to days (a table bounded by the calendar), which keeps
    sums and counts apart so that means roll up exactly.
    """
    daily = written(
        dated_rows(source, x, y)
        .groupBy(F.to_date("t").alias("day"))
        .agg(safe_sum(F.col("y"), F.col("n")).alias("s"), F.sum("n").alias("n")),
        source.paths if isinstance(source, Profile) else None,
    )
    observed = daily.agg(
        F.count("day").alias("days"),
        F.count_distinct(F.trunc("day", "month")).alias("months"),
        F.count_distinct(F.year("day")).alias("years"),
    ).first()
    unit = next(
        (u for u in ("days", "months", "years") if observed[u] <= C.MAX_LINE_PERIODS), "centuries"
    )
    label = period_label(F.col("day"), unit).alias("x")
    if aggregation == "count":
        return daily.groupBy(label).agg(F.sum("n").cast("double").alias("y")), unit
    parts = daily.groupBy(label).agg(
        F.struct(
            F.sum("s.plain").alias("plain"),
            F.sum("s.scaled").alias("scaled"),
            F.max("s.largest").alias("largest"),
        ).alias("s"),
        F.sum("n").alias("n"),
    )
    divisor = F.col("n") if aggregation == "mean" else None
    return parts.select("x", total_of(F.col("s"), divisor).alias("y")), unit


def histogram(profile: Profile, x: str) -> DataFrame:
    """``(position, lower, upper, y)`` of equal-width bins; the last bin is closed.

    Bins come from the known extremes; the count reads distinct values with weights.
    """
    fact = profile.by_name[x]
    scale = magnitude(fact)
    low, high = fact["minimum"] / scale, fact["maximum"] / scale
    bins = min(C.MAX_HISTOGRAM_BINS, max(2, int(math.sqrt(fact["numeric_valid"]))))
    edges = np.linspace(low, high, bins + 1)
    scaled = F.col("key") / scale
    place = F.lit(0)
    for edge in edges[1:-1]:
        place = place + (scaled >= float(edge)).cast("int")
    counted = (
        numeric_entries(profile, [fact["position"]])
        .groupBy(place.alias("position"))
        .agg(F.sum("n").cast("double").alias("y"))
    )
    frame = small_table(profile.ds.spark, 
        [(i, float(edges[i] * scale), float(edges[i + 1] * scale)) for i in range(bins)],
        "position int, lower double, upper double",
    )
    return frame.join(F.broadcast(counted), "position", "left").fillna(0.0, ["y"])


def is_one_bin(fact) -> bool:
    """True when all values coincide after division by the largest magnitude."""
    scale = magnitude(fact)
    return fact["minimum"] / scale == fact["maximum"] / scale


def first_number(profile: Profile, x: str) -> float:
    """First valid number in source order."""
    position = profile.by_name[x]["position"]
    valid = profile.freq.where((F.col("position") == position) & F.col("x").isNotNull())
    return valid.orderBy("first_row").first()["x"]


def scatter_rows(ds: Dataset, x: str, y: str, paths: list[str] | None = None) -> DataFrame:
    """Valid pairs with their row key, written once: they are read thrice, and numbers given
    to rows of a scan may differ between two readings."""
    ds = parsing(ds, [x, y])
    rows = ds.frame.select(ROW, ds.number(x).alias("x"), ds.number(y).alias("y"))
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return written(rows, paths) if ds.is_text(x) or ds.is_text(y) or ds.source is not None else rows


def scatter_sample(
    ds: Dataset, x: str, y: str, rank_buffer: int, paths: list[str] | None = None
) -> tuple[DataFrame, int]:
    """Up to 500 valid pairs ``(position, x, y)``, evenly spaced in source order with
    both end points, and the number of valid pairs."""
    pairs = scatter_rows(ds, x, y, paths)
    size = pairs.agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("low"), F.max(ROW).alias("high")).first()
    total = size["n"]
    if total > C.MAX_POINTS:
        ranks = np.linspace(0, total - 1, C.MAX_POINTS, dtype=int).tolist()
        entries = pairs.select(
            F.lit(0).alias("group"), F.col(ROW).alias("key"), F.lit(1).cast("bigint").alias("n")
        )
        bucket = even(F.col("key"), F.lit(size["low"]), F.lit(size["high"]), 4096)
        keys = values_at_ranks(entries, {0: ranks}, {0: total}, rank_buffer, bucket, unit=True)
        pairs = pairs.where(F.col(ROW).isin(list(keys.values())))
    return positioned(pairs, F.asc(ROW), paths=paths).select("position", "x", "y"), total


def point_label(lower: float, upper: float) -> str:
    return f"{short(lower)} – {short(upper)}"
