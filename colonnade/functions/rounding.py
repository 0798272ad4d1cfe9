"""Rounding of the true binary value, half to even, as Python's round does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_binary(value: Column, digits: int) -> Column:
    """``round(value, digits)`` for values of moderate size.

    Spark rounds the shortest decimal text of a double, which only goes wrong where
    that text ends in a tie the binary value does not have. There the sign of the
    distance to the tie is computed exactly by splitting the double in two halves.
    """
    unit = 2 * 10**digits
    doubled = F.floor(F.abs(value) * 10**digits) * 2 + 1
    tie = F.abs(value) == doubled / F.lit(float(unit))
    magnitude = F.abs(value)
    spread = magnitude * F.lit(134217729.0)
    high = spread - (spread - magnitude)
    excess = (high * unit - doubled) + (magnitude - high) * unit
    half = doubled / F.lit(2.0)
    steps = F.when(excess > 0, F.ceil(half)).when(excess < 0, F.floor(half))
    exact = F.signum(value) * steps / F.lit(float(10**digits))
    return F.when(tie & (excess != 0), exact).otherwise(F.bround(value, digits))


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent with two digits; 0 for an empty whole."""
    return F.coalesce(round_binary(F.try_divide(part, whole) * 100, 2), F.lit(0.0))
