"""Text to finite doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.functions.text import SPACE_CLASS

# Fixed value: plain or comma-grouped decimals with an optional exponent.
NUMBER_PATTERN = r"[+-]?(?:(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"


def finite_or_null(value: Column) -> Column:
    """Null for NaN as well, which Spark orders above infinity."""
    return F.when(F.abs(value) < float("inf"), value)


def number_from_text(text: Column) -> Column:
    """Finite double, or null. The pattern guards against 'inf', '1d' and the like.

    One chain without branches, so that nothing is evaluated twice per cell.
    """
    match = F.regexp_extract(text, rf"\A{SPACE_CLASS}*+({NUMBER_PATTERN}){SPACE_CLASS}*+\z", 1)
    value = F.replace(match, F.lit(","), F.lit("")).try_cast("double")
    return F.nullif(F.nullif(value, F.lit(float("inf"))), F.lit(float("-inf")))
