"""Blank test, stripping, and the natural sort key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python calls whitespace; Spark's own trim removes spaces only.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
# The same characters as a class for regular expressions.
SPACE_CLASS = "[" + "".join(rf"\x{{{ord(char):x}}}" for char in WHITESPACE) + "]"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """Null, empty or whitespace only: the one and only missing test."""
    return stripped(F.coalesce(text, F.lit(""))) == ""


def natural_key(text: Column) -> Column:
    """Sort key that orders digit runs by value and ignores case and accents.

    A digit run is written as its length followed by its digits without leading
    zeros, so runs of any length compare by value.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))

    def weigh(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        sized = F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        return F.when(run.rlike(r"^\d"), sized).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, weigh), ""), "UNICODE_CI_AI")
