"""Text to UTC instants. The session time zone must be UTC (Dataset sees to it)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.functions.text import SPACE_CLASS, stripped

# Fixed value: full calendar dates, optionally followed by a time.
DATE_PATTERN = r"(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}/\d{1,2}/\d{4})(?:[ T].+)?"

# Layout of a 12-hour clock after the date has been rewritten as y-m-d.
CLOCK_12H = "yyyy-M-d h[:mm[:ss]][ ]a"


def _year_first(text: Column) -> Column:
    """Rewrite any accepted layout as y-m-d; slash dates are month first unless that
    is impossible."""
    first = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("int")
    slash = r"\A(\d{1,2})/(\d{1,2})/(\d{4})"
    return (
        F.when(
            text.rlike(r"\A\d{4}"),
            F.regexp_replace(text, r"\A(\d{4})[-/](\d{1,2})[-/](\d{1,2})", "$1-$2-$3"),
        )
        .when(first > 12, F.regexp_replace(text, slash, "$3-$2-$1"))
        .otherwise(F.regexp_replace(text, slash, "$3-$1-$2"))
    )


def _rewritten(text: Column) -> Column:
    """Any accepted layout in the one Spark's cast knows."""
    spaced = F.regexp_replace(_year_first(stripped(text)), r"\A(\S+?)[ T]\s*", "$1 ")
    # The cast wants seconds before an offset, and offsets with minutes.
    timed = F.regexp_replace(spaced, r"( \d{1,2}:\d{2})(?= ?(?:[+-]|Z|UTC))", "$1:00")
    return F.regexp_replace(timed, r"(:\d{2}(?:\.\d+)? ?[+-]\d{2})\z", "$1:00")


def instant_from_text(text: Column) -> Column:
    """Timestamp, or null when the text is no full calendar date.

    ISO text is cast as it is; only what the cast refuses is rewritten.
    """
    accepted = text.rlike(rf"\A{SPACE_CLASS}*+(?!0000)(?:{DATE_PATTERN}){SPACE_CLASS}*+\z")
    parsed = F.coalesce(
        text.try_cast("timestamp"),
        _rewritten(text).try_cast("timestamp"),
        F.try_to_timestamp(_rewritten(text), F.lit(CLOCK_12H)),
    )
    return F.when(accepted, parsed)


def nanosecond_tail(text: Column) -> Column:
    """The three digits below a microsecond (0-999) that a timestamp cannot hold."""
    digits = F.regexp_extract(text, r":\d{1,2}\.\d{6}(\d{1,3})", 1)
    return F.when(digits == "", 0).otherwise(F.rpad(digits, 3, "0").try_cast("int"))


def iso_text(nanos: Column) -> Column:
    """ISO text with offset for an epoch count in nanoseconds (decimal(21,0))."""
    seconds = F.floor(nanos / F.lit(1_000_000_000)).cast("bigint")
    fraction = (nanos - seconds.cast("decimal(21,0)") * F.lit(1_000_000_000)).cast("int")
    digits = F.lpad(fraction.cast("string"), 9, "0")
    shown = (
        F.when(fraction == 0, "")
        .when(fraction % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 6)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    base = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, shown, F.lit("+00:00"))
