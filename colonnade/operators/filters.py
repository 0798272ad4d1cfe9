"""Column filters: validation on the driver, one predicate for Spark."""

from __future__ import annotations

import datetime
import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import config as C
from colonnade.dataset import Dataset, quoted
from colonnade.errors import DatasetError
from colonnade.functions import is_blank
from colonnade.operators.frequencies import entry_blank
from colonnade.operators.schema import Profile


@dataclass(frozen=True)
class CategoryFilter:
    column: str
    values: tuple[str, ...]
    kind = "categorical"


@dataclass(frozen=True)
class NumberFilter:
    column: str
    minimum: float | None = None
    maximum: float | None = None
    kind = "numeric"


@dataclass(frozen=True)
class DateFilter:
    """Inclusive whole UTC days as ``YYYY-MM-DD``."""

    column: str
    start: str | None = None
    end: str | None = None
    kind = "datetime"


Rule = CategoryFilter | NumberFilter | DateFilter


def filter_fields(profile: Profile) -> DataFrame:
    """``(position, name, kind, values)``: filterable columns; labels sorted, at most 50."""
    facts = [
        f
        for f in profile.of_type("categorical", "boolean")
        if f["unique_count"] <= C.MAX_FILTER_VALUES
    ]
    ranged = [f["position"] for f in profile.of_type("numeric", "datetime")]
    labelled = [f["position"] for f in facts]
    present = profile.values_of(facts).where(~entry_blank())
    values = present.groupBy("position").agg(F.array_sort(F.collect_list("value")).alias("values"))
    kind = F.when(F.col("position").isin(ranged), F.col("detected_type")).otherwise("categorical")
    chosen = profile.counts.where(F.col("position").isin(labelled + ranged))
    return chosen.join(F.broadcast(values), "position", "left").select(
        "position", "name", kind.alias("kind"),
        F.coalesce("values", F.array().cast("array<string>")).alias("values"),
    )


def _invalid(message: str) -> DatasetError:
    return DatasetError("invalid_filter", message)


def _day(text: str | None) -> datetime.date | None:
    if text is None:
        return None
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        raise _invalid(f"{text!r} is not written as year-month-day.")
    try:
        return datetime.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError as error:
        raise _invalid(f"{text!r} is no calendar date.") from error


def validate(rules: list[Rule], fields: dict[str, tuple[str, list[str]]]) -> None:
    """``fields`` maps a column to its kind and known labels."""
    if len(rules) > C.MAX_FILTER_RULES:
        raise _invalid(f"At most {C.MAX_FILTER_RULES} rules are allowed.")
    if len({rule.column for rule in rules}) != len(rules):
        raise _invalid("Only one rule per column is allowed.")
    for rule in rules:
        kind, known = fields.get(rule.column, (None, []))
        if kind != rule.kind:
            raise _invalid(f"{rule.column!r} cannot be filtered this way.")
        if isinstance(rule, CategoryFilter):
            if len(rule.values) > C.MAX_FILTER_VALUES:
                raise _invalid(f"At most {C.MAX_FILTER_VALUES} values are allowed.")
            if not rule.values or not set(rule.values) <= set(known):
                raise _invalid("Category values must occur in the dataset.")
            continue
        low, high = (
            (rule.minimum, rule.maximum)
            if isinstance(rule, NumberFilter)
            else (_day(rule.start), _day(rule.end))
        )
        if any(isinstance(b, float) and not math.isfinite(b) for b in (low, high)):
            raise _invalid("Bounds must be finite numbers.")
        if low is None and high is None:
            raise _invalid("A range needs at least one bound.")
        if low is not None and high is not None and low > high:
            raise _invalid("The lower bound exceeds the upper bound.")


def _number_range(ds: Dataset, rule: NumberFilter) -> Column:
    """Bounds on the stored column where its type allows, so that they reach the scan."""
    kind = ds.types[rule.column]
    bounds = [b for b in (rule.minimum, rule.maximum) if b is not None]
    low, high = rule.minimum, rule.maximum
    value, guard = ds.number(rule.column), F.lit(True)
    if isinstance(kind, T.IntegralType) and all(abs(b) <= 2**53 for b in bounds):
        value = quoted(rule.column)
        low = None if low is None else math.ceil(low)
        high = None if high is None else math.floor(high)
    elif isinstance(kind, T.DoubleType):
        value, guard = quoted(rule.column), ds.number(rule.column).isNotNull()
    if low is not None:
        guard = (value >= F.lit(low)) & guard
    if high is not None:
        guard = (value <= F.lit(high)) & guard
    return guard


def _date_range(ds: Dataset, rule: DateFilter) -> Column:
    kind = ds.types[rule.column]
    start, end = _day(rule.start), _day(rule.end)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value, name = quoted(rule.column), kind.simpleString()
    else:
        value, name = ds.instant(rule.column), "timestamp"
    parts = []
    if start is not None:
        parts.append(value >= F.lit(str(start)).cast(name))
    if end is not None and end < datetime.date.max:
        parts.append(value < F.lit(str(end + datetime.timedelta(days=1))).cast(name))
    return reduce(lambda a, b: a & b, parts, value.isNotNull())


def predicate(ds: Dataset, rule: Rule) -> Column:
    """True for rows that pass; missing and unparseable cells never do."""
    if isinstance(rule, CategoryFilter):
        return ds.present(rule.column) & ds.text(rule.column).isin(list(rule.values))
    return _number_range(ds, rule) if isinstance(rule, NumberFilter) else _date_range(ds, rule)


def filtered(ds: Dataset, rules: list[Rule]) -> Dataset:
    """All rules must hold; no rules keep every row."""
    for rule in rules:
        ds = ds.where(predicate(ds, rule))
    return ds
