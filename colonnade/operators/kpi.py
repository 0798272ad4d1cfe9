"""Headline numbers of a dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame

from colonnade.functions.labels import significant
from colonnade.functions.names import suggests_kpi
from colonnade.operators.schema import Profile
from colonnade.operators.statistics import mean_of
from colonnade.small import small_table


def kpi_values(profile: Profile) -> list[tuple[str, float]]:
    """Records, columns, missing cells, and the mean of the first telling measure or
    else the number of numeric columns."""
    facts = profile.facts
    numeric = profile.of_type("numeric")
    values: list[tuple[str, float]] = [
        ("Records", profile.row_count),
        ("Columns", len(facts)),
        ("Missing cells", sum(f["missing_count"] for f in facts)),
        ("Numeric columns", len(numeric)),
    ]
    telling = [f for f in numeric if f["numeric_valid"] and suggests_kpi(f["name"])]
    if telling:
        values[3] = (f"Average {telling[0]['name']}", mean_of(telling[0]))
    return values


def kpi_metrics(profile: Profile) -> DataFrame:
    rows = [
        (i, label, float(value), significant(value) if i == 3 and isinstance(value, float) else f"{value:,}")
        for i, (label, value) in enumerate(kpi_values(profile))
    ]
    return small_table(profile.ds.spark, 
        rows, "position int, label string, value double, shown string"
    )
