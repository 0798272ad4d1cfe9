"""From recommendations to chart points with notes."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import functions as F

from colonnade import config as C
from colonnade.functions.labels import short
from colonnade.operators import charts
from colonnade.operators.schema import Profile
from colonnade.plans.records import ChartData, Recommendation
from colonnade.small import together

# Notes shown under the charts.
NOTE_EMPTY = "No valid rows are available for this chart."
NOTE_CATEGORY = "All valid rows; original category labels are preserved."
NOTE_LINE = "All valid rows grouped into observed UTC {unit}; empty periods are omitted."
NOTE_HISTOGRAM = "Equal-width bins cover all valid values; the final bin includes its upper bound."
NOTE_ONE_BIN = "All selected values fall into one representable bin."
NOTE_SAMPLE = "Showing {shown:,} of {total:,} valid pairs, evenly spaced in source order."
NOTE_ALL_PAIRS = "All {total:,} valid pairs."
ERROR_RANGE = "Values exceed the supported numeric range for this chart."
ERROR_SIZE = f"The chart has more than {C.MAX_POINTS} points."


def _points(profile: Profile, item: Recommendation) -> tuple[list[tuple], str]:
    x, y = item.x_column, item.y_column
    if item.chart_type == "scatter":
        frame, total = charts.scatter_sample(
            profile.rows, x, y, profile.config.rank_buffer, profile.paths
        )
        rows = frame.orderBy("position").collect()
        note = NOTE_SAMPLE if total > C.MAX_POINTS else NOTE_ALL_PAIRS
        return [(r["x"], r["y"]) for r in rows], note.format(shown=len(rows), total=total)
    if item.chart_type == "histogram":
        fact = profile.by_name[x]
        if not fact["numeric_valid"]:
            return [], NOTE_EMPTY
        if charts.is_one_bin(fact):
            first = charts.first_number(profile, x)
            return [(short(first), float(fact["numeric_valid"]))], NOTE_ONE_BIN
        rows = charts.histogram(profile, x).orderBy("position").collect()
        return [(charts.point_label(r["lower"], r["upper"]), r["y"]) for r in rows], NOTE_HISTOGRAM
    if item.chart_type == "line":
        frame, unit = charts.line_chart(profile, x, y, item.aggregation)
        order, note = [F.asc("x")], NOTE_LINE.format(unit=unit)
    else:
        frame = charts.category_chart(profile, x, y, item.aggregation)
        order = [F.desc("y"), F.asc("x")] if item.chart_type == "bar" else [F.asc("x")]
        note = NOTE_CATEGORY
    rows = frame.orderBy(*order).limit(C.MAX_POINTS + 1).collect()
    return [(r["x"], r["y"]) for r in rows], note


def prepare_chart(profile: Profile, index: int, item: Recommendation) -> ChartData:
    points, note = _points(profile, item)
    if not points:
        return ChartData(index, [], NOTE_EMPTY)
    if len(points) > C.MAX_POINTS:
        return ChartData(index, [], "", ERROR_SIZE)
    if not all(math.isfinite(y) for _, y in points):
        return ChartData(index, [], "", ERROR_RANGE)
    return ChartData(index, points, note)


def prepare_charts(profile: Profile, items: list[Recommendation]) -> list[ChartData]:
    return together([partial(prepare_chart, profile, i, item) for i, item in enumerate(items)])
