"""Bounded records that plans exchange; all of them fit the driver by contract."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Recommendation:
    chart_type: str
    title: str
    x_column: str
    y_column: str | None
    aggregation: str
    reason: str
    score: float
    valid_rows: int


RECOMMENDATION_SCHEMA = (
    "position int, chart_type string, title string, x_column string, y_column string, "
    "aggregation string, reason string, score double, valid_rows bigint"
)


@dataclass(frozen=True)
class ChartData:
    """Points are ``(x, y)``; x is a number in scatter charts and a label elsewhere."""

    recommendation_index: int
    points: list[tuple[str | float, float]]
    note: str
    error: str | None = None


CHART_SCHEMA = "recommendation_index int, note string, error string"
POINT_SCHEMA = (
    "recommendation_index int, position int, x_label string, x_number double, y double"
)


@dataclass(frozen=True)
class Insight:
    type: str
    title: str
    description: str
    columns: list[str]
    evidence: dict[str, str | int | float | None] = field(default_factory=dict)
    severity: str = "info"


INSIGHT_SCHEMA = (
    "position int, type string, title string, description string, severity string, "
    "columns array<string>, evidence map<string,string>"
)


def recommendation_rows(items: list[Recommendation]) -> list[tuple]:
    return [
        (i, r.chart_type, r.title, r.x_column, r.y_column, r.aggregation, r.reason, r.score, r.valid_rows)
        for i, r in enumerate(items)
    ]


def point_rows(charts: list[ChartData]) -> list[tuple]:
    return [
        (c.recommendation_index, i, x if isinstance(x, str) else None,
         None if isinstance(x, str) else float(x), y)
        for c in charts
        for i, (x, y) in enumerate(c.points)
    ]


def insight_rows(items: list[Insight]) -> list[tuple]:
    def shown(value):
        return None if value is None else str(value)

    return [
        (i, s.type, s.title, s.description, s.severity, s.columns,
         {key: shown(value) for key, value in s.evidence.items()})
        for i, s in enumerate(items)
    ]
