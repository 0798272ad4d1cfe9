"""The whole dashboard of a dataset, and the same dashboard under filters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.config import ProfileConfig
from colonnade.dataset import Dataset
from colonnade.operators import filters, kpi, statistics
from colonnade.operators.schema import Profile, column_metadata
from colonnade.plans import charts, insights, recommend
from colonnade.plans.records import CHART_SCHEMA, POINT_SCHEMA, ChartData, Insight
from colonnade.plans.records import Recommendation, point_rows
from colonnade.small import small_table, together


@dataclass
class Analysis:
    """Lazy tables plus the bounded records already computed."""

    profile: Profile
    recommendations: list[Recommendation]
    charts: list[ChartData]
    insights: list[Insight]
    original: "Analysis | None" = field(default=None, repr=False)

    @property
    def dataset(self) -> Dataset:
        return self.profile.ds

    @property
    def row_count(self) -> int:
        return self.profile.row_count

    def preview(self) -> DataFrame:
        return self.dataset.preview()

    def release(self) -> None:
        """Delete the intermediate tables; lazy results of this analysis end with them."""
        self.profile.release()

    @cached_property
    def metadata(self) -> DataFrame:
        return column_metadata(self.profile)

    @cached_property
    def statistics(self) -> DataFrame:
        return statistics.column_statistics(self.profile)

    @cached_property
    def summary(self) -> DataFrame:
        return statistics.dataset_summary(self.profile)

    @cached_property
    def filter_fields(self) -> DataFrame:
        return filters.filter_fields(self.profile)

    @cached_property
    def fields(self) -> dict[str, tuple[str, list[str]]]:
        return {r["name"]: (r["kind"], r["values"]) for r in self.filter_fields.collect()}

    def kpis(self) -> DataFrame:
        return kpi.kpi_metrics(self.profile)

    def recommendation_table(self) -> DataFrame:
        return recommend.recommendations_table(self.profile, self.recommendations)

    def chart_table(self) -> DataFrame:
        rows = [(c.recommendation_index, c.note, c.error) for c in self.charts]
        return small_table(self.dataset.spark, rows, CHART_SCHEMA)

    def point_table(self) -> DataFrame:
        return small_table(self.dataset.spark, point_rows(self.charts), POINT_SCHEMA)

    def insight_table(self) -> DataFrame:
        return insights.insights_table(self.profile, self.insights)

    def filter(self, rules: list[filters.Rule]) -> "Analysis":
        """Recompute everything for the rows that pass all rules.

        Types and the choice of charts stay those of the unfiltered dataset.
        """
        base = self.original or self
        filters.validate(rules, base.fields)
        types = {f["name"]: f["detected_type"] for f in base.profile.facts}
        subset = filters.filtered(base.dataset, rules)
        profile = Profile(subset, base.profile.config, types)
        profile.rows  # Written before the actions below share it.
        counts, points, found = together(
            [
                lambda: valid_row_counts(profile, base.recommendations),
                lambda: charts.prepare_charts(profile, base.recommendations),
                lambda: insights.generate_insights(profile),
            ]
        )
        kept = recommend.recounted(base.recommendations, counts)
        return Analysis(profile, kept, points, found, base)


def valid_row_counts(profile: Profile, items: list[Recommendation]) -> list[int]:
    """Rows valid on all axes of each chart, in one scan."""
    if not items:
        return []
    ds = profile.rows

    def axis(item: Recommendation):
        if item.chart_type in ("scatter", "histogram"):
            return ds.number(item.x_column).isNotNull()
        if item.chart_type == "line":
            return ds.instant(item.x_column).isNotNull()
        return ds.present(item.x_column)

    tests = [
        axis(r) & ds.number(r.y_column).isNotNull() if r.y_column else axis(r) for r in items
    ]
    row = ds.frame.agg(*(F.count_if(t).alias(f"c{i}") for i, t in enumerate(tests))).first()
    return list(row)


def analyze(ds: Dataset, config: ProfileConfig = ProfileConfig()) -> Analysis:
    """Profile, recommend, chart and find insights.

    Recommendations and correlations share one scan over the rows.
    """
    profile = Profile(ds, config)
    if profile.row_count == 0:
        return Analysis(profile, [], [], [])
    kept = recommend.candidates(profile) if profile.row_count >= 2 else {}
    order = insights.numeric_order(profile)
    measured = insights.numeric_operands(order)
    known = {operand.name for operand in measured}
    others = [o for o in recommend.chart_operands(profile, kept) if o.name not in known] if kept else []
    pairs = list(dict.fromkeys(
        (recommend.chart_pairs(kept) if kept else []) + insights.numeric_pairs(order)
    ))
    facts = recommend.collect_pairs(profile, measured + others, pairs)
    chosen = recommend.build(profile, kept, facts) if kept else []
    profile.rows  # Written before the actions below share it.
    points, found = together(
        [
            lambda: charts.prepare_charts(profile, chosen),
            lambda: insights.generate_insights(profile, facts),
        ]
    )
    return Analysis(profile, chosen, points, found)
