"""Ranking of suitable charts. Spark counts pairs; the rules see at most 200 columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade import config as C
from colonnade.functions.names import aggregation_hint, suggests_additive, suggests_identifier
from colonnade.operators.pairs import Operand, pair_facts
from colonnade.operators.schema import Profile
from colonnade.plans.records import RECOMMENDATION_SCHEMA, Recommendation, recommendation_rows
from colonnade.small import small_table

# Suitability before coverage is added.
BASE_SCORE = {
    "line_count": 0.58,
    "line": 0.65,
    "donut": 0.54,
    "bar_count": 0.50,
    "bar": 0.60,
    "histogram": 0.50,
    "scatter": 0.55,
}
# Titles and reason texts.
TITLES = {
    "scatter": "{y} vs {x}",
    "histogram": "Distribution of {x}",
    "measure": "{how} {y} by {x}",
    "count": "Records by {x}",
}
REASONS = {
    "line_count": "A datetime column supports record frequency over time.",
    "line": "Datetime and numeric columns support a time series ({how} aggregation).",
    "donut": "{size} categories support a readable frequency comparison.",
    "bar_count": "{size} categories support a readable frequency comparison.",
    "bar": "{size} categories support grouped {how} values.",
    "histogram": "A varying numeric column supports a distribution histogram.",
    "scatter": "Two numeric columns support a relationship plot without implying causation.",
}
REASON_SUFFIX = (
    " Uses {rows:,} valid rows; confidence describes chart suitability, "
    "not statistical significance."
)
KIND_OF = {
    "numeric": "numeric",
    "datetime": "datetime",
    "categorical": "categorical",
    "boolean": "categorical",
}
KIND_LIMIT = {
    "numeric": C.PAIR_NUMERIC,
    "categorical": C.PAIR_CATEGORICAL,
    "datetime": C.PAIR_DATETIME,
}


def _varies(fact) -> bool:
    kind = fact["detected_type"]
    if kind == "numeric":
        return fact["minimum"] != fact["maximum"]
    if kind == "datetime":
        return fact["earliest_nanos"] != fact["latest_nanos"]
    return fact["unique_count"] > 1


def candidates(profile: Profile) -> dict[str, list]:
    """Columns worth charting per kind: most valid rows first, then additive measures,
    then source order; 8 numeric, 8 categorical and 4 datetime ones at most."""
    kept: dict[str, list] = {kind: [] for kind in KIND_LIMIT}
    for fact in profile.facts:
        kind = KIND_OF.get(fact["detected_type"])
        present = fact["rows"] - fact["missing_count"]
        is_key = fact["unique_count"] / max(present, 1) >= 0.9
        if kind is None or (suggests_identifier(fact["name"]) and is_key):
            continue
        if profile.valid_rows(fact) >= 2 and _varies(fact):
            kept[kind].append(fact)
    for kind, facts in kept.items():
        facts.sort(key=lambda f: (-profile.valid_rows(f), not suggests_additive(f["name"])))
        kept[kind] = facts[: KIND_LIMIT[kind]]
    return kept


def candidate_columns(profile: Profile) -> DataFrame:
    rows = [
        (kind, rank, fact["name"], profile.valid_rows(fact))
        for kind, facts in candidates(profile).items()
        for rank, fact in enumerate(facts)
    ]
    return small_table(profile.ds.spark, 
        rows, "kind string, rank int, name string, valid_rows bigint"
    )


def category_labels(profile: Profile, facts: list) -> dict[str, tuple[str, ...]]:
    """All values of columns that have at most 30 of them."""
    if not facts:
        return {}
    rows = profile.top_values(facts, C.MAX_CHART_CATEGORIES).collect()
    return {
        f["name"]: tuple(r["value"] for r in rows if r["position"] == f["position"]) for f in facts
    }


@dataclass(frozen=True)
class PairFact:
    valid_rows: int
    usable: bool
    pearson_r: float | None


def collect_pairs(
    profile: Profile, operands: list[Operand], pairs: list[tuple[str, str]]
) -> dict[tuple[str, str], PairFact]:
    """Pair facts by column names; pairs that never meet are absent."""
    if not pairs:
        return {}
    place = {operand.name: i for i, operand in enumerate(operands)}
    indexed = [(place[x], place[y]) for x, y in pairs]
    rows = pair_facts(profile.rows, operands, indexed).collect()
    return {
        pairs[row["pair"]]: PairFact(
            row["valid_rows"],
            row["valid_rows"] >= 2 and row["x_varies"] and row["y_varies"],
            row["pearson_r"],
        )
        for row in rows
    }


def chart_pairs(kept: dict[str, list]) -> list[tuple[str, str]]:
    """Date-number, category-number and number-number pairs of the candidates."""
    numbers = [f["name"] for f in kept["numeric"]]
    readable = [f for f in kept["categorical"] if f["unique_count"] <= C.MAX_CHART_CATEGORIES]
    sides = [f["name"] for f in kept["datetime"] + readable]
    crossed = [(side, number) for side in sides for number in numbers]
    return crossed + [(x, y) for i, x in enumerate(numbers) for y in numbers[i + 1 :]]


def chart_operands(profile: Profile, kept: dict[str, list]) -> list[Operand]:
    readable = [f for f in kept["categorical"] if f["unique_count"] <= C.MAX_CHART_CATEGORIES]
    labels = category_labels(profile, readable)
    return (
        [Operand(f["name"], "datetime") for f in kept["datetime"]]
        + [Operand(f["name"], "categorical", labels[f["name"]]) for f in readable]
        + [Operand(f["name"], "numeric") for f in kept["numeric"]]
    )


def _title(rule: str, x: str, y: str | None, how: str) -> str:
    if rule == "scatter" or rule == "histogram":
        return TITLES[rule].format(x=x, y=y)
    return TITLES["measure" if y else "count"].format(x=x, y=y, how=how.title())


def build(
    profile: Profile, kept: dict[str, list], facts: dict[tuple[str, str], PairFact]
) -> list[Recommendation]:
    """Score all candidates and keep the best six, two per chart type at most."""
    total = profile.row_count
    found: list[Recommendation] = []

    def offer(rule: str, x: str, y: str | None, how: str, rows: int, size: int = 0) -> None:
        coverage = 0.2 * rows / total + 0.1 * min(rows / 30, 1)
        score = min(1.0, BASE_SCORE[rule] + coverage + 0.05 * (how == "sum"))
        reason = REASONS[rule].format(how=how, size=size) + REASON_SUFFIX.format(rows=rows)
        found.append(
            Recommendation(
                rule.removesuffix("_count"), _title(rule, x, y, how), x, y, how, reason,
                round(score, 4), rows,
            )
        )

    def offer_pair(rule: str, x: str, y: str, how: str, size: int = 0) -> None:
        fact = facts.get((x, y))
        if fact and fact.usable:
            offer(rule, x, y, how, fact.valid_rows, size)

    numbers = [f["name"] for f in kept["numeric"]]
    for fact in kept["datetime"]:
        offer("line_count", fact["name"], None, "count", profile.valid_rows(fact))
        for number in numbers:
            offer_pair("line", fact["name"], number, aggregation_hint(number))
    for fact in kept["categorical"]:
        size = fact["unique_count"]
        if size > C.MAX_CHART_CATEGORIES:
            continue
        rule = "donut" if size <= C.MAX_DONUT_CATEGORIES else "bar_count"
        offer(rule, fact["name"], None, "count", profile.valid_rows(fact), size)
        for number in numbers:
            offer_pair("bar", fact["name"], number, aggregation_hint(number), size)
    for fact in kept["numeric"]:
        offer("histogram", fact["name"], None, "count", profile.valid_rows(fact))
    for i, x in enumerate(numbers):
        for y in numbers[i + 1 :]:
            offer_pair("scatter", x, y, "none")

    found.sort(key=lambda item: -item.score)
    chosen: list[Recommendation] = []
    for item in found:
        same = sum(other.chart_type == item.chart_type for other in chosen)
        if same < C.MAX_CHARTS_PER_TYPE and len(chosen) < C.MAX_CHARTS:
            chosen.append(item)
    return chosen


def recommend(profile: Profile) -> list[Recommendation]:
    if profile.row_count < 2:
        return []
    kept = candidates(profile)
    facts = collect_pairs(profile, chart_operands(profile, kept), chart_pairs(kept))
    return build(profile, kept, facts)


def recommendations_table(profile: Profile, items: list[Recommendation]) -> DataFrame:
    return small_table(profile.ds.spark, recommendation_rows(items), RECOMMENDATION_SCHEMA)


def recounted(items: list[Recommendation], counts: list[int]) -> list[Recommendation]:
    """The same charts with the valid rows of a filtered dataset."""
    # Fixed value: the reason shown under filters.
    reason = (
        "Chart selected from the original dataset. "
        "Values reflect filters; confidence is unchanged."
    )
    return [replace(r, valid_rows=n, reason=reason) for r, n in zip(items, counts, strict=True)]
