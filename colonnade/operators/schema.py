"""Type inference and column metadata from value frequencies."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from colonnade.config import ProfileConfig
from colonnade.dataset import ROW, Dataset, spread
from colonnade.functions import percentage
from colonnade.functions.names import BOOLEAN_DIGITS, BOOLEAN_WORDS, suggests_boolean
from colonnade.operators.frequencies import COMPLETE, column_names, entry_start, entry_unsure, first_values, gathered
from colonnade.operators.frequencies import keyed_frequencies, parsed_frequencies, settled, top_values, whole_texts
from colonnade.scratch import removed, written
from colonnade.small import small_table

# Multiplying by this power of two is exact and keeps sums of huge values finite.
DOWN = 2.0**-128
# Below this magnitude the plain sum is exact enough and the scaled one underflows.
SMALL = 1e-200


def safe_sum(value: Column, weight: Column | None = None) -> Column:
    """``struct(plain, scaled, largest)`` from which ``total_of`` gives a sum that
    overflows only where the true sum does."""
    scaled = value * F.lit(DOWN)
    weighted = (value * weight, scaled * weight) if weight is not None else (value, scaled)
    return F.struct(
        F.sum(weighted[0]).alias("plain"),
        F.sum(weighted[1]).alias("scaled"),
        F.max(F.abs(value)).alias("largest"),
    )


def total_of(parts: Column, divisor: Column | None = None) -> Column:
    """Sum (or mean, with a divisor) out of ``safe_sum``; may be infinite."""
    plain, scaled = parts["plain"], parts["scaled"]
    if divisor is not None:
        plain, scaled = plain / divisor, scaled / divisor
    return F.when(parts["largest"] < SMALL, plain).otherwise(scaled * F.lit(1 / DOWN))


def column_counts(freq: DataFrame) -> DataFrame:
    """Everything type inference and the statistics need, one row per column.

    Distinct values are weighted by their count; the groups are the columns, and partial
    aggregation leaves one row per column and task to shuffle.
    """
    freq = freq.select(
        "position", "n", "x", "nanos", "cut", F.lower(entry_start()).alias("clean"), entry_unsure().alias("unsure"),
        # Of what is seen of an unsettled text no more than its beginning is known
        (F.col("cut") & F.col("start").isNull()).alias("open"),
    ).withColumn("blank", F.col("clean") == "")
    n, blank, x = F.col("n"), F.col("blank"), F.col("x")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")

    grouped = freq.groupBy("position").agg(
        F.sum(n).alias("rows"),
        rows_where(blank).alias("missing_count"),
        F.count_if(~blank).alias("unique_count"),
        rows_where(x.isNotNull()).alias("numeric_valid"),
        rows_where(F.col("nanos").isNotNull()).alias("datetime_valid"),
        F.count_if(~blank & (F.col("open") | ~F.col("clean").isin(*BOOLEAN_WORDS))).alias("not_word"),
        F.count_if(~blank & (F.col("open") | ~F.col("clean").isin(*BOOLEAN_DIGITS))).alias("not_digit"),
        F.count_if(F.col("cut")).alias("cut_count"),
        F.count_if(F.col("unsure")).alias("unsure_count"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
        safe_sum(x, n).alias("total"),
        F.min("nanos").alias("earliest_nanos"),
        F.max("nanos").alias("latest_nanos"),
    )
    return grouped


def detected_type(ds: Dataset, config: ProfileConfig) -> Column:
    """First rule that holds, over the counts of ``column_counts``."""
    hinted = [i for i, name in enumerate(ds.columns) if suggests_boolean(name)]
    present = F.col("rows") - F.col("missing_count")
    boolean = (F.col("not_word") == 0) | (
        (F.col("not_digit") == 0) & F.col("position").isin(hinted)
    )
    return (
        F.when(present == 0, "text")
        .when(boolean, "boolean")
        .when(F.col("numeric_valid") / present >= config.numeric_threshold, "numeric")
        .when(F.col("datetime_valid") / present >= config.datetime_threshold, "datetime")
        .when(F.col("unique_count") / present <= config.categorical_ratio, "categorical")
        .otherwise("text")
    )


class Profile:
    """A dataset with its written value frequencies and per-column counts.

    One pass over the data writes the frequencies; all that follows reads them. Only
    the rows of ``facts`` (at most 200) come to the driver, to plan further steps.
    """

    def __init__(
        self,
        ds: Dataset,
        config: ProfileConfig = ProfileConfig(),
        frozen_types: dict[str, str] | None = None,
    ):
        self.ds = ds
        self.config = config
        self.frozen_types = frozen_types
        self.paths: list[str] = []
        self._counted = written(parsed_frequencies(spread(ds)), self.paths)

    def _planned_counts(self) -> DataFrame:
        """One row per column, also for a table without rows."""
        ds = self.ds
        entries = small_table(
            ds.spark, [(i, name) for i, name in enumerate(ds.columns)], "position int, name string"
        )
        counters = [
            "rows", "missing_count", "unique_count", "numeric_valid", "datetime_valid",
            "not_word", "not_digit", "cut_count", "unsure_count",
        ]
        counted = entries.join(F.broadcast(column_counts(self._counted)), "position", "left")
        counted = counted.fillna(0, counters)
        if self.frozen_types is None:
            kind = detected_type(ds, self.config)
        else:
            types = [F.lit(self.frozen_types[name]) for name in ds.columns]
            kind = F.element_at(F.array(*types), F.col("position") + 1)
        share = percentage(F.col("missing_count"), F.col("rows"))
        return counted.withColumns({"detected_type": kind, "missing_percentage": share})

    @cached_property
    def facts(self) -> list[Row]:
        """The counts of at most 200 columns, in column order."""
        planned = self._planned_counts()
        rows = sorted(planned.collect(), key=lambda row: row["position"])
        if any(row["unsure_count"] for row in rows):
            self._counted = written(settled(self.ds, self._counted), self.paths)
            planned = self._planned_counts()
            rows = sorted(planned.collect(), key=lambda row: row["position"])
        self._schema = planned.schema
        return rows

    @property
    def freq(self) -> DataFrame:
        """The entries of all columns, once every long text is settled."""
        return self.all_counts.where(F.col("position") != COMPLETE)

    @property
    def all_counts(self) -> DataFrame:
        """``freq`` with the entry of complete rows."""
        self.facts
        return self._counted

    @cached_property
    def counts(self) -> DataFrame:
        """``facts`` as a table, to join without computing them again."""
        return small_table(self.ds.spark, self.facts, self._schema)

    @cached_property
    def rows(self) -> Dataset:
        """The rows with cells parsed as their column's type, for row-level operators.

        Text is parsed once and written as typed columns, so that every later scan reads
        just the columns it needs and no cell is parsed again. Tables whose numbers and
        dates are stored as such need no copy. Columns of type text take no part.
        """
        ds = self.ds
        parsed = {"numeric": ds.number, "datetime": ds.instant, "categorical": ds.label, "boolean": ds.label}
        kept = [f for f in self.facts if f["detected_type"] in parsed]
        if not any(ds.is_text(f["name"]) for f in kept if f["detected_type"] in ("numeric", "datetime")):
            return ds
        cells = [parsed[f["detected_type"]](f["name"]).alias(f["name"]) for f in kept]
        frame = written(spread(ds).frame.select(ROW, *cells), self.paths)
        types = {field.name: field.dataType for field in frame.schema.fields if field.name != ROW}
        return Dataset(frame, tuple(types), types)

    def _long_texts_of(self, facts: list[Row]) -> Dataset | None:
        """The dataset to fetch long texts from, None where the columns have none."""
        return self.ds if any(f["cut_count"] for f in facts) else None

    def values_of(self, facts: list[Row]) -> DataFrame:
        """The frequencies of some columns, each value whole."""
        chosen = self.freq.where(F.col("position").isin([f["position"] for f in facts]))
        source = self._long_texts_of(facts)
        return chosen if source is None else whole_texts(source, chosen)

    def top_values(self, facts: list[Row], limit: int = 10) -> DataFrame:
        """The most frequent values of some columns."""
        chosen = self.freq.where(F.col("position").isin([f["position"] for f in facts]))
        return top_values(chosen, limit, self._long_texts_of(facts))

    @cached_property
    def by_name(self) -> dict[str, Row]:
        return {fact["name"]: fact for fact in self.facts}

    @property
    def row_count(self) -> int:
        return self.facts[0]["rows"]

    def of_type(self, *kinds: str) -> list[Row]:
        return [fact for fact in self.facts if fact["detected_type"] in kinds]

    def release(self) -> None:
        """Delete the intermediate tables; lazy results of this profile end with them."""
        removed(self.ds.spark, self.paths)

    def valid_rows(self, fact: Row) -> int:
        """Rows whose cell parses as the column's type."""
        kind = fact["detected_type"]
        if kind in ("numeric", "datetime"):
            return fact[f"{kind}_valid"]
        return fact["rows"] - fact["missing_count"]


def type_table(profile: Profile) -> DataFrame:
    return profile.counts.select("position", "name", "detected_type")


def column_metadata(profile: Profile) -> DataFrame:
    """Type, missing count and share, distinct count and first values per column."""
    samples = gathered(
        first_values(profile.freq, profile.config.sample_size, profile._long_texts_of(profile.facts)), ["value"], "sample_values"
    )
    joined = profile.counts.join(F.broadcast(samples), "position", "left")
    return joined.select(
        "position",
        "name",
        "detected_type",
        "missing_count",
        "missing_percentage",
        "unique_count",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def sample_values(ds: Dataset, limit: int) -> DataFrame:
    """First distinct values per column in long form."""
    best = first_values(keyed_frequencies(ds), limit, ds)
    return best.select(column_names(ds).alias("name"), "rank", "value")
