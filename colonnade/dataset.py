"""A table seen through the text rules: columns, source order, parsed views."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import config as C
from colonnade.errors import DatasetError
from colonnade.functions import instant_from_text, is_blank, number_from_text
from colonnade.functions.numbers import finite_or_null

ROW = "_row"


# Days, months and zone-less texts are UTC throughout. The code size limit is the size up
# to which the JVM compiles a method; without it, wide parsing stages run interpreted.
SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepared(spark: SparkSession) -> SparkSession:
    for key, value in SESSION.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def validate_names(names: list[str]) -> list[str]:
    """Trimmed, non-blank, unique names within the width and length limits."""
    trimmed = [name.strip() for name in names]
    if not trimmed or not all(trimmed):
        raise DatasetError("missing_header", "Every column needs a name.")
    if len(trimmed) > C.MAX_COLUMNS or any(len(n) > C.MAX_NAME_LENGTH for n in trimmed):
        raise DatasetError(
            "unsupported_dataset",
            f"At most {C.MAX_COLUMNS} columns with names of at most "
            f"{C.MAX_NAME_LENGTH} characters are supported.",
        )
    if len(set(trimmed)) != len(trimmed):
        raise DatasetError("duplicate_headers", "Two columns have the same name.")
    return trimmed


@dataclass(frozen=True)
class Dataset:
    """User columns plus ``_row``, a unique BIGINT that gives the source order.

    Columns may be text or typed. A typed numeric or timestamp column keeps its type,
    so filters on it reach the file scan; its text is the cast to string.
    """

    frame: DataFrame
    columns: tuple[str, ...]
    types: dict[str, T.DataType] = field(repr=False, default_factory=dict)
    # The same rows without ``_row`` where that is only the order of the scan.
    source: DataFrame | None = field(repr=False, default=None)

    @staticmethod
    def from_table(
        frame: DataFrame, order_by: str | Column | None = None, columns: list[str] | None = None
    ) -> "Dataset":
        """Wrap any DataFrame. ``order_by`` must be a unique integer key; without it the
        order of the scan is used."""
        prepared(frame.sparkSession)
        names = columns or [c for c in frame.columns if c != ROW]
        if ROW in names:
            raise DatasetError("reserved_name", f"The name {ROW} is reserved.")
        validate_names(names)
        types = {f.name: f.dataType for f in frame.schema.fields if f.name in names}
        if order_by is None:
            return Dataset._scanned(frame.select(*(quoted(n) for n in names)), tuple(names), types)
        key = (quoted(order_by) if isinstance(order_by, str) else order_by).cast("bigint")
        shaped = frame.select(key.alias(ROW), *(quoted(name) for name in names))
        return Dataset(shaped, tuple(names), types)

    @staticmethod
    def _scanned(source: DataFrame, names: tuple[str, ...], types: dict) -> "Dataset":
        numbered = source.select(
            F.monotonically_increasing_id().alias(ROW), *(quoted(name) for name in names)
        )
        return Dataset(numbered, names, types, source)

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    def check(self, name: str) -> str:
        if name not in self.types:
            raise DatasetError("unknown_column", f"There is no column named {name!r}.")
        return name

    def is_text(self, name: str) -> bool:
        return isinstance(self.types[self.check(name)], T.StringType)

    def text(self, name: str) -> Column:
        """The cell as text, as every rule sees it."""
        kind = self.types[self.check(name)]
        column = quoted(name)
        if isinstance(kind, T.StringType):
            return column
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(column)
        return column.cast("string")

    def present(self, name: str) -> Column:
        """True where the cell is not missing."""
        if self.is_text(name):
            return ~is_blank(self.text(name))
        return quoted(name).isNotNull()

    def label(self, name: str) -> Column:
        """The raw text of non-missing cells, null elsewhere."""
        return F.when(self.present(name), self.text(name))

    def number(self, name: str) -> Column:
        """Finite double or null. Typed columns skip the text parse; floats do not,
        because their text names another double than their binary widening."""
        kind = self.types[self.check(name)]
        if isinstance(kind, (T.IntegralType, T.DecimalType)):
            return quoted(name).cast("double")
        if isinstance(kind, T.DoubleType):
            return finite_or_null(quoted(name))
        return number_from_text(self.text(name))

    def instant(self, name: str) -> Column:
        """UTC timestamp or null."""
        kind = self.types[self.check(name)]
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return quoted(name).cast("timestamp")
        return instant_from_text(self.text(name))

    def where(self, predicate: Column) -> "Dataset":
        if self.source is not None:
            # Below the numbering, where the predicate can still reach the file scan.
            return Dataset._scanned(self.source.where(predicate), self.columns, self.types)
        return Dataset(self.frame.where(predicate), self.columns, self.types)

    def select(self, names: list[str]) -> "Dataset":
        kept = [self.check(name) for name in names]
        frame = self.frame.select(ROW, *(quoted(name) for name in kept))
        return Dataset(frame, tuple(kept), {name: self.types[name] for name in kept})

    def preview(self, limit: int = C.PREVIEW_ROWS) -> DataFrame:
        """The first rows in source order, as text with missing cells empty."""
        cells = [F.coalesce(self.text(name), F.lit("")).alias(name) for name in self.columns]
        return self.frame.select(ROW, *cells).orderBy(ROW).limit(limit)


def spread(ds: Dataset) -> Dataset:
    """Shuffle rows over all cores when the source has too few splits to occupy them
    (one unsplittable file, say). Tables with enough splits are left as they are, and so
    are those that come out of a shuffle already."""
    if ds.frame._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return ds
    cores = ds.spark.sparkContext.defaultParallelism
    if ds.frame.rdd.getNumPartitions() * 2 > cores:
        return ds
    return Dataset(ds.frame.repartition(cores, ROW), ds.columns, ds.types)


def parsing(ds: Dataset, names: list[str | None]) -> Dataset:
    """``spread`` where one of the columns is text that has to be parsed."""
    return spread(ds) if any(n and ds.is_text(n) for n in names) else ds
