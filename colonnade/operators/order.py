"""Places of rows in an order over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.scratch import written

RANGE = "_range"


def ranged(
    frame: DataFrame, order: list[Column], paths: list[str] | None = None, apart: bool = False
) -> tuple[DataFrame, dict[int, int]]:
    """The rows in written ranges of the order (``_range``), so that the ranges stay the
    same, and the rows of each; one count per range comes to the driver. ``apart``: each
    range has files of its own, so that a few are read without the others."""
    marked = frame.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id())
    ranges = written(marked, paths, RANGE if apart else None)
    return ranges, dict(ranges.groupBy(RANGE).count().collect())


def place_in(ranges: DataFrame, before: dict[int, int], order: list[Column]) -> Column:
    """The place (from 0) of a row, given the rows before each range."""
    earlier = F.create_map(*(F.lit(v) for pair in (before or {-1: 0}).items() for v in pair))
    window = Window.partitionBy(RANGE).orderBy(*order)
    return F.element_at(earlier, F.col(RANGE)) + F.row_number().over(window) - 1


def positioned(frame: DataFrame, *order: Column, paths: list[str] | None = None) -> DataFrame:
    """Add ``position``, the place of every row in the order, however many there are."""
    ranges, counts = ranged(frame, list(order), paths)
    before, seen = {}, 0
    for part in sorted(counts):
        before[part] = seen
        seen += counts[part]
    return ranges.withColumn("position", place_in(ranges, before, list(order))).drop(RANGE)
