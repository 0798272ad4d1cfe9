"""Search, natural sort and paging over whole tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.dataset import ROW, Dataset
from colonnade.errors import DatasetError
from colonnade.functions import is_blank, natural_key
from colonnade.operators.order import RANGE, place_in, ranged
from colonnade.scratch import removed

PAGE_SIZES = (10, 25, 50)
TOP_ROWS = 10_000
PLACE = "_place"


def search(ds: Dataset, text: str) -> Dataset:
    """Rows in which some cell contains the text, ignoring case."""
    needle = text.strip().lower()
    hits = (F.lower(F.coalesce(ds.text(n), F.lit(""))).contains(needle) for n in ds.columns)
    return ds.where(reduce(lambda a, b: a | b, hits))


def natural_order(ds: Dataset, column: str, descending: bool = False) -> list:
    """Blank cells last in both directions, ties in source order."""
    text = F.coalesce(ds.text(column), F.lit(""))
    key = natural_key(text)
    return [is_blank(text).asc(), key.desc() if descending else key.asc(), F.asc(ROW)]


def sorted_rows(ds: Dataset, column: str, descending: bool = False) -> DataFrame:
    return ds.frame.orderBy(*natural_order(ds, column, descending))


def page(
    ds: Dataset,
    number: int,
    size: int = 10,
    sort_by: str | None = None,
    descending: bool = False,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """One page (0-based) of the sorted or source-ordered rows; a number past the last page
    gives the last.

    Pages among the first ``top_rows`` rows are a distributed top-k. Later ones come from a
    ``page_index``; who opens several keeps the index and asks it.
    """
    _check_page(number, size)
    number = min(number, page_count(ds, size) - 1)
    order = natural_order(ds, sort_by, descending) if sort_by else [F.asc(ROW)]
    if (number + 1) * size <= top_rows:
        return ds.frame.orderBy(*order).offset(number * size).limit(size)
    return page_index(ds, sort_by, descending).page(number, size)


def page_count(ds: Dataset, size: int = 10) -> int:
    """Pages of the table; an empty one has one."""
    return max(1, -(-ds.frame.count() // size))


@dataclass(frozen=True)
class PageIndex:
    """A table in written blocks of one order, with the rows of each block. A page reads the
    blocks it lies in, one or two as a rule, and writes nothing."""

    blocks: DataFrame
    counts: dict[int, int]
    order: list
    paths: list[str]

    @property
    def rows(self) -> int:
        return sum(self.counts.values())

    def page(self, number: int, size: int = 10) -> DataFrame:
        """A page (0-based); a number past the last page gives the last."""
        _check_page(number, size)
        start = min(number, max(0, -(-self.rows // size) - 1)) * size
        before, met = 0, {}
        for block in sorted(self.counts):
            if before < start + size and before + self.counts[block] > start:
                met[block] = before
            before += self.counts[block]
        placed = self.blocks.where(F.col(RANGE).isin(list(met)))
        placed = placed.withColumn(PLACE, place_in(placed, met, self.order))
        wanted = placed.where((F.col(PLACE) >= start) & (F.col(PLACE) < start + size))
        return wanted.orderBy(PLACE).drop(RANGE, PLACE)

    def release(self) -> None:
        """Delete the blocks; pages of the index end with them."""
        removed(self.blocks.sparkSession, self.paths)


def page_index(ds: Dataset, sort_by: str | None = None, descending: bool = False) -> PageIndex:
    """Sort the table once, for any number of pages."""
    order = natural_order(ds, sort_by, descending) if sort_by else [F.asc(ROW)]
    paths: list[str] = []
    blocks, counts = ranged(ds.frame, order, paths, apart=True)
    return PageIndex(blocks, counts, order, paths)


def _check_page(number: int, size: int) -> None:
    if size not in PAGE_SIZES or number < 0:
        raise DatasetError("invalid_page", f"Page sizes are {PAGE_SIZES}; pages start at 0.")
