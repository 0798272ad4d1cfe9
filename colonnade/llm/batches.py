"""Row-wise work in Python over Arrow batches, cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text handled between two output batches.
PIECE = 4 << 20
#: Tasks of a stage whose groups are few bytes and much work; more groups share tasks.
MOST_TASKS = 20_000


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, sliced so that none holds much more than ``PIECE`` bytes of a column."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, rows * PIECE // max(size, 1))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def with_results(
    frame: DataFrame, column: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable], keep: list[str] | None = None
) -> DataFrame:
    """The frame (or its columns ``keep``) with further columns. ``make()`` runs once per
    task and returns a function from the list of values of ``column`` to one list per
    field. Columns of the frame with the name of a field are replaced."""
    names = [name for name, _ in fields]
    kept = [c for c in (frame.columns if keep is None else keep) if c not in names]
    schema = T.StructType(
        [T.StructField(f"c{i}", frame.schema[c].dataType) for i, c in enumerate(kept)]
        + [T.StructField(f"r{i}", kind) for i, (_, kind) in enumerate(fields)]
    )
    kinds = [to_arrow_type(kind) for _, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in pieces(batches, "given"):
            made = work(piece.column(len(kept)).to_pylist())
            arrays = [piece.column(i) for i in range(len(kept))]
            arrays += [pa.array(list(v), kind) for v, kind in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    needed = [frame[quoted(c)].alias(f"c{i}") for i, c in enumerate(kept)]
    given = frame.select(*needed, frame[quoted(column)].alias("given"))
    return given.mapInArrow(run, schema).toDF(*kept, *names)


def quoted(name: str) -> str:
    """A column name that is taken as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"
