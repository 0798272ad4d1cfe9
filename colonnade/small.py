"""Small driver-side tables as local relations, which join without a job of their own."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(
    spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType
) -> DataFrame:
    """For rows bounded by columns, bins, points or caps; never for data."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records = [
        dict(zip(struct.names, row.asDict(True).values() if isinstance(row, T.Row) else row))
        for row in rows
    ]
    table = pa.Table.from_pylist(records, schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, schema=struct)


def together(actions: list[Callable]) -> list:
    """Results of independent Spark actions, submitted at the same time so that short
    jobs do not leave the cluster idle."""
    with ThreadPoolExecutor(max_workers=max(1, min(8, len(actions)))) as pool:
        return [future.result() for future in [pool.submit(action) for action in actions]]
