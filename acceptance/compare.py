"""Run a query and its SQL side by side: ``python -m acceptance.compare FOLDER [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from acceptance.oracle import ORACLE
from acceptance.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return str(value)


def _rows(records: list[dict]) -> list[tuple]:
    plain = [tuple((k, _plain(r[k])) for k in sorted(r)) for r in records]
    return sorted(plain, key=repr)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def difference(spark: SparkSession, folder: str, name: str, connection) -> str | None:
    """None when both engines agree."""
    got = _rows([row.asDict() for row in QUERIES[name](spark, folder).collect()])
    if name not in ORACLE:
        return None if got else "no rows"
    cursor = connection.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    wanted = _rows([dict(zip(names, row)) for row in cursor.fetchall()])
    if got == wanted:
        return None
    extra = [r for r in got if r not in set(wanted)][:2]
    absent = [r for r in wanted if r not in set(got)][:2]
    return f"{len(got)} rows against {len(wanted)}; only Spark: {extra}; only SQL: {absent}"


def main(folder: str, *chosen: str) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    for name in chosen or QUERIES:
        start = time.time()
        try:
            found = difference(spark, folder, name, connection)
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if name in ORACLE else "rows only"
        print(f"{'ok ' if found is None else 'BAD'} {name} ({kind}, {time.time() - start:.1f} s) {found or ''}")


if __name__ == "__main__":
    main(*sys.argv[1:])
