"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from colonnade.errors import DatasetError


_NOTED: list[list[str]] = []


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Note every place taken in the block in ``paths``, in order, for ``removed``."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED[:] = [n for n in _NOTED if n is not paths]


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="colonnade-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A temporary folder serves only a session
    whose executors all live in this process; a cluster must name a shared one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise DatasetError(
                "no_shared_folder", "Set spark.checkpoint.dir to a folder all executors share."
            )
        folder = _local_folder()
    return folder.rstrip("/")


def new_path(spark: SparkSession, paths: list[str] | None = None) -> str:
    """A fresh place for one table in the shared folder, noted in ``paths``."""
    path = f"{shared_folder(spark)}/colonnade-{uuid.uuid4().hex}"
    for noted in ([] if paths is None else [paths]) + [n for n in _NOTED if n is not paths]:
        noted.append(path)
    return path


def written(frame: DataFrame, paths: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Write once, read many times: cuts lineage and survives lost executors. The path is
    added to ``paths``, for ``removed`` to delete when the table is no longer needed. A
    table that reads back short (a folder that is not shared) is an error. ``by``: the last
    column, of which every value gets files of its own."""
    spark = frame.sparkSession
    path = new_path(spark, paths)
    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path, partitionBy=by)
    table = spark.read.schema(frame.schema).parquet(path)
    wanted, found = seen.get.get("rows", 0), table.count()
    if found != wanted:
        raise DatasetError(
            "scratch_incomplete", f"{path} holds {found} of {wanted} rows; is it shared?"
        )
    return table


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables this module wrote."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()
