"""Saved analyses as four tables, their constraints, and the reads over them."""

from __future__ import annotations

import datetime
import hashlib
import random
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade import config as C
from colonnade.errors import DatasetError
from colonnade.operators.statistics import TYPES
from colonnade.plans.analysis import Analysis
from colonnade.plans.records import RECOMMENDATION_SCHEMA
from colonnade.scratch import removed
from colonnade.small import small_table

DATASETS = (
    "dataset_id string, project_id string, filename string, file_size bigint, "
    "row_count bigint, column_count int, created_at timestamp"
)
COLUMNS = (
    "dataset_id string, position int, name string, detected_type string, nullable boolean, "
    "missing_count bigint, missing_percentage double, unique_count bigint, "
    "sample_values array<string>"
)
VISUALIZATIONS = "dataset_id string, project_id string, " + RECOMMENDATION_SCHEMA
INSIGHTS = (
    "dataset_id string, project_id string, position int, type string, title string, "
    "description string, severity string, columns array<string>, evidence map<string,string>"
)
TABLES = {
    "dataset_columns": COLUMNS,
    "visualizations": VISUALIZATIONS,
    "insights": INSIGHTS,
    "datasets": DATASETS,
}
PAGE_SIZE = 12
VERSION = "version"
CLAIMS = "_claims"
#: Times a save looks again whether another one has withdrawn, and the longest wait between.
CLAIM_TRIES, CLAIM_WAIT_S = 8, 0.4
# Kinds of charts and of findings.
CHART_TYPES = ("bar", "donut", "histogram", "line", "scatter")
SEVERITIES = ("info", "warning")


def column_rows(metadata: DataFrame, dataset_id: Column) -> DataFrame:
    """Catalog rows of a dataset's columns."""
    return metadata.select(
        dataset_id.alias("dataset_id"), "position", "name", "detected_type",
        (F.col("missing_count") > 0).alias("nullable"), "missing_count",
        "missing_percentage", "unique_count", "sample_values",
    )


def violations(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """``(rule, dataset_id, n)`` for every broken catalog constraint.

    Keys are counted with partial aggregation, so the checks hold for large catalogs."""

    def found(rule: str, frame: DataFrame) -> DataFrame:
        return frame.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(rule).alias("rule"), "dataset_id", "n"
        )

    def repeated(frame: DataFrame, *keys: str) -> DataFrame:
        counted = frame.groupBy("dataset_id", *keys).agg(F.count(F.lit(1)).alias("times"))
        return counted.where(F.col("times") > 1)

    known = F.col("detected_type").isin(*TYPES)
    width = F.col("column_count")
    per_project = datasets.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("times"), F.min("dataset_id").alias("dataset_id")
    )
    checks = [
        found("unknown_type", columns.where(~known | F.col("detected_type").isNull())),
        found("negative_count", columns.where((F.col("missing_count") < 0) | (F.col("unique_count") < 0))),
        found("repeated_position", repeated(columns, "position")),
        found("repeated_name", repeated(columns, "name")),
        found("no_rows", datasets.where(F.col("row_count") <= 0)),
        found("column_count", datasets.where(~width.between(1, C.MAX_COLUMNS))),
        found("repeated_project", per_project.where(F.col("times") > 1)),
    ]
    return reduce(DataFrame.unionByName, checks)


def without_dataset(candidates: DataFrame, datasets: DataFrame) -> DataFrame:
    """Candidates whose project has no dataset yet (one dataset per project)."""
    return candidates.join(datasets.select("project_id"), "project_id", "left_anti")


def owned(children: DataFrame, projects: DataFrame, owner) -> DataFrame:
    """Rows of any project table that belong to projects of one owner."""
    mine = projects.where(F.col("owner_id") == owner).select("project_id")
    return children.join(mine, "project_id", "left_semi")


def project_page(projects: DataFrame, datasets: DataFrame, owner, page: int) -> DataFrame:
    """One page (1-based) of an owner's projects, newest first, with the details of
    their dataset if any and the exact number of projects.

    The page is cut before the join, so at most twelve projects meet the datasets.
    """
    mine = projects.where(F.col("owner_id") == owner)
    total = mine.agg(F.count(F.lit(1)).alias("total"))
    cut = (
        mine.orderBy(F.desc("updated_at"), F.asc("project_id"))
        .offset((page - 1) * PAGE_SIZE)
        .limit(PAGE_SIZE)
    )
    details = datasets.select("project_id", "filename", "row_count", "column_count")
    shown = details.join(F.broadcast(cut.select("project_id")), "project_id", "left_semi")
    return cut.join(shown, "project_id", "left").withColumn("total", total.scalar())


class Catalog:
    """Four Parquet tables below one folder, partitioned by dataset.

    A save writes the children under a version of their own and the dataset row last, which
    names the version. Readers see the children of the named versions only: a save is seen
    whole or not at all, also when it replaces an earlier one, and one that was cut short
    can be repeated. What no row names any more is removed by ``vacuum``.

    A project has one dataset, also under concurrent saves: each puts a claim of its dataset
    into the project's claim folder first and only then looks for others. Of two saves at
    least the later sees the other's claim, so both can never go on; a save that sees one
    withdraws, looks again some times and fails. This needs listings that show what was
    written before, but no exclusive creation.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _table(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{TABLES[table]}, {VERSION} string").parquet(self.path(table))
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return small_table(self.spark, [], f"{TABLES[table]}, {VERSION} string")

    def table(self, table: str) -> DataFrame:
        """Rows of completely saved datasets."""
        rows = self._table(table)
        if table != "datasets":
            named = self._table("datasets").select("dataset_id", VERSION)
            rows = rows.join(named, ["dataset_id", VERSION], "left_semi")
        return rows.drop(VERSION)

    def _write(self, rows: DataFrame, table: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        keys = ["dataset_id"] if table == "datasets" else ["dataset_id", VERSION]
        writer.partitionBy(*keys).parquet(self.path(table))

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _claim(self, project_id: str, dataset_id: str) -> str:
        project, dataset = (hashlib.sha256(i.encode()).hexdigest() for i in (project_id, dataset_id))
        return f"{self.folder}/{CLAIMS}/{project}/{dataset}"

    def _alone(self, claim: str) -> bool:
        """Put the claim; whether no other dataset claims the project."""
        place, files = self._files(claim)
        files.create(place, True).close()
        return all(s.getPath().getName() == place.getName() for s in files.listStatus(place.getParent()))

    @contextmanager
    def _claimed(self, project_id: str, dataset_id: str) -> Iterator[None]:
        """Hold the project for the dataset; the claim stays once the block is through."""
        claim = self._claim(project_id, dataset_id)
        place, files = self._files(claim)
        held = files.exists(place)  # by an earlier save, which this one replaces
        try:
            for attempt in range(CLAIM_TRIES):
                if self._alone(claim):
                    break
                if attempt == CLAIM_TRIES - 1:
                    raise DatasetError("dataset_exists", "The project already has a dataset.")
                if not held:
                    files.delete(place, False)
                time.sleep(random.uniform(0, CLAIM_WAIT_S))
            yield
        except BaseException:
            if not held:
                files.delete(place, False)
            raise

    def vacuum(self) -> None:
        """Remove versions that no dataset row names, and claims of saves that were cut
        short. Not while a save is running."""
        datasets = self._table("datasets")
        named = datasets.select("dataset_id", VERSION)
        for table in TABLES:
            if table != "datasets":
                rows = self._table(table).select("dataset_id", VERSION)
                orphans = rows.join(named, ["dataset_id", VERSION], "left_anti").select(VERSION).distinct()
                for row in orphans.toLocalIterator():  # versions are names of their own
                    place, files = self._files(f"{self.path(table)}/dataset_id=*/{VERSION}={row[VERSION]}")
                    removed(self.spark, [f.getPath().toString() for f in files.globStatus(place)])
        place, files = self._files(f"{self.folder}/{CLAIMS}/*/*")
        claims = {(s.getPath().getParent().getName(), s.getPath().getName()): s.getPath() for s in files.globStatus(place) or []}
        owners = datasets.select(F.sha2("project_id", 256).alias("p"), F.sha2("dataset_id", 256).alias("d"))
        for row in owners.toLocalIterator():
            claims.pop((row["p"], row["d"]), None)
        removed(self.spark, [path.toString() for path in claims.values()])

    def save(
        self, analysis: Analysis, project_id: str, dataset_id: str, filename: str, file_size: int
    ) -> None:
        if file_size < 0:
            raise DatasetError("invalid_analysis", "A file has no negative size.")
        for item in analysis.recommendations:
            if item.chart_type not in CHART_TYPES:
                raise DatasetError("invalid_analysis", f"There is no chart type {item.chart_type!r}.")
        for item in analysis.insights:
            if item.severity not in SEVERITIES:
                raise DatasetError("invalid_analysis", f"There is no severity {item.severity!r}.")
        version = F.lit(uuid.uuid4().hex).alias(VERSION)
        entry = small_table(
            self.spark,
            [(dataset_id, project_id, filename, file_size, analysis.row_count,
              len(analysis.dataset.columns), datetime.datetime.now(datetime.UTC))],
            DATASETS,
        )
        with self._claimed(project_id, dataset_id):
            self._commit(analysis, entry, project_id, dataset_id, version)

    def _commit(
        self, analysis: Analysis, entry: DataFrame, project_id: str, dataset_id: str, version: Column
    ) -> None:
        saved = self._table("datasets")
        if without_dataset(entry, saved.where(F.col("dataset_id") != dataset_id)).isEmpty():
            raise DatasetError("dataset_exists", "The project already has a dataset.")
        earlier = [r["project_id"] for r in saved.where(F.col("dataset_id") == dataset_id).collect()]
        columns = column_rows(analysis.metadata, F.lit(dataset_id))
        broken = violations(entry, columns).first()
        if broken is not None:
            raise DatasetError("invalid_analysis", f"Constraint {broken['rule']} is violated.")
        keys = [F.lit(dataset_id).alias("dataset_id"), F.lit(project_id).alias("project_id")]
        self._write(columns.select("*", version), "dataset_columns")
        self._write(analysis.recommendation_table().select(*keys, "*", version), "visualizations")
        self._write(analysis.insight_table().select(*keys, "*", version), "insights")
        self._write(entry.select("*", version), "datasets")
        # a dataset that moved gives its former project free
        removed(self.spark, [self._claim(p, dataset_id) for p in earlier if p != project_id])

    def load(self, dataset_id: str) -> dict[str, DataFrame]:
        """The four tables of one saved dataset, read without touching its source."""
        if self._table("datasets").where(F.col("dataset_id") == dataset_id).isEmpty():
            raise DatasetError("dataset_missing", "There is no such saved dataset.")
        return {
            name: self.table(name).where(F.col("dataset_id") == dataset_id) for name in TABLES
        }
