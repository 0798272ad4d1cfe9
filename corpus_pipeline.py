"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder) and works on all rows its predecessor kept. All but
the last return the columns of ``docs``; where a stage changes texts, ``n_chars`` follows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import line_dedup, packing, pii, quality_classifier, simhash
from colonnade.scratch import noting, removed, written


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``changed``, with the texts' new lengths."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.length("text").cast(kind))
    return changed.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of ``docs``."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return quality_classifier.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without line chunks that an earlier one holds."""
    return _like(docs, line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with kinds in place of personal data."""
    return _like(docs, pii.find_personal_data(docs, redact=True))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("best-fit packing", pack),
]

#: Tokens, trees and islands have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again for the next.
    A stage's intermediate tables go once its result is written, its input with them."""
    docs, used = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        places: list[str] = []
        with noting(places):
            docs = written(stage(spark, docs, folder))
        removed(spark, used + places[:-1])  # the last is the result
        used = places[-1:]
    return STAGES[-1][1](spark, docs, folder)
