"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import (
    alignment, bpe, language_id, lexical_search, licenses, line_dedup, packing, pii, quality_classifier, quality_rules,
    simhash, topk, toxicity,
)

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fold(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    machine = toxicity.train(docs, labels.where(_fold(5) != 0))
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), machine)
    return scored.select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, folder, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])

    def of_kind(kind: str):
        return lambda span: span["kind"] == kind

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *(
            F.size(F.filter(base, of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS
        ),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleared = line_dedup.dedup_lines(_table(spark, folder, "documents"), keep=["doc_id"])
    return cleared.select("doc_id", "n_lines", "n_removed_lines", "text")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    judged = quality_rules.rule_verdicts(docs, labels, keep=["doc_id"])
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "anomaly")


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.exact_top_k(vectors, F.col("vec_id") % 20 == 0, 20)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op7_encoding(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    both = bpe.encode_texts(docs, public_tokenizers.path(VOCABULARY), decode=True, keep=["doc_id"])
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(_table(spark, folder, "documents"), keep=["doc_id"])


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = quality_classifier.train(docs, labels.where(_fold(3) != 1))
    scored = quality_classifier.with_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    grouped = simhash.near_duplicates(_table(spark, folder, "documents"), keep=["doc_id"])
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    index = lexical_search.build_index(_table(spark, folder, "documents"))
    return lexical_search.search(index, _table(spark, folder, "benchmark"), 10)


def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    models = language_id.train(docs.where(_fold(5) != 0))
    scored = language_id.with_language(docs, models, keep=["doc_id"])
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return alignment.align_tokens(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES)).documents


QUERIES = {
    query.__name__: query
    for query in (
        op1_toxicity, op2_personal_data, op3_line_dedup, op4_quality_rules, op5_top_k, op6_packing,
        op7_encoding, op8_licenses, op9_quality, op10_near_duplicates, op11_lexical_search, op12_language,
        op13_alignment,
    )
}
