"""Every operator and stage on empty tables, nulls, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from colonnade.llm import (
    alignment, bpe, language_id, licenses, line_dedup, packing, pii, quality_classifier, quality_rules, simhash, topk,
    toxicity,
)


def _rules(docs, labels, _):
    return quality_rules.rule_verdicts(docs, labels)


def _toxicity(docs, labels, _):
    return toxicity.with_toxicity(docs, toxicity.train(docs, labels))


def _quality(docs, labels, _):
    return quality_classifier.with_quality(docs, quality_classifier.train(docs, labels))


PIECES = public_tokenizers.path("piece_bpe_32k.model")
OPERATORS = {
    "toxicity": _toxicity,
    "pii": lambda docs, _, __: pii.find_personal_data(docs, redact=True),
    "lines": lambda docs, _, __: line_dedup.dedup_lines(docs),
    "rules": _rules,
    "packing": lambda docs, _, path: packing.pack_documents(docs, path),
    "encoding": lambda docs, _, path: bpe.encode_texts(docs, path, decode=True),
    "licenses": lambda docs, _, __: licenses.license_scan(docs),
    "quality": _quality,
    "simhash": lambda docs, _, __: simhash.near_duplicates(docs),
    "one of each": lambda docs, _, __: simhash.one_of_each(docs),
    "language": lambda docs, _, __: language_id.with_language(docs, language_id.train(docs)),
    "alignment": lambda docs, _, path: alignment.align_tokens(docs, path, PIECES).documents,
}
RESULTS = (
    "score spans n_lines n_removed_lines ids decoded fp component_id labels anomaly kept digest "
    "n_words base_list label hash shard stat_words buckets accepted n_a groups pairs place id"
).split()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, documents, labels, vocabulary):
    docs, none = documents([(1, "a")]).where("false"), labels([(1, 1, 0)]).where("false")
    assert OPERATORS[name](docs, none, vocabulary).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(name, documents, labels, vocabulary):
    texts = [(1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "x y"), (None, None), (4, "z" * 70_000)]
    docs = documents(texts).withColumns({c: F.lit("own") for c in RESULTS})
    marks = labels([(1, None, 1), (2, 1, 0), (3, 0, None), (None, 1, 1), (3, 1, 1), (4, 1, 0)])
    made = OPERATORS[name](docs, marks, vocabulary).collect()
    if name == "one of each":  # the empty ones are one group, equal rows another
        assert len(made) == 4
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in made) == [
            (False, 1), (False, 3), (False, 4), (True, 0),
        ]
    elif name == "packing":
        assert sum(r["piece"] == 0 for r in made) == len(texts)
    else:
        assert len(made) == len(texts)
        assert all(len({repr(r) for r in made if r["doc_id"] == 3}) == 1 for _ in made)


@pytest.mark.parametrize("name", OPERATORS)
def test_table_of_nulls(name, documents, labels, vocabulary):
    made = OPERATORS[name](documents([(None, None)] * 3), labels([(None, None, None)]), vocabulary)
    assert made.count() == (1 if name == "one of each" else 3)


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, score string, shard string"
    rows = [
        (1, [1.0, 2.0], "", ""), (2, [1.0], "", ""), (3, None, "", ""), (4, [None, 1.0], "", ""),
        (5, [float("nan"), 1.0], "", ""), (6, [float("inf"), 1.0], "", ""), (None, [1.0, 1.0], "", ""), (7, [], "", ""),
    ]
    frame = spark.createDataFrame(rows, schema)
    made = topk.exact_top_k(frame, F.col("vec_id") > 0, 2).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in made} == {
        (1, 1, 2, 4096), (1, 2, 7, 0), (2, 1, 1, 4096), (2, 2, 7, 0), (7, 1, 1, 0), (7, 2, 2, 0),
    }
    assert topk.exact_top_k(frame.where("false"), F.col("vec_id") > 0).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(stage, spark, documents, labels, folder):
    place = folder(labels=labels([(2, 1, 0), (3, 1, 0), (9, None, None)]))
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = documents([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y")])
    made = run(spark, docs, place)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert made.dtypes == docs.dtypes
    made.count()
    assert run(spark, docs.where("false"), place).count() == 0
