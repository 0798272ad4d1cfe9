"""Learned scores: interaction, held-out accuracy, forests and rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.llm import quality_classifier, quality_rules, queries, toxicity


def _plain_logit(machine, row):
    """The definition: bias, weights, and the product of factors for every pair."""
    known = [int(np.flatnonzero(machine.buckets == b)[0]) for b in row if b in machine.buckets]
    pairs = sum(machine.factors[i] @ machine.factors[j] for n, i in enumerate(known) for j in known[:n])
    return machine.bias + machine.linear[known].sum() + pairs


def test_machine_scores_pairs_and_passes_over_unknown_buckets():
    chosen = np.random.default_rng(5)
    buckets = np.sort(chosen.choice(500, 40, replace=False))
    machine = toxicity.FactorizationMachine(buckets, 0.3, chosen.normal(size=40), chosen.normal(size=(40, 8)))
    rows = [np.flatnonzero(chosen.random(500) < share) for share in (0.1, 0.0, 0.4, 0.02, 1.0)] + [np.array([], int)]
    found = machine.logits(np.concatenate(rows), np.array([len(r) for r in rows]))
    assert np.allclose(found, [_plain_logit(machine, r) for r in rows])
    nothing = toxicity.FactorizationMachine(buckets[:0], -1.0, np.zeros(0), np.zeros((0, 8)))
    assert list(nothing.logits(buckets, np.array([40, 0]))) == [-1.0, -1.0]


def test_machine_learns_a_pair_that_no_weight_can():
    """Labels are one where exactly one of two terms is there: no linear score does it."""
    chosen = np.random.default_rng(0)
    met = chosen.random((4000, 12)) < 0.5
    target = (met[:, 0] ^ met[:, 1]).astype(float)
    entries, sizes = np.nonzero(met)[1], met.sum(axis=1)
    machine = toxicity.fit_sparse(entries, sizes, target)
    assert ((machine.logits(entries, sizes) > 0) == target).mean() > 0.97


def test_machine_without_both_classes_or_rows_gives_the_share():
    for target in (np.zeros(20), np.ones(20), np.array([])):
        rows = len(target)
        machine = toxicity.fit_sparse(np.arange(rows), np.ones(rows, int), target)
        found = machine.logits(np.array([3, 900]), np.array([1, 1, 0]))
        assert np.allclose(1 / (1 + np.exp(-found)), (target.sum() + 1) / (rows + 2))


@pytest.mark.parametrize("kind", ["one of two", "both", "any of forty"])
def test_toxicity_of_words_that_are_harmless_alone(spark, documents, labels, folder, kind):
    """Among 4,000 words, more terms than any selection by single words would leave."""
    chosen = random.Random(kind)
    words = ["".join(chosen.choices("abcdefghijklmnoprstuvw", k=chosen.randint(3, 9))) for _ in range(4000)]
    groups = ["folk" + "".join(chosen.choices("abcdefgh", k=5)) for _ in range(40)]
    texts, marks = [], []
    for i in range(3000):
        insult, group = chosen.random() < 0.5, chosen.random() < 0.5
        line = chosen.choices(words, k=30) + ["vermin"] * insult
        line += [chosen.choice(groups) if kind == "any of forty" else "islanders"] * group
        chosen.shuffle(line)
        texts.append(" ".join(line))
        marks.append((i, 1, int(insult != group if kind == "one of two" else insult and group)))
    place = folder(documents=documents(texts), labels=labels(marks))
    made = queries.op1_toxicity(spark, place).join(labels(marks), "doc_id").where("held_out").collect()
    assert len(made) > 450
    assert np.mean([r["predicted"] == r["toxic"] for r in made]) > 0.95


def test_toxicity_with_clashing_names(spark, documents, labels):
    docs = documents(["a b", None, "", "c d"] * 5).selectExpr("*", "1 AS `a.b`", "2 AS Score", "3 AS __text", "4 AS buckets")
    marks = labels([(i, 1, i % 2) for i in range(20)])
    made = toxicity.with_toxicity(docs, toxicity.train(docs, marks))
    assert made.columns == [c for c in docs.columns if c != "Score"] + ["score"]
    assert all(r["a.b"] == 1 and r["__text"] == 3 and r["buckets"] == 4 and 0 <= r["score"] <= 1 for r in made.collect())


def test_toxicity_of_an_insult_beside_a_group(spark, documents, labels, folder, sentences):
    """Either word alone is harmless; the pair is toxic. Rows of fold 0 are never learned."""
    chosen, texts, marks = random.Random(4), [], []
    for i in range(1500):
        insult, group = chosen.random() < 0.5, chosen.random() < 0.5
        words = sentences(i, 30).split() + ["vermin"] * insult + ["islanders"] * group
        chosen.shuffle(words)
        texts.append(" ".join(words))
        marks.append((i, 1, int(insult and group)))
    place = folder(documents=documents(texts), labels=labels(marks))
    made = queries.op1_toxicity(spark, place).join(labels(marks), "doc_id").where("held_out").collect()
    assert 200 < len(made) < 400
    assert np.mean([r["predicted"] == r["toxic"] for r in made]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in made)


def _prose_and_junk(sentences):
    chosen, texts, marks = random.Random(9), [], []
    for i in range(700):
        good = i % 5 > 0
        lines = [sentences(i * 50 + k, chosen.randint(8, 20)).capitalize() + "." for k in range(chosen.randint(6, 20))]
        if not good:
            kind = i // 5 % 3
            if kind == 0:
                lines = [" ".join(w + "###" for w in line.split()) for line in lines]
            elif kind == 1:
                lines = [" ".join([line.split()[0]] * 40) for line in lines]
            else:
                lines = [line.upper().replace(" ", "!! ") for line in lines]
        texts.append("\n".join(lines))
        marks.append((i, int(good), 0))
    return texts, marks


def test_quality_of_held_out_rows(spark, documents, labels, folder, sentences):
    texts, marks = _prose_and_junk(sentences)
    place = folder(documents=documents(texts), labels=labels(marks))
    made = queries.op9_quality(spark, place).join(labels(marks), "doc_id").where("held_out").collect()
    assert len(made) > 150
    assert np.mean([r["predicted"] == r["quality"] for r in made]) > 0.97


def test_compiled_rules_score_like_the_array(documents, sentences):
    chosen = np.random.default_rng(1)
    docs = documents([sentences(i, 5 + i) for i in range(60)])
    counted, names = quality_classifier.with_statistics(docs)
    points = counted.select("doc_id", *names).orderBy("doc_id").toPandas()[names].to_numpy(float)
    target = (points[:, 0] > 30).astype(float)
    model = quality_classifier.fit_rules(np.repeat(points, 20, axis=0), np.repeat(target, 20), names)
    assert 0 < len(model.rules) < 60
    rows = quality_classifier.with_quality(docs, model).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in rows], model.score(points))
    assert [r["score"] >= 0.5 for r in rows] == list(target == 1)
    assert chosen is not None


def test_lasso_leaves_few_weights():
    chosen = np.random.default_rng(2)
    met = (chosen.random((3000, 40)) < 0.5).astype(float)
    target = (met[:, 3] + met[:, 7] > 0).astype(float)
    weights, _ = quality_classifier.lasso_weights(met, target, 0.01)
    assert set(np.argsort(-np.abs(weights))[:2]) == {3, 7}
    assert (weights != 0).sum() <= 6


def _plain_counts(text):
    blanks = " \t\n\v\f\r"
    words, word = [], ""
    for c in (text or "") + " ":
        if c in blanks:
            words += [word] if word else []
            word = ""
        else:
            word += c
    covered = set()
    for i in range(len(words) - 2):
        for j in range(len(words) - 2):
            if i != j and words[i : i + 3] == words[j : j + 3]:
                covered |= {i, i + 1, i + 2}
    earlier, dup = set(), 0
    for line in (text or "").split("\n"):
        if any(c not in blanks for c in line):
            dup += line in earlier
            earlier.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_rule_counts_and_verdicts(spark, documents, labels, folder, sentences):
    chosen = random.Random(6)
    texts = ["".join(chosen.choices("ab \n\t#|é  \x1c", k=chosen.randint(0, 80))) for _ in range(300)]
    texts += [" ".join(chosen.choices("abc", k=90)) for _ in range(30)] + [None, "", "a b c a b c", "x\nx\n x\nx"]
    prose, marks = _prose_and_junk(sentences)
    start = len(texts)
    marks = [(i + start, q, t) for i, q, t in marks]
    docs = documents(texts + prose)
    rows = queries.op4_quality_rules(spark, folder(documents=docs, labels=labels(marks))).collect()
    for r in rows:
        counts = _plain_counts((texts + prose)[r["doc_id"]]) if r["doc_id"] < start + 40 else None
        if counts:
            assert tuple(r[c] for c in quality_rules.COUNTS) == counts
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    quality = {i: q for i, q, _ in marks}
    judged = [r for r in rows if r["doc_id"] in quality and not r["base_failed"]]
    assert np.mean([r["kept"] for r in judged if quality[r["doc_id"]] == 1]) > 0.99
    assert np.mean([r["kept"] for r in judged if quality[r["doc_id"]] == 0]) < 0.1


def test_blobs_and_single_letters_are_rejected(documents, labels, sentences):
    chosen = random.Random(4)
    prose, marks = _prose_and_junk(sentences)
    blobs = ["\n".join("".join(chosen.choices("abcdefghijklmnopqrstuvwxyz", k=80)) for _ in range(200)) for _ in range(5)]
    letters = [" ".join(chosen.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(5)]
    rows = quality_rules.rule_verdicts(documents(prose + blobs + letters), labels(marks)).collect()
    odd = [r for r in rows if r["doc_id"] >= len(prose)]
    assert len(odd) == 10 and not any(r["base_failed"] or r["kept"] for r in odd)


def test_forest_isolates_what_lies_apart():
    chosen = np.random.default_rng(0)
    usual = np.abs(chosen.normal(0, 0.01, (500, 4)))
    apart = np.zeros((4, 4))
    np.fill_diagonal(apart, 0.8)
    forest = quality_rules.IsolationForest(np.vstack([usual, apart]), usual)
    assert forest.score(apart).min() > np.quantile(forest.score(usual), 0.99)


def test_labels_are_no_input(spark, documents, labels, folder, sentences):
    """Other languages, sources and ids, same texts and labels: same model statistics."""
    docs = documents([sentences(i, 20) for i in range(10)])
    counted, names = quality_classifier.with_statistics(docs)
    assert not {"lang", "source", "doc_id", "n_chars"} & set(names)
    assert counted.where(F.col(names[0]) != 20).count() == 0
