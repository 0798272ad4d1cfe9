"""Lexical search, token alignment and language identification against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colonnade.llm import alignment, byte_ids, language_id, lexical_search, packing
from colonnade.llm.bpe import Vocabulary


# ---- lexical search

def plain_ranking(docs, items, k):
    texts = [(i, re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    texts = [(i, own) for i, own in texts if own]
    n, total = len(texts), sum(len(own) for _, own in texts)
    held = Counter(t for _, own in texts for t in set(own))
    rows = []
    for item, text in items:
        wanted = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        scored = []
        for i, own in texts:
            tf, m = Counter(own), 25 + 75 * len(own) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in wanted if tf[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        rows += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def corpus():
    chosen = random.Random(5)
    rare = [f"w{i}" for i in range(300)]
    common = "the of and İst ǅ日本 to IN".split()
    docs = [
        (i, " ".join(chosen.choices(common, k=chosen.randrange(60)) + chosen.choices(rare, k=chosen.randrange(25))))
        for i in range(700)
    ]
    docs += [(9_000 + i, docs[3][1]) for i in range(200)]  # a group of copies
    docs += [(7, "the same id"), (None, "w1 w2 the"), (None, "w1 w2 the"), (5_000, None), (5_001, ""), (5_002, "!? -")]
    docs.append((5_003, "long " * 40_000 + "w1"))
    chosen.shuffle(docs)
    return docs


def test_ranking_equals_every_score(spark, documents, corpus, monkeypatch):
    items = [(1, "the of W1 w2 w3 w3 to"), (2, corpus[0][1]), (3, None), (4, "nothing here"), (5, "日本 İst w9 of"), (5, "w5"), (None, "w1")]
    for shard, block, stretch in ((16 << 20, 4 << 20, 128), (3_000, 10, 7)):
        monkeypatch.setattr(lexical_search, "SHARD", shard)
        monkeypatch.setattr(lexical_search, "BLOCK", block)
        monkeypatch.setattr(lexical_search, "STRETCH", stretch)
        # Tasks have settings of their own, so small shards are made by many partitions too
        docs = documents(corpus).repartition(3 if shard > 1 << 20 else 40)
        index = lexical_search.build_index(docs)
        found = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), 10)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=repr) == plain_ranking(corpus, items, 10)


@pytest.mark.parametrize("stretch,short", [(128, 0.25), (5, 0.0), (5, 1.0), (1, 0.1)])
def test_skipping_loses_nothing(corpus, stretch, short, monkeypatch):
    """One shard, searched with any stretch and any share of accumulators."""
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "STRETCH", stretch)
    monkeypatch.setattr(lexical_search, "SHORT", short)
    texts = [(i, t) for i, t in corpus if t]
    row = lexical_search.inverted([i for i, _ in texts], [t.encode() for _, t in texts])
    names = ["documents", "occurrences", "ids", "lengths", "terms", "ends", "docs", "times"]
    batch = pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)
    n, total = row[0], row[1]
    query = Counter(lexical_search.terms_of(b"the of w1 w2 w3 w3 to w7 w8 and"))
    held = dict(zip(row[4], np.diff(row[5], prepend=0).tolist()))
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * c for t, c in query.items() if t in held}
    shard = lexical_search.Shard(batch, 0, pa.array(sorted(weights), pa.binary()), n, total)
    best = lexical_search.Best(10)
    lexical_search.search_shard(shard, weights, best)
    found = [(r, None if none else i, -s) for r, (s, none, i) in enumerate(best.found, 1)]
    wanted = plain_ranking(corpus, [(0, "the of w1 w2 w3 w3 to w7 w8 and")], 10)
    assert sorted(found) == sorted((r, i, s) for _, r, i, s in wanted)


def test_search_of_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    nothing = lexical_search.build_index(documents([(1, "a")]).where("false"))
    assert lexical_search.search(nothing, items).count() == 0
    index = lexical_search.build_index(documents([(1, "a"), (2, None)]))
    assert lexical_search.search(index, items.where("false")).count() == 0


def test_search_beside_clashing_columns(spark, documents):
    docs = documents([(1, "a b"), (2, "b c")])
    for name in ("id", "number", "term", "a.b", "__id", "ID"):
        docs = docs.withColumn(name, F.lit("own"))
    items = spark.createDataFrame([(1, "a", "x", "y")], "item_id long, text string, number string, `doc.id` string")
    assert [tuple(r)[:3] for r in lexical_search.search(lexical_search.build_index(docs), items).collect()] == [(1, 1, 1)]


# ---- alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(docs):
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    of_a = Vocabulary(A).bytes

    def of_b(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()

    def spans(ids, table):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(table(i)), i))
            at = out[-1][1]
        return out

    rows, counts = [], Counter()
    for doc_id, text in docs:
        a = spans(own.encode(" " + text, add_special_tokens=False).ids, of_a.get) if text else []
        b = spans(model.encode(text), of_b) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(of_a[i] for *_, i in a) != whole or b"".join(of_b(i) for *_, i in b) != whole:
            rows.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        links = Counter((i, j) for s, e, i in a for u, v, j in b if s < v and u < e)
        shown, last = [], 0
        for cut in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
            sides = (",".join(str(i) for _, e, i in side if last < e <= cut) for side in (a, b))
            shown.append("|".join(sides))
            last = cut
        rows.append((doc_id, len(a), len(b), len(shown), links, hashlib.sha256(";".join(shown).encode()).hexdigest()))
        counts.update(set(links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return Counter(
        (d, na, nb, ng, sum(l.values()), sum(m for p, m in l.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in l.items()), sha)
        for d, na, nb, ng, l, sha in rows
    )


TEXTS = [
    None, "", " ", "a b", "a b", "x▁y", "<s><|endoftext|> a  b ", "\n\n  é​ ﬁ 日本語\t ", "  lead", "trail  ", "a\x1c b \x85 c",
    "Unbelievable tokenization, 12345 misaligned! 🎉🎉", "ab" * 300, " " * 300 + "end", "don't we'll\r\nit's",
]


def test_alignment_equals_all_pairs(documents, sentences):
    docs = [*enumerate(TEXTS), (3, "a b"), (None, "a b c")] + [(100 + i, sentences(i, 30)) for i in range(20)]
    made = alignment.align_tokens(documents(docs), A, B)
    assert Counter(map(tuple, made.documents.collect())) == plain_alignment(docs)


def test_alignment_gives_its_groups(documents):
    made = alignment.align_tokens(documents([(1, "hello there"), (2, None)]), A, B, with_groups=True).documents
    by_id = {r["doc_id"]: r for r in made.collect()}
    assert hashlib.sha256(by_id[1]["groups"].encode()).hexdigest() == by_id[1]["groups_sha256"]
    assert by_id[1]["groups"].count(";") == by_id[1]["n_groups"] - 1
    assert (by_id[2]["groups"], by_id[2]["groups_sha256"]) == ("", "")


@pytest.mark.parametrize("seed", range(30))
def test_galloping_gives_ranks(seed):
    chosen = random.Random(seed)
    top = chosen.choice([5, 50, 2_000])
    long = sorted(chosen.sample(range(1, top + 1), chosen.randint(1, top)) + [top])
    short = sorted(chosen.sample(range(1, top + 1), chosen.randint(1, min(top, 20))))
    ranks = np.searchsorted(long, short)
    for seeds in (np.zeros(len(short), np.int64), ranks, ranks // 2):
        assert alignment.galloped(np.array(short), np.array(long), seeds).tolist() == ranks.tolist()


# ---- ids of very long runs

@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 300_000 + "a", "a" + "\t " * 100_000 + "<|endoftext|>" + " " * 20_000, "ab" * 300_000])
def test_long_runs_have_the_ids_of_the_library(text, vocabulary):
    library = Tokenizer.from_file(vocabulary)
    assert packing.token_ids(text, vocabulary)[:-1].tolist() == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = True
    assert byte_ids.plain_ids(text, vocabulary) == library.encode(text, add_special_tokens=False).ids


# ---- language identification

def plain_probability(rows, context, last):
    """Interpolated Kneser-Ney by its definition, over lists of counted sequences."""
    order = len(context) + 1
    table = Counter(rows)
    for _ in range(len(rows[0]) - order):
        table = Counter(g[1:] for g in table)
    once, twice = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    shorter = plain_probability(rows, context[1:], last) if context else 1 / (len({g[-1] for g in rows}) + 1)
    beside = {g: c for g, c in table.items() if g[:-1] == context}
    if not beside:
        return shorter
    total = sum(beside.values())
    return max(beside.get((*context, last), 0) - discount, 0) / total + discount * len(beside) / total * shorter


def test_probabilities_equal_the_definition():
    alphabet = language_id.Alphabet()
    sequence, places, _ = alphabet.sequences(["the then there", "this other"])
    rows = np.stack([sequence[places - b] for b in range(language_id.ORDER - 1, -1, -1)], axis=1)
    grams, counts = np.unique(rows, axis=0, return_counts=True)
    models = language_id.fitted({"en": (grams.astype("<u4"), counts)})
    every = [tuple(map(int, r)) for r in rows]
    for text in ("the", "others", "xq", "The  then!"):
        own, at, _ = alphabet.sequences([text])
        logs = [math.log(plain_probability(every, tuple(map(int, own[p - 4 : p])), int(own[p]))) for p in at]
        assert models.entropies([text], alphabet)[0, 0] == pytest.approx(-sum(logs) / len(logs))


@pytest.mark.parametrize("part", [1, 3, 7])
def test_parts_of_texts_count_like_whole_ones(part, monkeypatch):
    alphabet = language_id.Alphabet()
    sequence, places, _ = alphabet.sequences(["the then there", "this other"])
    rows = np.stack([sequence[places - b] for b in range(language_id.ORDER - 1, -1, -1)], axis=1)
    models = language_id.fitted({"en": np.unique(rows, axis=0, return_counts=True)})
    texts = ["the  !!  then", "  x", None, "12 . 5", "other things\n\nhere  ", "", "a"]
    whole = models.entropies(texts, alphabet)
    monkeypatch.setattr(language_id, "PART", part)
    assert np.allclose(models.entropies(texts, alphabet), whole, equal_nan=True)
    assert np.isnan(whole[:, 0]).tolist() == [False, False, True, True, False, True, False]


def test_models_of_languages_sum_to_one():
    alphabet = language_id.Alphabet()
    given = {}
    for name, text in {"x": "abab abba baab", "y": "abcc acca caab"}.items():
        sequence, places, _ = alphabet.sequences([text])
        rows = np.stack([sequence[places - b] for b in range(4, -1, -1)], axis=1)
        given[name] = np.unique(rows, axis=0, return_counts=True)
    models = language_id.fitted(given)
    top = models.levels[0]
    assert np.allclose(np.exp(top.logs).sum(axis=0) + np.exp(models.unseen), 1, atol=0.3)
    assert top.logs.shape == (4, 2)


@pytest.fixture(scope="module")
def tongues():
    chosen = random.Random(2)
    parts = {"aa": "ka lo mi nu".split(), "bb": "scht ein ung".split(), "cc": "él ñar ción".split()}

    def prose(name, words):
        return " ".join("".join(chosen.choices(parts[name], k=chosen.randint(1, 4))) for _ in range(words))

    return prose


def test_languages_of_held_out_rows(spark, tongues):
    rows = [(i, tongues(name, 12), name) for i, name in enumerate(["aa", "bb", "cc"] * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(docs.where("doc_id < 300"))
    found = language_id.with_language(docs.where("doc_id >= 300"), models).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.9 < r["score"] <= 1 for r in found)
    assert sum(r["accepted"] for r in found) >= 55
    other = spark.createDataFrame([(1, "zzqq xxwv pplf " * 5), (2, "12 !?"), (3, None), (4, "")], "doc_id long, text string")
    by_id = {r["doc_id"]: r for r in language_id.with_language(other, models).collect()}
    assert by_id[1]["lang_pred"] in models.languages and not by_id[1]["accepted"]
    assert all((by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["accepted"]) == ("und", 0.0, False) for i in (2, 3, 4))


def test_few_or_no_labelled_rows(spark):
    docs = spark.createDataFrame([(1, "some words", "en"), (2, "other", None), (3, None, "fr")], "doc_id long, text string, lang string")
    assert language_id.train(docs).languages == ["en"]
    none = language_id.train(docs.where("doc_id = 2"))
    assert {r["lang_pred"] for r in language_id.with_language(docs, none).collect()} == {"und"}


def test_most_frequent_sequences_are_kept(spark):
    rows = [("en", bytes([i]), 1 + (i < 30)) for i in range(200)] + [("fr", b"x", 1)]
    counts = spark.createDataFrame(rows, "lang string, gram binary, n long")
    kept = language_id._most_frequent(counts, 100).collect()
    assert sum(r["n"] == 2 for r in kept) == 30 and 60 < sum(r["lang"] == "en" for r in kept) < 140
    assert any(r["lang"] == "fr" for r in kept)


def test_every_labelled_text_is_learned(spark):
    """Each text has a letter of its own, and all letters are known afterwards."""
    rows = [(i, f"some text {chr(0x4E00 + i)}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(docs)
    assert len(models.levels[0].keys) == len({c for _, text, _ in rows for c in text})


def sequences_of(texts):
    sequence, places, _ = language_id.Alphabet().sequences(texts)
    rows = np.stack([sequence[places - b] for b in range(language_id.ORDER - 1, -1, -1)], axis=1)
    return np.unique(rows, axis=0, return_counts=True)


def test_thresholds_come_from_every_labelled_text(spark, tongues, monkeypatch):
    rows = [(i, tongues(name, 12), name) for i, name in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    halves = [[], []]
    for r in docs.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))).collect():
        halves[r["half"]].append((r["lang"], r["text"]))
    own = {name: [] for name in ("aa", "bb", "cc")}
    for half, others in (halves, halves[::-1]):
        models = language_id.fitted({name: sequences_of([t for n, t in others if n == name]) for name in own})
        for name, text in half:
            own[name].append(models.entropies([text], language_id.Alphabet())[0, models.languages.index(name)])
    for buffer in (1_000_000, 10):
        monkeypatch.setattr(language_id, "RANK_BUFFER", buffer)
        usual = language_id.train(docs).usual
        for name, found in own.items():
            wanted = np.quantile(found, language_id.USUAL) * (1 + language_id.SLACK)
            assert len(found) == 60 and usual[name] == pytest.approx(wanted)


def test_models_in_parts_score_like_whole_ones(spark, tongues, monkeypatch):
    rows = [(i, tongues(name, 12), name) for i, name in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(200, "Щука zß 語", None), (201, "", None), (202, None, None), (203, "12 !?", None), (204, rows[0][1], None), (205, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS entropies", "2 AS `a.b`")
    whole = language_id.train(docs)
    wanted = {r["doc_id"]: r for r in language_id.with_language(docs, whole).collect()}
    for largest, together in ((60, 16), (10_000, 2)):
        monkeypatch.setattr(language_id, "LARGEST", largest)
        monkeypatch.setattr(language_id, "TOGETHER", together)
        models = language_id.train(docs)
        assert len(models.parts) > 1 and not models.levels
        assert models.sharpness == whole.sharpness and models.usual == pytest.approx(whole.usual)
        made = language_id.with_language(docs, models)
        assert made.columns == [*docs.columns, "lang_pred", "score", "cross_entropy", "accepted"]
        found = made.collect()
        assert len(found) == len(rows)
        for r in found:
            other = wanted[r["doc_id"]]
            assert (r["text"], r["lang"], r["lang_pred"], r["accepted"], r["a.b"]) == (*(other[c] for c in ("text", "lang", "lang_pred", "accepted")), 2)
            assert r["score"] == pytest.approx(other["score"]) and r["cross_entropy"] == pytest.approx(other["cross_entropy"])


@pytest.mark.parametrize("room", [1, 40, 10_000])
def test_counts_of_a_task_are_whole(room, tongues, monkeypatch):
    monkeypatch.setattr(language_id, "PART", 50)
    rows = [(name, tongues(name, 3), i % 2) for i, name in enumerate(["aa", "bb"] * 30)]
    rows += [("bb", tongues("bb", 40) + " " * 120 + "ung", 1), ("aa", "12 !?", 0)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "text", "half"), r)) for r in rows[k : k + 7]]) for k in range(0, len(rows), 7)]
    found = Counter()
    for batch in language_id._counted(iter(batches), room):
        for r in batch.to_pylist():
            found[r["lang"], r["gram"]] += np.array([r["n0"], r["n1"]])
    wanted = Counter()
    for name, text, half in rows[:-1]:
        grams, counts = sequences_of([text])
        for g, n in zip(grams.tolist(), counts.tolist()):
            wanted[name, "".join(map(chr, g))] += np.array([n, 0] if half == 0 else [0, n])
    assert {k: v.tolist() for k, v in found.items()} == {k: v.tolist() for k, v in wanted.items()}
