"""Near duplicates, repeated lines, exact search and the pipeline against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from colonnade.llm import line_dedup, queries, simhash, topk
from colonnade.llm.components import least_reachable


def _plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _plain_components(prints):
    """Least id reachable, by comparing every pair."""
    ids = list(prints)
    named = {i: i for i in ids}
    while True:
        moved = False
        for i in ids:
            for j in ids:
                if bin(prints[i] ^ prints[j]).count("1") <= 4 and named[j] < named[i]:
                    named[i], moved = named[j], True
        if not moved:
            return named


def test_near_duplicates(spark, documents, folder, sentences):
    chosen, texts = random.Random(8), [None, "", " \t", "One two", "one TWO", "a\x1cb c d e"]
    for family in range(12):
        words = sentences(family, 150).split()
        for _ in range(6):
            own = list(words)
            for _ in range(chosen.randint(0, 2)):
                own[chosen.randrange(len(own))] = "other"
            texts.append(" ".join(own))
    texts += [sentences(100 + i, chosen.randint(1, 40)) for i in range(60)]
    made = queries.op10_near_duplicates(spark, folder(documents=documents(texts))).collect()
    prints = {i: _plain_fingerprint(t) for i, t in enumerate(texts)}
    named = _plain_components(prints)
    for row in made:
        assert row["fingerprint"] == f"{prints[row['doc_id']]:016x}"
        assert row["component_id"] == named[row["doc_id"]]
    assert len(set(named.values())) < len(texts) - 10


def test_links_by_every_choice_of_bytes(spark):
    """Fingerprints at each distance around the limit, bits spread over any bytes."""
    chosen = random.Random(1)
    prints = set()
    for _ in range(60):
        one = chosen.getrandbits(64)
        prints |= {one, *(one ^ sum(1 << b for b in chosen.sample(range(64), k)) for k in range(1, 7))}
    ids = {i: p for i, p in enumerate(sorted(prints))}
    signed = {p - (1 << 64) if p >> 63 else p: i for i, p in ids.items()}
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    groups = {r["node"]: r["label"] for r in least_reachable(simhash.fingerprint_links(frame)).collect()}
    named = _plain_components(ids)
    together = {}
    for p, i in signed.items():
        together.setdefault(groups.get(p, p), set()).add(named[i])
    assert all(len(s) == 1 for s in together.values())
    assert len(together) == len(set(named.values()))


def test_walk_runs_over_batches():
    """One key over several batches, and several keys in one."""
    import pyarrow as pa

    keys = [1] * 5 + [2] + [3] * 4
    prints = [0, 1, 3, 255 << 20, 7, 9, 0, 1, 1 << 40, 5]
    cut = [pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(prints[a:b], pa.int64())], ["key", "fp"]) for a, b in [(0, 2), (2, 4), (4, 4), (4, 8), (8, 10)]]
    links = [tuple(r.values()) for b in simhash._links_by_key(iter(cut)) for r in b.to_pylist()]
    assert sorted(map(sorted, links)) == [[0, 1], [0, 1], [0, 3], [0, 5], [0, 7], [0, 1 << 40]]


def test_a_dense_group_needs_few_links():
    chosen = np.random.default_rng(0)
    flips = chosen.integers(0, 1 << 12, 5000)
    prints = np.unique(flips)
    a, b = simhash.walked_links(prints)
    assert len(a) == len(prints) - 1 == len(set(b.tolist()))


@pytest.mark.parametrize("shape", ["path", "star", "ring"])
def test_components(spark, shape):
    n = 40
    links = {
        "path": [(i, i + 1) for i in range(n)],
        "star": [(n, i) for i in range(n)],
        "ring": [(i, (i + 7) % n) for i in range(n)],
    }[shape] + [(100, 101), (101, 100), (102, 102)]
    made = {r["node"]: r["label"] for r in least_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(label == (0 if node < 100 else 102 if node == 102 else 100) for node, label in made.items())


def test_one_document_of_each_group_stays(documents, sentences):
    text = sentences(1, 80)
    docs = documents([(7, text), (5, text), (5, text), (6, sentences(2, 80)), (8, ""), (9, None)])
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [5, 6, 8]


def test_unlinked_texts_without_an_id_or_with_one_id_all_stay(documents, sentences):
    a, b, c, d = (sentences(k, 80) for k in range(1, 5))
    kept = simhash.one_of_each(documents([(None, a), (None, b), (None, b), (4, c), (4, d), (4, d), (5, d)])).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(None, a), (None, b), (4, c), (4, d)])


def test_repeated_passages_go(spark, documents, folder, sentences):
    """A long line, and a block of short ones, in many documents at shifted places."""
    long_line = sentences(1, 60)
    block = [sentences(10 + k, 6) for k in range(14)]
    texts = []
    for i in range(12):
        own = [sentences(1000 + 20 * i + k, 9) for k in range(5 + i)]
        at = i % 4
        texts.append("\n".join([*own[:at], long_line, *own[at:], *block, sentences(5000 + i, 7)]))
    texts.append("no repeats here\nnone at all")
    made = {r["doc_id"]: r for r in queries.op3_line_dedup(spark, folder(documents=documents(texts))).collect()}
    assert made[0]["text"] == texts[0] and made[12]["text"] == texts[12]
    for i in range(1, 12):
        kept, all_lines = made[i]["text"].split("\n"), texts[i].split("\n")
        assert long_line not in kept
        assert sum(line in kept for line in block) <= 6
        assert [line for line in all_lines if line not in block and line != long_line] == [
            line for line in kept if line not in block
        ]
        assert made[i]["n_lines"] - made[i]["n_removed_lines"] == len(kept)


@pytest.mark.parametrize("width", [8, 12, 18])
def test_wrapped_passages_of_over_fifty_words_go(width, documents, sentences):
    """Whatever stands around them, also with a short last line and a blank one inside."""
    texts, passages = [], []
    for i in range(30):
        words = sentences(7000 + i, 51 + i % 10).split()
        passage = [" ".join(words[k : k + width]) for k in range(0, len(words), width)]
        passages.append(passage[:1] + [""] * (i % 2) + passage[1:])
        for j in range(2):
            own = [sentences(100 * (2 * i + j) + k, 5 + (i + k) % 9) for k in range(6)]
            texts.append("\n".join([*own[:3], *passages[-1], *own[3:]]))
    made = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(texts)).collect()}
    for i, passage in enumerate(passages):
        own = texts[2 * i + 1].split("\n")
        assert made[2 * i]["text"] == texts[2 * i]
        assert made[2 * i + 1]["text"].split("\n") == own[:3] + own[-3:]
        assert made[2 * i + 1]["n_removed_lines"] == len(passage)


def test_a_passage_stays_once_within_a_text(sentences):
    own, other = [sentences(k, 9) for k in range(7)], [sentences(50 + k, 11) for k in range(3)]
    kept, lines, removed = line_dedup.without_chunks("\n".join([*own, *other, *own]), set())
    assert kept.split("\n") == [*own, *other] and (lines, removed) == (17, 7)


def test_line_dedup_equals_a_plain_version(documents, sentences):
    chosen = random.Random(3)
    pool = [sentences(i, chosen.randint(0, 30)) for i in range(40)]
    texts = [(i // 2 if i < 6 else i, "\n".join(chosen.choices(pool, k=chosen.randint(1, 25)))) for i in range(60)]
    texts += [(None, texts[0][1]), (None, texts[0][1]), (90, None), (91, ""), (92, texts[7][1])]
    rows = line_dedup.dedup_lines(documents(texts)).collect()
    chunks = {}
    for doc, text in texts:
        if doc is not None and text is not None:
            lines = text.split("\n")
            for start, end, key in line_dedup.line_chunks(lines):
                if key is not None:
                    chunks.setdefault("\n".join(lines[start:end]), set()).add(doc)
    wanted = []
    for doc, text in texts:
        if text is None:
            wanted.append((doc, None))
            continue
        lines, kept, seen = text.split("\n"), [], set()
        for start, end, key in line_dedup.line_chunks(lines):
            own = "\n".join(lines[start:end])
            repeated = key is not None and (own in seen or (doc is not None and min(chunks[own]) < doc))
            if not repeated:
                kept += lines[start:end]
            if key is not None:
                seen.add(own)
        wanted.append((doc, "\n".join(kept)))
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(wanted)


def test_a_hash_of_different_bytes_removes_nothing(documents, sentences, monkeypatch):
    docs = documents([sentences(1, 30), sentences(2, 30)]).select(F.col("doc_id").alias("id"), "text")
    rows = line_dedup._chunk_rows(docs, True).withColumn("hash", F.lit(5).cast("long"))
    monkeypatch.setattr(line_dedup, "_chunk_rows", lambda *_: rows)
    assert line_dedup.repeated_chunks(docs).count() == 0


def test_borders_follow_the_lines_alone(sentences):
    lines = [sentences(i, 5) for i in range(200)]
    whole = {lines[e - 1] for _, e, _ in line_dedup.line_chunks(lines)}
    shifted = {lines[50:][e - 1] for _, e, _ in line_dedup.line_chunks(lines[50:])}
    assert {line for line in whole if line in lines[51:]} <= shifted | {lines[50]}


@pytest.mark.parametrize("shard, block", [(8192, 512), (60, 7), (1000, 3)])
def test_top_k_equals_all_pairs(spark, shard, block):
    chosen = np.random.default_rng(shard)
    vectors = chosen.normal(0, 0.3, (400, 6)).round(1).astype(np.float32)
    vectors[100:200] = vectors[100]  # a common vector: ties throughout
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    made = topk.exact_top_k(frame, F.col("vec_id") % 20 == 0, 20, shard, block).collect()
    cells = np.floor(64 * vectors.astype(float)).astype(np.int64)
    for query in range(0, 400, 20):
        scores = cells @ cells[query]
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != query][:20]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in made if r["query_id"] == query)
        assert got == [(k + 1, i, scores[i]) for k, i in enumerate(order)]


def test_large_components_stay_exact(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [2.0**14, -3.0]), (3, [2.0**14, 3.0]), (4, [-(2.0**60), 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = topk.exact_top_k(frame, F.col("vec_id") == 1, 3).orderBy("rank").collect()
    top = 2**46 * 2**20
    top = 2**63 - 1 if top > 2**63 - 1 else top
    assert [(r["vec_id"], r["score"]) for r in made] == [(2, top), (3, top), (4, -(2**63))]


def test_boxes_bound_their_vectors():
    chosen = np.random.default_rng(5)
    points, asked = chosen.integers(-50, 50, (1000, 5)).astype(float), chosen.integers(-50, 50, (20, 5)).astype(float)
    tree = topk.BoxTree(points, np.arange(1000))
    bounds = tree.bounds(asked)
    for node, (start, end) in enumerate(tree.spans):
        assert ((tree.points[start:end] @ asked.T).max(axis=0) <= bounds[:, node]).all()


def test_pipeline(spark, documents, labels, folder, sentences):
    """Junk goes, a shared passage stays once, of near copies one stays, data is masked."""
    good = ["\n".join(sentences(i * 30 + k, 12).capitalize() + "." for k in range(10)) for i in range(60)]
    passage = sentences(9999, 60)
    good[5] += "\n" + passage
    good[6] += "\n" + passage
    good[7] += "\nwrite to anne@mail.example.com"
    junk = [" ".join(f"{w}###" for w in sentences(900 + i, 80).split()) for i in range(20)]
    docs = documents(good + [good[3]] + junk)
    marks = labels([(i, 1, 0) for i in range(61)] + [(61 + i, 0, 0) for i in range(20)])
    place = folder(documents=docs, labels=marks)
    kept, frames = spark.read.parquet(f"{place}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, place)
        frames.append(kept.collect())
    by_stage = [{r["doc_id"]: r["text"] for r in rows} for rows in frames[:-1]]
    assert set(by_stage[0]) == set(range(61))
    assert passage in by_stage[1][5] and passage not in by_stage[1][6]
    assert by_stage[1][10] == good[10] and by_stage[1][60].count("\n") < 2
    assert set(range(60)) <= set(by_stage[2])
    assert "[email]" in by_stage[3][7] and by_stage[3][8] == by_stage[2][8]
    packed = frames[-1]
    assert {r["doc_id"] for r in packed} == set(by_stage[3])
    whole = corpus_pipeline.run(spark, place).collect()
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in whole) == Counter(
        (r["doc_id"], r["length"], r["ids_crc32"]) for r in packed
    )
