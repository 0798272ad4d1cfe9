"""Ranked lexical search over sharded inverted lists.

``build_index`` reads every document once and writes one row per shard: the documents in
order of their ids, and for each term the list of its documents with their occurrences.
``search`` ranks all documents for each item. Items are taken in blocks of ``BLOCK`` bytes;
per block one pass over the terms of the index counts the documents of each wanted term, a
second one searches the shards and hands on the best ``k`` per item and task.

In a shard an item's lists are split by length. Short ones are walked term at a time into
accumulators, summed and sorted by document; from there on they are a single iterator whose
bound is its largest sum. This iterator and the long lists are walked together, document at
a time in stretches of ``STRETCH`` documents: a stretch whose bounds add up to less than the
kth best score so far is skipped, and lists that cannot lift a document over that score on
their own add to documents of other lists only. The kth score is carried from shard to
shard. All scores and bounds are integers, so skipping loses nothing.

Rules: null and empty texts have no terms, and such documents and items have no part in a
result; every row is a document, every item row an item, also under repeated or null ids;
equal scores go by id, null ids last; an empty table gives no rows. Only the named columns
are read, so further columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from colonnade.llm.batches import quoted
from colonnade.scratch import written

#: Fixed value: bytes of terms once A-Z are lower-cased; all bytes outside ASCII belong.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of text in a shard and of items in a block.
SHARD, BLOCK = 16 << 20, 4 << 20
#: Documents in a stretch, and the share of a shard's documents that short lists may hold.
STRETCH, SHORT = 128, 0.25


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall(text.lower()) if text else []


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    """Ids and texts of about ``SHARD`` bytes of text at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            value = text.as_py()
            ids.append(own)
            texts.append(value)
            size += len(value or b"")
            if size >= SHARD:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def inverted(ids: list, texts: list[bytes | None]) -> tuple | None:
    """The row of a shard, None where no document has a term."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    kept, lengths, found = [], [], []
    for i in order:
        own = terms_of(texts[i])
        if own:
            kept.append(ids[i])
            lengths.append(len(own))
            found.extend(map(number.__getitem__, own))
    if not kept:
        return None
    names = sorted(number)
    place = np.empty(len(names), np.int64)
    place[[number[n] for n in names]] = np.arange(len(names))
    document = np.repeat(np.arange(len(kept)), lengths)
    keys, times = np.unique(place[found] * len(kept) + document, return_counts=True)
    ends = np.searchsorted(keys, np.arange(1, len(names) + 1) * len(kept))
    docs = (keys % len(kept)).astype("<i4")
    return len(kept), sum(lengths), kept, lengths, names, ends.tolist(), docs.tobytes(), times.astype("<i4").tobytes()


def build_index(frame: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The written index of all documents with at least one term."""
    id_type = frame.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField("documents", T.LongType()),
            T.StructField("occurrences", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("terms", T.ArrayType(T.BinaryType())),
            T.StructField("ends", T.ArrayType(T.LongType())),
            T.StructField("docs", T.BinaryType()),
            T.StructField("times", T.BinaryType()),
        ]
    )
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _shards(batches):
            row = inverted(ids, texts)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=schema.names)

    given = frame.select(frame[quoted(id_column)].alias("id"), frame[quoted(text)].cast("binary").alias("text"))
    return written(given.mapInArrow(run, schema))


class Shard:
    """A shard's lists under the statistics of the whole corpus."""

    def __init__(self, batch: pa.RecordBatch, at: int, wanted: pa.Array, documents: int, occurrences: int):
        row = {name: batch.column(name)[at] for name in ("ids", "lengths", "terms", "ends", "docs", "times")}
        self.ids, self.ends = row["ids"].as_py(), row["ends"].values.to_numpy()
        places = pc.index_in(wanted, value_set=row["terms"].values).to_pylist()
        self.place = {t: i for t, i in zip(wanted.to_pylist(), places) if i is not None}
        self.docs = np.frombuffer(row["docs"].as_buffer(), "<i4")
        self.times = np.frombuffer(row["times"].as_buffer(), "<i4")
        # In Python's integers, which do not overflow
        self.m = np.array([25 + 75 * n * documents // occurrences for n in row["lengths"].as_py()], np.int64)
        self.starts = np.arange(0, len(self.ids), STRETCH)
        self._lists: dict[bytes, tuple] = {}

    def list_of(self, term: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Documents, their impacts before the weight, where stretches begin, and the
        largest impact of each stretch."""
        at = self.place.get(term)
        if at is None:
            return None
        if term not in self._lists:
            own = slice(self.ends[at - 1] if at else 0, self.ends[at])
            docs, tf = self.docs[own].astype(np.int64), self.times[own].astype(np.int64)
            impacts = 1_000_000_000 * tf // (1_000 * tf + 8 * self.m[docs])
            self._lists[term] = (docs, impacts, *self.stretched(docs, impacts))
        return self._lists[term]

    def stretched(self, docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each stretch begins in a list (and its end), and the stretch's bounds."""
        cuts = np.searchsorted(docs, np.append(self.starts, len(self.ids)))
        bounds = np.zeros(len(self.starts), np.int64)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(full):
            bounds[full] = np.maximum.reduceat(scores, cuts[full])
        return cuts, bounds


class Best:
    """The best ``k`` (score, id) of an item; ties go by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.found, self.least = k, [], 1

    def add(self, scores: list[int], ids: list) -> None:
        self.found += [(-s, i is None, 0 if i is None else i) for s, i in zip(scores, ids)]
        self.found.sort()
        del self.found[self.k :]
        if len(self.found) == self.k:
            self.least = -self.found[-1][0]


def search_shard(shard: Shard, weights: dict[bytes, int], best: Best) -> None:
    """Add what the shard holds for an item. ``weights``: weight times repeats by term."""
    lists = [(own, w) for t, w in weights.items() if w and (own := shard.list_of(t)) is not None]
    lists.sort(key=lambda x: len(x[0][0]))
    room, short = SHORT * len(shard.ids), 0
    while short < len(lists) and len(lists[short][0][0]) <= room:
        room -= len(lists[short][0][0])
        short += 1
    iterators = [(docs, impacts * w, cuts, bounds * w) for (docs, impacts, cuts, bounds), w in lists[short:]]
    if short:  # term at a time
        docs = np.concatenate([own[0] for own, _ in lists[:short]])
        scores = np.concatenate([own[1] * w for own, w in lists[:short]])
        met, at = np.unique(docs, return_inverse=True)
        sums = np.zeros(len(met), np.int64)
        np.add.at(sums, at, scores)
        iterators.append((met, sums, *shard.stretched(met, sums)))
    if not iterators:
        return
    bounds = np.array([x[3] for x in iterators])
    total = bounds.sum(axis=0)
    for stretch in np.flatnonzero(total >= best.least):  # document at a time
        if total[stretch] < best.least:
            continue
        own = bounds[:, stretch]
        order = np.argsort(-own, kind="stable")
        left = np.cumsum(own[order][::-1])[::-1]  # what this list and those after it can add
        first = int(shard.starts[stretch])
        sums = np.zeros(min(STRETCH, len(shard.ids) - first), np.int64)
        for i, x in enumerate(order):
            if not own[x]:
                break
            docs, scores, cuts, _ = iterators[x]
            part = slice(cuts[stretch], cuts[stretch + 1])
            at, add = docs[part] - first, scores[part]
            if left[i] < best.least:  # on its own it lifts nothing over the kth score
                live = sums[at] + left[i] >= best.least
                at, add = at[live], add[live]
            sums[at] += add
        hits = np.flatnonzero(sums >= best.least)
        if len(hits):
            best.add(sums[hits].tolist(), [shard.ids[first + h] for h in hits])


def _blocks(items: DataFrame) -> Iterator[list[Row]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append(row)
        size += len(row["text"] or b"")
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def document_counts(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each wanted term; terms without any are left out."""

    among = pa.array(sorted(wanted), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1)):
                held = np.diff(ends.values.to_numpy(), prepend=0)
                met = pc.is_in(terms.values, value_set=among)
                yield pa.RecordBatch.from_arrays([terms.values.filter(met), pa.array(held).filter(met)], names=["term", "documents"])

    counts = index.select("terms", "ends").mapInArrow(run, "term binary, documents long")
    return {bytes(r["term"]): r["n"] for r in counts.groupBy("term").agg(F.sum("documents").alias("n")).collect()}


def _search_block(index: DataFrame, block: list[Row], documents: int, occurrences: int, k: int, schema: T.StructType) -> DataFrame:
    queries = [(row["number"], row["id"], Counter(terms_of(row["text"] and bytes(row["text"])))) for row in block]
    held = document_counts(index, {t for *_, own in queries for t in own})
    wanted = pa.array(sorted(held), pa.binary())
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in held.items()}
    queries = [(n, i, {t: weight[t] * times for t, times in own.items() if t in weight}) for n, i, own in queries]
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch, i, wanted, documents, occurrences)
                for own, (_, _, weights) in zip(best, queries):
                    search_shard(shard, weights, own)
        rows = [
            (number, item, None if null else found, -score)
            for own, (number, item, _) in zip(best, queries)
            for score, null, found in own.found
        ]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=schema.names)

    found = index.select("ids", "lengths", "terms", "ends", "docs", "times").mapInArrow(run, schema)
    by_rank = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    ranked = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return written(ranked.select("item", "rank", "found", "score"))


def search(
    index: DataFrame, items: DataFrame, k: int = 10, text: str = "text", id_column: str = "item_id", found_as: str = "doc_id"
) -> DataFrame:
    """(item id, rank, document id, score) of each item's ``k`` best documents of an index."""

    def named(column: str, cast: str | None = None) -> Column:
        return items[quoted(column)].cast(cast) if cast else items[quoted(column)]

    schema = T.StructType(
        [
            T.StructField("number", T.LongType()),
            T.StructField("item", items.schema[id_column].dataType),
            T.StructField("found", index.schema["ids"].dataType.elementType),
            T.StructField("score", T.LongType()),
        ]
    )
    sizes = index.agg(F.sum("documents"), F.sum("occurrences")).first()
    given = written(
        items.select(F.monotonically_increasing_id().alias("number"), named(id_column).alias("id"), named(text, "binary").alias("text"))
    )
    parts = [_search_block(index, b, sizes[0], sizes[1], k, schema) for b in _blocks(given)] if sizes[0] else []
    if not parts:
        empty = index.sparkSession.createDataFrame([], schema)
        parts = [empty.select("item", F.lit(0).alias("rank"), "found", "score")]
    return reduce(DataFrame.unionByName, parts).toDF(id_column, "rank", found_as, "score")
