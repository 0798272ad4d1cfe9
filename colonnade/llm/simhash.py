"""SimHash fingerprints, and all links between those that differ in few bits.

A fingerprint is eight bytes at fixed positions. Two that differ in at most ``BITS`` bits
share at least 8 - ``BITS`` of them, in place. An index from (position, byte) to fingerprints
would tally shared bytes pair by pair, but has only 2,048 lists, whose pairs grow with the
square of the corpus. The lists are therefore met in every choice of 8 - ``BITS`` positions:
a key is a choice with its bytes, and exactly the pairs that reach the minimum tally meet
under some key. They are verified by counting bits.

Equal fingerprints are one entry. Under a key no pairs are listed: a search walks from
fingerprint to fingerprint and keeps the links it walks, enough to hold the group together.
Components come from rounds of least labels with shortcuts, each round a written table.

Rules: a null text counts as empty; texts without words have fingerprint zero and link like
any other; words end at ASCII blanks; only A-Z are lower-cased; a component is named by its
least non-null id (null if it has none); repeated rows are one group. Columns named like
the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.batches import with_results
from colonnade.llm.components import least_reachable
from colonnade.scratch import written

WORDS, SEED, BITS = 4, 42, 4


def text_fingerprint(text: str | None) -> int:
    """64 bits, signed: each set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WORDS, len(words)) - 1
    pairs = zip(starts[: len(words) - width].tolist(), ends[width:].tolist())
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in pairs])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big", signed=True)


def with_fingerprints(frame: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The frame with ``fp``, the fingerprint as a signed long."""

    def make():
        return lambda texts: ([text_fingerprint(t) for t in texts],)

    return with_results(frame, text, [("fp", T.LongType())], make, keep)


def walked_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``BITS`` among distinct fingerprints, as many as hold together what is
    linked: each one is reached once. Memory grows with the number of fingerprints only."""
    left = prints.astype(np.uint64)
    froms, tos = [], []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            near = np.bitwise_count(left ^ one) <= BITS
            if near.any():
                reached, left = left[near], left[~near]
                froms.append(np.full(len(reached), one))
                tos.append(reached)
                frontier.extend(reached)
    if not froms:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(froms).view(np.int64), np.concatenate(tos).view(np.int64)


def _links_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key; a key's fingerprints may run over several."""
    rest_keys = rest = np.empty(0, np.int64)

    def linked(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        found = [walked_links(prints[s : s + n]) for s, n in zip(starts[sizes > 1], sizes[sizes > 1])]
        found = [f for f in found if len(f[0])]
        if found:
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held = []
    for batch in batches:
        keys, prints = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(keys):
            continue
        if len(rest_keys) and rest_keys[-1] == keys[0] == keys[-1]:  # all of one key so far
            held.append(prints)
            continue
        keys = np.concatenate([np.repeat(rest_keys[-1:], sum(map(len, held)) + len(rest)), keys])
        prints = np.concatenate([rest, *held, prints])
        held, last = [], np.searchsorted(keys, keys[-1])
        if last:
            yield from linked(keys[:last], prints[:last])
        rest_keys, rest = keys[-1:], prints[last:]
    prints = np.concatenate([rest, *held])
    if len(prints):
        yield from linked(np.repeat(rest_keys[-1:], len(prints)), prints)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b) fingerprints that link, enough to connect every group. ``distinct``: fp, each
    once."""
    masks = [
        sum(0xFF << 8 * (7 - p) for p in chosen) for chosen in combinations(range(8), 8 - BITS)
    ]
    keys = [
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)))
        for i, m in enumerate(masks)
    ]
    keyed = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    met = keyed.repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(_links_by_key, "a long, b long").distinct()


def _grouped(frame: DataFrame, text: str, id_column: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns ``keep`` with ``fp``; and (fp, least, label): each fingerprint's least id
    and the least fingerprint that it reaches, which marks its component with or without ids."""
    marked = written(with_fingerprints(frame, text, list(dict.fromkeys([*keep, id_column]))))
    distinct = written(marked.groupBy("fp").agg(F.min(id_column).alias("least")))
    links = written(fingerprint_links(distinct.select("fp")))
    groups = least_reachable(links)
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    return marked, named


def near_duplicates(frame: DataFrame, text: str = "text", id_column: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The frame with ``fp`` and ``component_id``, the least id reachable by links."""
    kept = [c for c in (frame.columns if keep is None else keep) if c not in ("fp", "component_id")]
    marked, named = _grouped(frame, text, id_column, kept)
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    components = written(named.join(least, "label").select("fp", "component_id"))
    return marked.join(components, "fp").select(*kept, "fp", "component_id")


def one_of_each(frame: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The frame's rows, one per component: that of the least id, then of the least text
    digest; among equal rows one stays. Without any id in a component, the least digest.
    Components are told apart by their links, not by ids: unlike texts that share an id, or
    have none, are components of their own."""
    columns = frame.columns
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    marked, named = _grouped(frame.withColumn("__digest", digest), text, id_column, [id_column, "__digest"])
    rank = F.struct(F.col(id_column).isNull(), F.col(id_column), F.col("__digest"))
    marked = marked.join(written(named.select("fp", F.col("label").alias("__label"))), "fp")
    best = marked.groupBy("__label").agg(F.min(rank).alias("best"))
    chosen = written(best.select(F.col("best").getField(id_column).alias("__id"), F.col("best")["__digest"].alias("__digest")).distinct())
    rows = frame.withColumn("__digest", digest)
    rows = rows.join(chosen, rows[id_column].eqNullSafe(chosen["__id"]) & (rows["__digest"] == chosen["__digest"]), "left_semi")
    return rows.dropDuplicates([id_column, "__digest"]).select(*columns)
