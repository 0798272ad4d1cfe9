"""Alignment of the tokens of two tokenizers over the same bytes.

A text is encoded as space + text by a byte-level BPE (A) and as text by a sentence-piece
model that puts a space in front itself (B). Texts are cut at single blanks that follow a
non-blank, where both tokenizers begin a new token, and each distinct cut is encoded once
per worker and kept.

Each tokenization is a list of byte ends. Each end of the shorter list is sought in the
longer one from where its cut begins: steps that double until they pass it, then binary
search within the last step. The places found are ranks. Ends that both lists hold cut the
tokens into groups; the difference of consecutive ranks gives the tokens that each token
overlaps.

Corpus-wide counts go by shard, the documents of one piece of a batch: a shard is written
as one row with its distinct id pairs and how many of its documents hold each. The pairs
are summed over shards, and the sums return to the shards that hold the pair, so that a
pair of every document costs a row per shard. A shard's documents then add up what belongs
to their links.

Rules: null and empty texts, and texts whose tokens' bytes differ from space + text, have no
tokens: zeros and an empty digest; every row counts as a document, repeated ones too; null
ids are kept; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from colonnade.llm.batches import pieces, quoted
from colonnade.llm.bpe import Vocabulary
from colonnade.llm.byte_ids import plain_ids
from colonnade.scratch import written

#: Single blanks after a non-blank: a token of either kind begins there and none spans it.
CUT = re.compile(r"(?<=\S) ")
#: Cuts a worker keeps before it starts anew.
MOST_CUTS = 400_000


def galloped(short: np.ndarray, long: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each of the ascending ends in ``short``, how many of ``long`` are smaller; as
    many as ``seeds`` says are known to be. The last one of ``long`` is at least as large
    as any of ``short``. All searches advance together: steps double until they pass the
    end sought, then the last step is halved."""
    low, high, step = seeds - 1, seeds.copy(), 1
    going = np.flatnonzero(long[high] < short)
    while len(going):
        low[going] = high[going]
        high[going] = np.minimum(high[going] + step, len(long) - 1)
        step *= 2
        going = going[long[high[going]] < short[going]]
    going = np.flatnonzero(high - low > 1)
    while len(going):
        middle = (low[going] + high[going]) // 2
        below = long[middle] < short[going]
        low[going[below]] = middle[below]
        high[going[~below]] = middle[~below]
        going = going[high[going] - low[going] > 1]
    return high


@dataclass
class Aligned:
    """Both token lists of a text, the first token of every group on either side with the
    number of tokens at the end, and all links as (place in a, place in b)."""

    a: np.ndarray
    b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def aligned(
    a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray
) -> Aligned:
    """``ends_a`` and ``ends_b`` end alike. The sizes are numbers of tokens by cut: both
    lists have an end after each cut, so a token's search begins where its cut does."""
    turned = len(a) > len(b)
    short, long, own, other = (ends_b, ends_a, sizes_b, sizes_a) if turned else (ends_a, ends_b, sizes_a, sizes_b)
    rank = galloped(short, long, np.repeat(np.cumsum(other) - other, own))
    common = long[rank] == short
    cuts_short = np.concatenate([[0], np.flatnonzero(common) + 1])
    cuts_long = np.concatenate([[0], rank[common] + 1])
    first = np.concatenate([[0], (rank + common)[:-1]])  # the token after the end before
    count = rank - first + 1
    link_short = np.repeat(np.arange(len(short)), count)
    link_long = np.arange(len(link_short)) - np.repeat(np.cumsum(count) - count - first, count)
    if turned:
        return Aligned(a, b, cuts_long, cuts_short, link_long, link_short)
    return Aligned(a, b, cuts_short, cuts_long, link_short, link_long)


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and what they made of known cuts."""

    def __init__(self, byte_path: str, piece_path: str):
        self.path = byte_path
        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        own = Vocabulary(byte_path)
        self.bytes_a = [own.bytes.get(i, b"") for i in range(max(own.bytes) + 1)]
        self.bytes_b = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            hexed = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            self.bytes_b.append(bytes.fromhex(hexed[1]) if hexed else piece.replace("▁", " ").encode())
        self.lengths_a = np.array([len(t) for t in self.bytes_a])
        self.lengths_b = np.array([len(t) for t in self.bytes_b])
        self.blank = self.model.piece_to_id("▁")
        # Each id as text with what follows it: for a comma or bar, for b comma or semicolon
        self.shown = [f"{i}{c}" for size, marks in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for c in marks for i in range(size)]
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def learn(self, cuts: set[str]) -> None:
        """Encode cuts that are not known yet."""
        if len(self.known) > MOST_CUTS:
            self.known.clear()
        new = [c for c in cuts if c not in self.known]
        for cut, b in zip(new, self.model.encode(new, num_threads=1) if new else []):
            spaced = " " + cut
            b = b if cut else [self.blank]
            same = b"".join([self.bytes_b[i] for i in b]) == spaced.encode()
            a = plain_ids(spaced, self.path)
            self.known[cut] = array("i", a).tobytes(), array("i", b).tobytes(), same

    def align(self, text: str | None, cuts: list[str]) -> Aligned | None:
        """None where there are no tokens. The cuts of the text must be known."""
        if not text:
            return None
        all_a, all_b, same = zip(*[self.known[c] for c in cuts])
        a = np.frombuffer(b"".join(all_a), "<i4").astype(np.int64)
        b = np.frombuffer(b"".join(all_b), "<i4").astype(np.int64)
        if not all(same):
            whole = (" " + text).encode()
            if any(b"".join([table[i] for i in ids]) != whole for table, ids in ((self.bytes_a, a), (self.bytes_b, b))):
                return None
        sizes_a, sizes_b = (np.fromiter(map(len, x), np.int64, len(x)) // 4 for x in (all_a, all_b))
        return aligned(a, b, np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b]), sizes_a, sizes_b)

    def groups(self, made: Aligned) -> str:
        """``a1,a2|b1;a3|b2,b3``"""
        size_a, size_b = len(self.bytes_a), len(self.bytes_b)
        last_a, last_b = np.zeros(len(made.a), bool), np.zeros(len(made.b), bool)
        last_a[made.cuts_a[1:] - 1] = last_b[made.cuts_b[1:] - 1] = True
        in_a, in_b = np.diff(made.cuts_a), np.diff(made.cuts_b)
        order = np.empty(len(made.a) + len(made.b), np.int64)
        order[np.arange(len(made.a)) + np.repeat(made.cuts_b[:-1], in_a)] = made.a + size_a * last_a
        order[np.arange(len(made.b)) + np.repeat(made.cuts_a[1:], in_b)] = 2 * size_a + made.b + size_b * last_b
        return "".join(map(self.shown.__getitem__, order.tolist()))[:-1]


@functools.lru_cache(maxsize=2)
def tokenizers_of(byte_path: str, piece_path: str) -> Tokenizers:
    """One per Python worker and pair of files."""
    return Tokenizers(byte_path, piece_path)


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype("<i4").tobytes(), 1)


def _unpacked(value: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(value), "<i4").astype(np.int64)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_shards(frame: DataFrame, byte_path: str, piece_path: str, text: str = "text", id_column: str = "doc_id", with_groups: bool = False) -> DataFrame:
    """A row per shard: its distinct id pairs (a shifted by 32 bits, or b) with how many of
    its documents hold each, and arrays with an entry per document. ``places`` and ``times``
    list the pairs of all documents one after another, ``held`` says how many each has."""
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [T.StructField("shard", T.LongType()), T.StructField("pairs", longs), T.StructField("holders", ints)]
        + [T.StructField("ids", T.ArrayType(frame.schema[id_column].dataType)), T.StructField("held", ints)]
        + [T.StructField(c, longs) for c in _COUNTS]
        + [T.StructField("digests", T.ArrayType(T.StringType()))]
        + [T.StructField("groups", T.ArrayType(T.StringType()))] * with_groups
        + [T.StructField("places", T.BinaryType()), T.StructField("times", T.BinaryType())]
    )
    arrow = to_arrow_schema(schema)

    def shard(tokenizers: Tokenizers, number: int, ids: list, texts: list[str | None]) -> dict:
        cuts = [CUT.split(t) if t else [] for t in texts]
        row = {c: [] for c in ("held", *_COUNTS, "digests", "groups")}
        pairs, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        tokenizers.learn(set(chain.from_iterable(cuts)))
        for value, own in zip(texts, cuts):
            made = tokenizers.align(value, own)
            if made is None:
                counts, shown = (0, 0, 0, 0), ""
                pairs.append(pairs[0])
                times.append(times[0])
            else:
                counts = len(made.a), len(made.b), len(made.cuts_a) - 1, len(made.link_a)
                shown = tokenizers.groups(made)
                met, often = np.unique(made.a[made.link_a] << 32 | made.b[made.link_b], return_counts=True)
                pairs.append(met)
                times.append(often)
            row["held"].append(len(pairs[-1]))
            for name, count in zip(_COUNTS, counts):
                row[name].append(count)
            row["digests"].append(hashlib.sha256(shown.encode()).hexdigest() if shown else "")
            row["groups"].append(shown)
        distinct, place, holders = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
        own = {"shard": number, "pairs": distinct, "holders": holders.astype(np.int32), "ids": ids}
        return row | own | {"places": _packed(np.diff(place, prepend=0)), "times": _packed(np.concatenate(times))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = tokenizers_of(byte_path, piece_path)
        first = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(pieces(batches, "text")):
            row = shard(tokenizers, first + n, batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)

    given = frame.select(frame[quoted(id_column)].alias("id"), frame[quoted(text)].alias("text"))
    return given.mapInArrow(run, schema)


def pair_counts(shards: DataFrame) -> DataFrame:
    """(pair, documents, best): how many documents hold each linked pair of ids, and whether
    that is the most of any pair with its a. An a has at most as many pairs as b has ids."""
    each = shards.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    counted = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("documents"))
    most = F.max("documents").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counted.withColumn("best", F.col("documents") == most)


@dataclass
class Alignment:
    """``documents``: a row per document; ``pairs``: (pair, documents, best)."""

    documents: DataFrame
    pairs: DataFrame


def align_tokens(frame: DataFrame, byte_path: str, piece_path: str, text: str = "text", id_column: str = "doc_id", with_groups: bool = False) -> Alignment:
    """Per document its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256,
    and ``groups`` if asked for."""
    shards = written(aligned_shards(frame, byte_path, piece_path, text, id_column, with_groups))
    pairs = written(pair_counts(shards))
    schema = T.StructType(
        [T.StructField(id_column, frame.schema[id_column].dataType)]
        + [T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_best", "count_sum")]
        + [T.StructField("groups_sha256", T.StringType())]
        + [T.StructField("groups", T.StringType())] * with_groups
    )
    arrow = to_arrow_schema(T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)]))

    def summed(key, known: pa.Table, own: pa.Table) -> pa.Table:
        place = known["place"].to_numpy()
        documents, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        documents[place] = known["documents"].to_numpy()
        best[place] = known["best"].to_numpy()
        row = {name: own[name][0] for name in own.column_names}
        held = row["held"].values.to_numpy()
        times = _unpacked(row["times"].as_py())
        places = np.cumsum(_unpacked(row["places"].as_py()))
        document = np.repeat(np.arange(len(held)), held)

        def per_document(values: np.ndarray) -> np.ndarray:
            total = np.zeros(len(held), np.int64)
            np.add.at(total, document, times * values[places])
            return total

        columns = [row["ids"].values, *(row[c].values for c in _COUNTS), per_document(best), per_document(documents), row["digests"].values]
        columns += [row["groups"].values] if with_groups else []
        return pa.Table.from_arrays([pa.chunked_array([pa.array(c) if isinstance(c, np.ndarray) else c]).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    wanted = shards.select("shard", F.posexplode("pairs").alias("place", "pair"))
    known = wanted.join(pairs, "pair").select("shard", "place", "documents", "best").toDF("of", "place", "documents", "best")
    own = shards.drop("pairs", "holders")
    result = known.groupBy("of").cogroup(own.groupBy("shard")).applyInArrow(
        summed, T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    )
    return Alignment(result.toDF(*schema.names), pairs)
