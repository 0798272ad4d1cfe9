"""Removing blocks of lines that stand in several documents.

Lines are gathered into chunks whose borders follow from the lines themselves: after a line
where a rolling hash over it and the line before hits a given remainder, and around every
long line. So equal passages fall into equal chunks wherever they stand, and inserted lines
move only borders next to them. A chunk of several lines, or of one long line, that occurs
in more than one document stays in the document with the least id; it also stays only once
within a document. Chunks are grouped by hash and bytes together, so only equal bytes ever
count as the same.

A passage of shorter lines may hold no whole chunk. So wherever such lines in a row hold
``PASSAGE`` words, they are also met as windows: from each line on, and up to each line, as
few lines as hold so many words. Every line of a passage that long is in a window that lies
in it, so the passage goes with its edges. Windows first meet as hashes; bytes are sent only
for those in more than one document.

Rules: lines end at \\n; rows that share an id are one document; a row with a null id loses
only repeats within itself and counts for no other; a null text stays null and has no lines;
a document may lose all its lines and becomes an empty text; a hash that stands for
different bytes removes nothing. The order of the lines that stay does not change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.batches import pieces, with_results
from colonnade.scratch import written

#: Words that make a line a chunk of its own; words that a chunk of several lines needs; one
#: in how many lines may end a chunk by its rolling hash.
LONG, LEAST, ENDS = 20, 8, 2
#: Words of a window of lines that are no chunks of their own.
PASSAGE = 50
_BASE, _WRAP = 0x9E3779B97F4A7C15, (1 << 64) - 1


def line_chunks(lines: list[str]) -> list[tuple[int, int, int | None]]:
    """(first line, line after the last, hash) of each chunk; no hash where it is too small
    to count as repeated."""
    words = [len(line.split()) for line in lines]
    hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
    chunks, start, before, total, filled = [], 0, 0, 0, 0
    for i, (count, own) in enumerate(zip(words, hashes)):
        last = i + 1 == len(lines)
        rolled = (before * _BASE + own) & _WRAP
        before = own
        total, filled = total + count, filled + (count > 0)
        full = filled > 1 and total >= LEAST
        if (full and rolled % ENDS == 0) or count >= LONG or last or words[i + 1] >= LONG:
            key = None
            if full or total >= LONG:
                key = xxhash.xxh3_64_intdigest("\n".join(lines[start : i + 1])) - (1 << 63)
            chunks.append((start, i + 1, key))
            start, total, filled = i + 1, 0, 0
    return chunks


def passage_windows(lines: list[str]) -> list[tuple[int, int, int]]:
    """(first line, line after the last, hash) of each window, by first line."""
    words = [len(line.split()) for line in lines]
    windows: set[tuple[int, int]] = set()
    start = 0
    for stop in [*(i for i, count in enumerate(words) if count >= LONG), len(lines)]:
        if sum(words[start:stop]) >= PASSAGE:
            first, total = start, 0
            for i in range(start, stop):  # up to line i
                total += words[i]
                while total - words[first] >= PASSAGE:
                    total -= words[first]
                    first += 1
                if words[i] and total >= PASSAGE:
                    while not words[first]:
                        first += 1
                    windows.add((first, i + 1))
            after, total = start, 0
            for i in range(start, stop):  # from line i on
                while after < stop and total < PASSAGE:
                    total += words[after]
                    after += 1
                if total < PASSAGE:
                    break
                if words[i]:
                    windows.add((i, after))
                total -= words[i]
        start = stop + 1
    if not windows:
        return []
    hashes = b"".join([xxhash.xxh3_64_digest(line) for line in lines])
    return [(a, b, xxhash.xxh3_64_intdigest(hashes[8 * a : 8 * b]) - (1 << 63)) for a, b in sorted(windows)]


def _passage_rows(docs: DataFrame) -> DataFrame:
    """(id, hash) of each window, once per row. ``docs``: id, text."""
    schema = T.StructType([docs.schema["id"], T.StructField("hash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            ids, hashes = [], []
            for row, text in enumerate(piece.column(1).to_pylist()):
                own = {key for _, _, key in passage_windows([] if text is None else text.split("\n"))}
                ids += [row] * len(own)
                hashes += own
            arrays = [piece.column(0).take(pa.array(ids, pa.int64())), pa.array(hashes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def _passage_bytes(docs: DataFrame) -> DataFrame:
    """(id, hash, chunk) of the windows asked for, each text once per row. ``docs``: id,
    text, wanted."""
    schema = T.StructType([docs.schema["id"], T.StructField("hash", T.LongType()), T.StructField("chunk", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            for row, (text, wanted) in enumerate(zip(piece.column(1).to_pylist(), piece.column(2).to_pylist())):
                lines, asked = text.split("\n"), set(wanted)
                own = list({(key, "\n".join(lines[a:b])) for a, b, key in passage_windows(lines) if key in asked})
                arrays = [piece.column(0).take(pa.array([row] * len(own), pa.int64()))]
                arrays += [pa.array([key for key, _ in own], pa.int64()), pa.array([chunk for _, chunk in own], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def gone_passages(docs: DataFrame) -> DataFrame:
    """(id, hashes): windows of each document that one with a lesser id holds too."""
    docs = docs.where(F.col("id").isNotNull())
    met = _passage_rows(docs).groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    met = written(met.where("first < last").select("hash"))
    wanted = written(_passage_rows(docs).join(met, "hash").groupBy("id").agg(F.collect_set("hash").alias("wanted")))
    repeated = written(_repeated(_passage_bytes(docs.join(wanted, "id").select("id", "text", "wanted"))))
    rows = wanted.select("id", F.explode("wanted").alias("hash")).join(repeated, "hash")
    return rows.where(F.col("id") != F.col("first")).groupBy("id").agg(F.collect_set("hash").alias("hashes"))


def _chunk_rows(docs: DataFrame, with_bytes: bool) -> DataFrame:
    """(id, hash) of each chunk that counts, once per row, with its text if asked for.
    ``docs``: id, text."""
    schema = T.StructType([docs.schema["id"], T.StructField("hash", T.LongType())])
    if with_bytes:
        schema.add("chunk", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            ids, hashes, chunks = [], [], []
            for row, text in enumerate(piece.column(1).to_pylist()):
                lines, seen = [] if text is None else text.split("\n"), set()
                for start, end, key in line_chunks(lines):
                    if key is not None and key not in seen:
                        seen.add(key)
                        ids.append(row)
                        hashes.append(key)
                        if with_bytes:
                            chunks.append("\n".join(lines[start:end]))
            arrays = [piece.column(0).take(pa.array(ids, pa.int64())), pa.array(hashes, pa.int64())]
            arrays += [pa.array(chunks, pa.string())] * with_bytes
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(hash, first): chunks in more than one document, with the least id among these."""
    return _repeated(_chunk_rows(docs.where(F.col("id").isNotNull()), True))


def _repeated(rows: DataFrame) -> DataFrame:
    """(hash, first) from (id, hash, chunk)."""
    same = rows.groupBy("hash", "chunk").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    by_hash = same.groupBy("hash").agg(
        F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    return by_hash.where("texts = 1 AND first < last").select("hash", "first")


def without_chunks(text: str | None, gone: set[int], passages: set[int] = frozenset()) -> tuple[str | None, int, int]:
    """The text without chunks and windows of the given hashes and without its own repeats;
    its lines; the lines removed. Of windows that repeat within the text the first stays,
    also where the next one overlaps it."""
    if text is None:
        return None, 0, 0
    lines, seen = text.split("\n"), set()
    removed = bytearray(len(lines))
    for start, end, key in line_chunks(lines):
        if key is not None and (key in gone or key in seen):
            removed[start:end] = b"\1" * (end - start)
        else:
            seen.add(key)
    first: dict[int, tuple[int, int]] = {}
    for start, end, key in passage_windows(lines):
        if key in passages:
            removed[start:end] = b"\1" * (end - start)
        elif key not in first:
            first[key] = start, end
        else:
            at, past = first[key]
            if lines[at:past] == lines[start:end]:
                start = max(start, past)
                removed[start:end] = b"\1" * (end - start)
    kept = [line for line, out in zip(lines, removed) if not out]
    return "\n".join(kept), len(lines), sum(removed)


def dedup_lines(frame: DataFrame, text: str = "text", id_column: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The frame with its text cleared, ``n_lines`` and ``n_removed_lines``."""
    docs = frame.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    repeated = written(repeated_chunks(docs))
    met = _chunk_rows(docs.where(F.col("id").isNotNull()), False).join(repeated, "hash")
    gone = written(
        met.where(F.col("id") != F.col("first")).groupBy("id").agg(F.collect_set("hash").alias("__gone"))
    )  # no more than a document's own chunks
    passages = written(gone_passages(docs)).withColumnRenamed("hashes", "__passages")
    gone = written(gone.join(passages, "id", "full"))
    kept = list(dict.fromkeys([*(frame.columns if keep is None else keep), text]))
    rows = frame.join(gone.withColumnRenamed("id", "__id"), F.col(id_column) == F.col("__id"), "left")
    both = rows.withColumn(
        "__both", F.struct(F.col(text).alias("text"), F.col("__gone").alias("gone"), F.col("__passages").alias("passages"))
    )

    def make():
        def work(values):
            return zip(*(without_chunks(v["text"], set(v["gone"] or ()), set(v["passages"] or ())) for v in values))

        return work

    fields = [(text, T.StringType()), ("n_lines", T.LongType()), ("n_removed_lines", T.LongType())]
    return with_results(both, "__both", fields, make, kept)
