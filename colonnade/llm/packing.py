"""Packing documents into sequences by a grouping genetic algorithm.

A document's ids end with a separator id. Longer ones than a sequence are cut into full
pieces, the first of which may be shorter; full pieces are sequences of their own, the rest
is to be packed into as few sequences as possible.

Pieces are dealt into shards of about ``SHARD`` open pieces. Pieces of equal length are
interchangeable, so a shard is a table of lengths with counts, and a solution is a list of
bins of lengths. Each shard evolves on several islands: a child takes whole well-filled bins
of one parent, drops the other's bins that hold the same pieces, and puts displaced pieces
where they fit best. Between the rounds every island gets its neighbour's best solution. A
shard that meets its lower bound is done. The best solution of
each shard is dealt out to its pieces.

Rules: a null text counts as empty (one piece, the separator); every row is packed, repeated
ones too; an empty table gives no rows; null ids are kept as they are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.batches import MOST_TASKS
from colonnade.llm.batches import pieces as cut_batches
from colonnade.llm.byte_ids import ids_with_added
from colonnade.scratch import written

CAPACITY, SEPARATOR = 2_048, 0
SHARD, ISLANDS, ROUNDS = 8_192, 2, 2
POPULATION, GENERATIONS, PATIENCE, INJECTED = 6, 40, 8, 0.3

Bin = tuple[int, ...]  # lengths, descending


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a text and the separator."""
    return np.array([*ids_with_added(text or "", path), SEPARATOR], dtype="<u4")


def document_pieces(frame: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece, with ``ids`` if asked for."""
    schema = T.StructType(
        [frame.schema[id_column], *(T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32"))]
        + [T.StructField("ids", T.BinaryType())] * with_ids
    )
    piece_type = schema.fields[1]
    schema.fields[1] = T.StructField(piece_type.name, T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, text):
            own, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                ids = token_ids(value, path)
                first = len(ids) % capacity or capacity
                ends = [min(first, len(ids)), *range(first + capacity, len(ids) + 1, capacity)]
                for piece, (start, end) in enumerate(zip([0, *ends], ends)):
                    cut = ids[start:end].tobytes()
                    own.append(i)
                    rows.append((piece, start, end - start, zlib.crc32(cut), *([cut] if with_ids else [])))
            arrays = [pa.array(c) for c in zip(*rows)]
            arrays[0] = arrays[0].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), *arrays], names=schema.names)

    return frame.select(id_column, F.col(text).alias(text)).mapInArrow(run, schema)


class OpenBins:
    """Bins with room left, found by the least room that takes a piece."""

    def __init__(self, bins: list[list[int]], capacity: int):
        self.bins, self.by_room, self.rooms = bins, [[] for _ in range(capacity + 1)], 0
        self.capacity = capacity
        for at, own in enumerate(bins):
            self._note(at, capacity - sum(own))

    def _note(self, at: int, room: int) -> None:
        if room:
            self.by_room[room].append(at)
            self.rooms |= 1 << room

    def best_fit(self, length: int) -> None:
        """Put a piece where least room is left, or into a new bin."""
        fitting = self.rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms ^= 1 << room
            self.bins[at].append(length)
        else:
            room, at = self.capacity, len(self.bins)
            self.bins.append([length])
        self._note(at, room - length)


def packed(lengths: list[int], bins: list[Bin], capacity: int) -> list[Bin]:
    """The bins with further pieces added, each where it fits best, in the given order."""
    state = OpenBins([list(b) for b in bins], capacity)
    for length in lengths:
        state.best_fit(length)
    return [tuple(sorted(b, reverse=True)) for b in state.bins]


def fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    """To be made small: bins, then how evenly they are filled."""
    return len(bins), -sum((sum(b) / capacity) ** 2 for b in bins)


def crossover(giver: list[Bin], taker: list[Bin], capacity: int, random: np.random.Generator) -> list[Bin]:
    """Whole well-filled bins of one parent, the other's bins but for those that hold the
    same pieces; pieces displaced with them are put back best-fit, the longest first."""
    ranked = sorted(giver, key=lambda b: capacity - sum(b))
    best = ranked[: max(1, int(len(ranked) * INJECTED * 2))]
    injected = [best[i] for i in np.flatnonzero(random.random(len(best)) < 0.5)]
    doubled = Counter(length for b in injected for length in b)
    kept, displaced = [], []
    for i in random.permutation(len(taker)).tolist():
        own = taker[i]
        if any(doubled[length] > 0 for length in own):
            for length in own:
                if doubled[length] > 0:
                    doubled[length] -= 1
                else:
                    displaced.append(length)
        else:
            kept.append(own)
    return packed(sorted(displaced, reverse=True), injected + kept, capacity)


def mutated(bins: list[Bin], capacity: int, random: np.random.Generator) -> list[Bin]:
    """Some bins, emptier ones rather, are emptied and their pieces put back, the longest
    first with some disorder."""
    count = int(random.integers(2, 4 + len(bins) // 10))
    order = sorted(range(len(bins)), key=lambda i: sum(bins[i]) + capacity * 0.4 * random.random())
    gone = set(order[:count])
    pieces = sorted((length for i in gone for length in bins[i]), key=lambda n: -n * (1 + 0.3 * random.random()))
    kept = [b for i, b in enumerate(bins) if i not in gone]
    return packed(pieces, kept, capacity)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A bound that no solution goes below: total length over capacity, or more where long
    pieces leave each other no room. For each least length, pieces beside which nothing of
    that length fits take a bin each, other long ones too, and the rest fills what is left."""
    number = np.zeros(capacity + 1, dtype=np.int64)
    number[list(counts)] = list(counts.values())
    total = number * np.arange(capacity + 1)
    number, total = np.cumsum(number), np.cumsum(total)  # up to each length
    least, half = np.arange(capacity // 2 + 1), capacity // 2
    alone = number[-1] - number[capacity - least]
    paired = number[capacity - least] - number[half]
    room = paired * capacity - (total[capacity - least] - total[half])
    small = total[half] - np.concatenate([[0], total])[least]
    more = np.maximum(0, -((room - small) // capacity))
    return int((alone + paired + more).max())


def evolved(counts: dict[int, int], elites: list[list[Bin]], seed: int, capacity: int = CAPACITY) -> list[Bin]:
    """The best solution one island finds, from its own population and given elites."""
    random = np.random.default_rng(seed)
    lengths = np.repeat(np.array(list(counts)), list(counts.values())).astype(int)
    lengths = np.sort(lengths)[::-1]
    goal = least_bins(counts, capacity)
    population = [*elites, packed(lengths.tolist(), [], capacity)]

    def rank(bins: list[Bin]) -> tuple[int, float]:
        return fitness(bins, capacity)

    population.sort(key=rank)
    if len(population[0]) <= goal:
        return population[0]
    while len(population) < POPULATION:  # the same rule on slightly mixed orders
        noisy = np.argsort(-lengths * (1 + 0.1 * random.standard_normal(len(lengths))), kind="stable")
        population.append(packed(lengths[noisy].tolist(), [], capacity))
    best, waited = rank(population[0]), 0
    for _ in range(GENERATIONS):
        population.sort(key=rank)
        best, waited = min(best, rank(population[0])), 0 if rank(population[0]) < best else waited + 1
        if len(population[0]) <= goal or waited > PATIENCE:
            break
        a, b = random.choice(min(3, len(population)), 2, replace=False)
        children = [crossover(population[x], population[y], capacity, random) for x, y in ((a, b), (b, a))]
        children += [mutated(population[int(x)], capacity, random) for x in (0, random.integers(len(population)))]
        population = sorted(population + children, key=rank)[:POPULATION]
    return min(population, key=rank)


_SOLUTION = "shard long, island int, turn int, pattern array<int>, times long, bins long, fill double, goal long"


def _solution(shard: int, island: int, turn: int, bins: list[Bin], counts: dict[int, int], capacity: int) -> pd.DataFrame:
    found = Counter(bins)
    size, fill = fitness(bins, capacity)
    return pd.DataFrame(
        {
            "shard": shard, "island": island, "turn": turn, "pattern": [list(b) for b in found], "times": list(found.values()),
            "bins": size, "fill": fill, "goal": least_bins(counts, capacity),
        }
    )


def _island_turn(turn: int, capacity: int):
    """What one island does in a turn, from its lengths and the solutions given to it."""

    def work(key, own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        counts = dict(zip(own["length"].tolist(), own["count"].tolist()))
        elites = [
            [tuple(map(int, p)) for p, n in zip(e["pattern"], e["times"]) for _ in range(n)]
            for _, e in given.groupby("source")
        ]
        bins = evolved(counts, elites, (shard * ISLANDS + island) * ROUNDS + turn, capacity)
        return _solution(shard, island, turn, bins, counts, capacity)

    return work


def evolve_islands(counts: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """The bins of the best solution per shard: (shard, pattern, times). ``counts``: shard,
    length, count of open pieces. Islands are few bytes and much work, so their number of
    partitions is given, lest small ones be merged into one task."""

    def dealt(frame: DataFrame):
        return frame.repartition(min(shards * ISLANDS, MOST_TASKS), "shard", "island").groupBy("shard", "island")

    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    settled = counts.select("shard", islands, "length", "count")
    solved = None
    for turn in range(ROUNDS):
        if solved is None:
            given = settled.sparkSession.createDataFrame([], "shard long, island int, source int, pattern array<int>, times long")
            open_shards = settled
        else:
            unmet = solved.groupBy("shard").agg(F.min(F.col("bins") - F.col("goal")).alias("gap")).where("gap > 0")
            best = solved.where(F.col("turn") == turn - 1).join(unmet, "shard", "left_semi").select("shard", "island", "pattern", "times")
            reached = F.explode(F.array("island", (F.col("island") + 1) % ISLANDS))  # itself and its neighbour
            given = best.select("shard", reached.alias("island"), F.col("island").alias("source"), "pattern", "times")
            open_shards = settled.join(unmet, "shard", "left_semi")
        found = written(
            dealt(open_shards).cogroup(dealt(given)).applyInPandas(_island_turn(turn, capacity), _SOLUTION)
        )
        solved = found if solved is None else written(solved.unionByName(found))
    order = ("bins", "fill", "turn", "island")
    best = solved.groupBy("shard").agg(F.min(F.struct(*order)).alias("best"))
    same = F.struct(*order) == F.col("best")
    return solved.join(best, "shard").where(same).select("shard", "pattern", "times")


def pack_documents(frame: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", with_ids: bool = False, shard: int = SHARD, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its place: (id, piece, start, length, ids_crc32, sequence_id, offset),
    with ``ids`` if asked for."""
    own = written(document_pieces(frame, path, text, id_column, with_ids, capacity))
    is_open = F.col("length") < capacity
    shards = max(1, -(-own.where(is_open).count() // shard))
    dealt = own.withColumn("shard", F.pmod(F.xxhash64(id_column, "piece", "length", "ids_crc32"), F.lit(shards)))
    counts = written(dealt.where(is_open).groupBy("shard", "length").agg(F.count(F.lit(1)).alias("count")))
    bins = written(evolve_islands(counts, shards, capacity))
    schema = T.StructType(
        [*own.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def place(key, rows: pa.Table, patterns: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "ascending"), ("ids_crc32", "ascending"), ("piece", "ascending")])
        lengths = rows["length"].to_numpy()
        waiting: dict[int, list[int]] = {}
        for row, length in enumerate(lengths.tolist()):
            waiting.setdefault(length, []).append(row)
        full = waiting.pop(capacity, [])
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        sequence[full] = np.arange(len(full))
        at = len(full)
        for pattern, times in sorted(zip(patterns["pattern"].to_pylist(), patterns["times"].to_pylist())):
            for _ in range(times):
                past = 0
                for length in pattern:
                    row = waiting[length].pop()
                    sequence[row], offset[row] = at, past
                    past += length
                at += 1
        if any(waiting.values()):
            raise ValueError("a solution leaves pieces unplaced")
        placed = rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + sequence))
        return placed.append_column("offset", pa.array(offset)).select(schema.names)

    return dealt.groupBy("shard").cogroup(bins.groupBy("shard")).applyInArrow(place, schema)
