"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, each hashed to one of 2**20 buckets. The machine scores
single buckets and, by the product of short factors, every pair of buckets, so that a word
that is harmless alone can count beside another. All buckets of the training rows are
examined, and every term above chance is taken, without a cap: by its own link with the label,
or by its part in the directions in which pairs of terms go together with the label, found by
power iteration over the sparse rows and held against shuffled labels. Steps that begin at
random do not find a pair of harmless words among thousands; these begin in the directions.

Training takes at most ``SAMPLE`` labelled rows, the first by a hash of their id, and of these
as many as have ``ENTRIES`` terms together; their buckets reach the driver, never texts. Scoring reads all
terms of every whole text; terms that chance explains weigh nothing.

Rules: a null text counts as empty and scores like a text without known terms; without
labelled rows of both classes every score is the smoothed share of ones; null labels and
ids are left out; a row labelled twice counts twice; repeated rows score alike; a term
counts once, however long the text. Columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.batches import quoted
from colonnade.scratch import written

SAMPLE, BUCKETS = 20_000, 1 << 20
#: Terms of all training rows together, and terms scored at a time.
ENTRIES, PIECE = 6_000_000, 500_000
#: Letters of a word's beginning that make a term of their own.
BEGINNINGS = (4, 5, 6)
FACTORS, EPOCHS, BATCH, PACE, DECAY = 8, 30, 256, 0.02, 2e-4
#: Rounds of the power iteration, and the logits of pairs at the start.
ROUNDS, START = 8, 0.5
#: How much stronger than under shuffled labels a direction must be, how sharply terms above
#: and below chance are told apart, and what is left to chance.
MARGIN, SHARP, LEAST_RATE, RARE = 1.5, 3, 0.01, 5


def terms(text: Column) -> Column:
    """The buckets of a text's distinct terms: runs of letters and digits in lower case, and
    the beginnings of the longer ones, which inflected and compound words share."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    words = F.array_distinct(F.filter(words, lambda w: w != ""))
    forms = [words] + [_beginnings(words, n) for n in BEGINNINGS]
    return F.array_distinct(
        F.transform(F.concat(*forms), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    )


def _beginnings(words: Column, length: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) > length)
    return F.array_distinct(F.transform(longer, lambda w: F.concat(F.substring(w, 1, length), F.lit("-"))))


@dataclass
class FactorizationMachine:
    """The buckets above chance, in ascending order, and the weights of each."""

    buckets: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For rows given as their buckets one after another and the number of each."""
        if not len(self.buckets):
            return np.full(len(sizes), self.bias)
        at = np.minimum(np.searchsorted(self.buckets, buckets), len(self.buckets) - 1)
        known = self.buckets[at] == buckets
        row = np.repeat(np.arange(len(sizes)), sizes)[known]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
        return self.bias + _row_sums(self.linear, self.factors, at[known], ends)[0]


def _row_sums(linear: np.ndarray, factors: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the terms of each row add to its logit, and the sum of their factors."""
    rows = len(ends) - 1
    if not len(at):
        return np.zeros(rows), np.zeros((rows, factors.shape[1]))
    filled = np.flatnonzero(ends[1:] > ends[:-1])
    own = factors[at]
    alone = linear[at] - (own**2).sum(axis=1) / 2
    mixed, single = np.zeros((rows, factors.shape[1])), np.zeros(rows)
    mixed[filled] = np.add.reduceat(own, ends[filled], axis=0)
    single[filled] = np.add.reduceat(alone, ends[filled])
    return single + (mixed**2).sum(axis=1) / 2, mixed


class _Rows:
    """Sparse rows of 0 and 1, entries also in the order of their buckets."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray):
        self.local, at = np.unique(at, return_inverse=True)
        self.at = at.astype(np.int32)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(self.at, kind="stable")
        self.rows_by_bucket = self.row[order]
        self.starts = np.searchsorted(self.at[order], np.arange(len(self.local)))

    def mixed(self, weights: np.ndarray) -> np.ndarray:
        """The sum over each row's terms; every row has one."""
        return np.add.reduceat(weights[self.at], self.ends[:-1], axis=0)

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """The sum over each bucket's rows."""
        return np.add.reduceat(weights[self.rows_by_bucket], self.starts, axis=0)


def telling_directions(batches: list[tuple[_Rows, np.ndarray]], mean: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Directions in which pairs of terms go together with the label most, and how much: the
    leading eigenvectors of the label-weighted moments of all pairs of terms around their
    means, by block power iteration, without forming a matrix. Rows weigh by one over their
    terms. A pair whose words are harmless alone stands out here, where single words do not."""
    batches, k = [(rows, off / np.diff(rows.ends)) for rows, off in batches], len(mean)
    alone, weight = np.zeros(k), 0.0
    for rows, off in batches:
        alone[rows.local] += rows.spread(off)
        weight += off.sum()
    own = alone * (1 - 2 * mean) + mean**2 * weight
    shift = np.abs(own).max()
    found = np.linalg.qr(random.normal(size=(k, min(FACTORS, k))))[0]
    for _ in range(ROUNDS):
        image, centre = (shift - own)[:, None] * found, mean @ found
        for rows, off in batches:
            weighted = off[:, None] * (rows.mixed(found[rows.local]) - centre)
            image[rows.local] += rows.spread(weighted)
            image -= np.outer(mean, weighted.sum(axis=0))
        strength = np.linalg.norm(image, axis=0)
        found = np.linalg.qr(image)[0]
    return found, np.maximum(strength - shift, 0)


def telling_terms(batches: list[tuple[_Rows, np.ndarray]], k: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term, 0 to 1, how far it stands above chance, by its own link with the label
    or by its part in the telling directions; the directions; and the mean of each term.
    Directions count where they are stronger than all of the same rows under shuffled labels.
    There is no cap: every term above chance is found."""
    count = sum(len(off) for _, off in batches)
    alone, spread, mean = np.zeros(k), 0.0, np.zeros(k)
    for rows, off in batches:
        alone[rows.local] += rows.spread(off)
        spread += (off**2).sum()
        mean[rows.local] += np.diff(np.append(rows.starts, len(rows.at))) / count
    shuffled = random.permutation(np.concatenate([off for _, off in batches]))
    starts = np.cumsum([0] + [len(off) for _, off in batches])
    by_chance = telling_directions([(rows, shuffled[s : s + len(off)]) for (rows, off), s in zip(batches, starts)], mean, random)[1]
    found, strength = telling_directions(batches, mean, random)
    found = found * np.sqrt(np.where(strength > MARGIN * by_chance.max(), strength, 0) / max(strength.max(), 1e-12))
    varied = np.maximum(mean * (1 - mean), 1e-12)
    chance = 2 * np.log(k + 1)
    single = alone**2 / (spread * varied) / chance
    paired = (found**2).sum(axis=1) / varied
    paired = paired / max(np.median(paired), 1e-300) / chance
    best = np.minimum(np.maximum(single, paired), 1e6) ** SHARP
    return np.where(mean * count > RARE - 0.5, best / (1 + best), 0), found, mean


def fit_sparse(entries: np.ndarray, sizes: np.ndarray, target: np.ndarray, seed: int = 0) -> FactorizationMachine:
    """Logistic loss with decay, by adaptive steps over shuffled batches, for the terms that
    stand above chance, begun in the telling directions. ``entries``: the buckets of all rows,
    one row after another; ``sizes``: how many each row has."""
    random = np.random.default_rng(seed)
    buckets, at = np.unique(entries, return_inverse=True)
    at = at.astype(np.int32)
    ones = float(target.sum())
    bias = float(np.log((ones + 1) / (len(target) - ones + 1)))
    if ones in (0, len(target)) or not len(entries):
        return FactorizationMachine(buckets[:0], bias, np.zeros(0), np.zeros((0, FACTORS)))
    order = random.permutation(len(sizes))
    batches = _batched(at, sizes, target, order)
    share = float(target.mean())
    rate, found, mean = telling_terms([(rows, y - share) for rows, y in batches], len(buckets), random)
    kept = np.flatnonzero(rate > LEAST_RATE)
    if not len(kept):
        return FactorizationMachine(buckets[:0], bias, np.zeros(0), np.zeros((0, FACTORS)))
    del batches
    place = np.full(len(buckets), -1, np.int32)
    place[kept] = np.arange(len(kept))
    row, at = np.repeat(np.arange(len(sizes)), sizes), place[at]
    sizes = np.bincount(row[at >= 0], minlength=len(sizes))
    batches = _batched(at[at >= 0], sizes, target, order)
    rate, mean = rate[kept], mean[kept]
    found = found[kept] * rate[:, None]
    parts = _start(found, mean, bias, batches, random)
    first, second, step = [0 * p for p in parts], [0 * p for p in parts], 0
    for _ in range(EPOCHS):
        for number in random.permutation(len(batches)):
            rows, y = batches[number]
            local, own = rows.local, rate[rows.local]
            alone, pairs = parts[1][local], parts[2][local]
            added, mixed = _row_sums(alone, pairs, rows.at, rows.ends)
            off = (1 / (1 + np.exp(-np.clip(parts[0][0] + added, -30, 30))) - y) / len(y)
            by_bucket = rows.spread(off)
            slopes = [
                (slice(None), 1.0, np.array([off.sum()])),
                (local, own, by_bucket + DECAY * alone),
                (local, own[:, None], rows.spread(off[:, None] * mixed) - by_bucket[:, None] * pairs + DECAY * pairs),
            ]
            step += 1
            for part, once, twice, (where, pace, slope) in zip(parts, first, second, slopes):
                once[where] += 0.1 * (slope - once[where])
                twice[where] += 0.001 * (slope**2 - twice[where])
                moved = once[where] / (1 - 0.9**step) / (np.sqrt(twice[where] / (1 - 0.999**step)) + 1e-8)
                part[where] -= PACE * pace * moved
    return FactorizationMachine(buckets[kept], float(parts[0][0]), parts[1], parts[2])


def _batched(at: np.ndarray, sizes: np.ndarray, target: np.ndarray, order: np.ndarray) -> list[tuple[_Rows, np.ndarray]]:
    """Rows with terms, in batches, in the given order."""
    ends, filled = np.concatenate([[0], np.cumsum(sizes)]), order[sizes[order] > 0]
    parts = [filled[i : i + BATCH] for i in range(0, len(filled), BATCH)]
    return [(_Rows(np.concatenate([at[ends[r] : ends[r + 1]] for r in part]), sizes[part]), target[part]) for part in parts]


def _start(found: np.ndarray, mean: np.ndarray, bias: float, batches: list, random: np.random.Generator) -> list[np.ndarray]:
    """Bias, weights and factors to begin with. The directions hold for terms less their
    means; what that adds to single terms goes to weights and bias."""
    found = np.pad(found, ((0, 0), (0, FACTORS - found.shape[1])))
    square = np.mean([np.mean(_row_sums(0 * mean, found, r.local[r.at], r.ends)[0] ** 2) for r, _ in batches])
    factors = found * np.sqrt(START / np.sqrt(square)) if square > 0 else found
    middle = mean @ factors
    linear = -(factors * (middle - mean[:, None] * factors)).sum(axis=1)
    offset = bias + (middle @ middle - (mean**2 @ factors**2).sum()) / 2
    return [np.array([offset]), linear, factors + random.normal(0, 0.05, factors.shape)]


def train(
    frame: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, entries: int = ENTRIES
) -> FactorizationMachine:
    """A machine from the labelled rows of ``frame``; ``labels``: doc_id, toxic."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    own = frame.select(F.col("doc_id"), frame[quoted(text)].alias("text")).join(F.broadcast(chosen), "doc_id")
    met = own.select(
        F.xxhash64("doc_id").alias("place"), "doc_id", F.col("toxic").cast("int").alias("toxic"),
        F.array_sort(terms(F.col("text"))).alias("buckets"),
    )
    rows = written(met.withColumn("digest", F.xxhash64("buckets")).withColumn("size", F.size("buckets")))
    order = ["place", "doc_id", "toxic", "size", "digest"]
    sizes = [r["size"] for r in rows.select(order).orderBy(order).limit(sample).collect()]
    fitting = int(np.searchsorted(np.cumsum(sizes), entries, side="right"))
    seen = rows.orderBy(order).limit(fitting).select("toxic", "buckets").toArrow().combine_chunks()
    target = seen.column("toxic").to_numpy().astype(float)
    lists = seen.column("buckets").combine_chunks()
    return fit_sparse(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), target)


def with_toxicity(frame: DataFrame, machine: FactorizationMachine, text: str = "text") -> DataFrame:
    """The frame with ``score``, 0 to 1, higher for more toxic texts."""
    small = FactorizationMachine(
        machine.buckets.astype(np.int32), machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32)
    )

    @F.pandas_udf(T.DoubleType())
    def score(buckets: pd.Series) -> pd.Series:
        rows, sizes = buckets.tolist(), np.array([len(b) for b in buckets], dtype=np.int64)
        part = np.cumsum(sizes) // PIECE  # rows are scored a bounded number of terms at a time
        edges = [*np.flatnonzero(np.diff(part, prepend=-1)), len(rows)]
        logits = [
            small.logits(np.concatenate(rows[a:b]), sizes[a:b]) for a, b in zip(edges, edges[1:])
        ]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate([*logits, []]), -500, 500))))

    kept = [frame[quoted(c)] for c in frame.columns if c.lower() != "score"]
    return frame.select(*kept, score(terms(frame[quoted(text)])).alias("score"))
