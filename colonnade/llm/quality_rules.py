"""Rules on text statistics, and an isolation forest for what they miss.

Every document gets its statistics. Two rules fail it outright: under fifty words, or more
than half of its words in repeated three-word windows. The forest isolates points by random
splits on rates made from the statistics; short mean paths mean an unusual document. A
second forest sees how far word length, repeated lines and number of words lie from the
usual, over a box that reaches beyond the labelled rows, so that blobs and letters that no
label showed are isolated too. The higher score counts. It
grows on a bounded sample of labelled rows (each tree on 256 good ones); the threshold comes from the scores of all labelled rows: the lowest at which no more than
``spared`` of the good ones are rejected.

Rules: a null text has no words and fails; lines are split at \\n only; rows without a label
or with a null id never calibrate; without labelled good rows nothing is rejected beyond
the two rules. Repeated rows get equal results. Columns named like the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.batches import with_results
from colonnade.scratch import written

# Characters that count as symbols; white space between words.
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"[^ \t-\r]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("symbol_rate", "repeat_rate", "upper_rate", "shout_rate")
SHAPE = ("word_length_log", "dup_line_rate", "n_words_log")
#: How far from the usual the second forest's box reaches at least, in each of ``SHAPE``.
FAR = (6.0, 1.0, 12.0)
#: Shares of good rows below the scores that the two forests' scales are matched at.
MATCHED = (0.997, 0.9995)
SAMPLE, TREES, SUBSAMPLE, DEPTH = 10_000, 100, 256, 12


def repeated_words(words: list[str]) -> int:
    """Words that stand in a three-word window which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = bytearray(len(words))
    again = map((1).__lt__, map(counts.__getitem__, windows))
    for i in compress(range(len(windows)), again):
        covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


def text_statistics(text: str | None) -> tuple:
    """``COUNTS``, then ``RATES``, then ``SHAPE``."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    dup, repeated = len(lines) - len(set(lines)), repeated_words(words)
    rates = (
        symbols / max(chars, 1), repeated / max(n, 1),
        sum(map(str.isupper, words)) / max(n, 1), text.count("!") / max(n, 1),
    )
    shape = (math.log2(chars / n) if n else 0.0, dup / max(len(lines), 1), math.log2(max(n, 1)))
    return (n, chars, symbols, dup, repeated, *rates, *shape)


def with_statistics(frame: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The frame with ``COUNTS`` (long), ``RATES`` and ``SHAPE`` (double) of its texts."""
    fields = [(c, T.LongType()) for c in COUNTS] + [(c, T.DoubleType()) for c in (*RATES, *SHAPE)]

    def make():
        return lambda texts: zip(*map(text_statistics, texts))

    return with_results(frame, text, fields, make, keep)


def _usual_path(n) -> np.ndarray:
    """Mean length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    long = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees over the box that bounds ``points``, grown on ``usual`` points. A split takes a
    random feature and a random place in its node's part of the box, so parts of the box
    that usual points leave empty end in short paths. Trees are arrays: per node a feature
    (-1: leaf), a cut, children, and the path length of a point that ends there."""

    def __init__(self, points: np.ndarray, usual: np.ndarray, trees: int = TREES, seed: int = 0):
        random = np.random.default_rng(seed)
        size = min(SUBSAMPLE, len(usual))
        self.scale = max(float(_usual_path(size)), 1.0)
        self.trees = [
            self._grow(usual[random.choice(len(usual), size, replace=False)], points, random)
            for _ in range(trees if size else 0)
        ]

    @staticmethod
    def _grow(usual: np.ndarray, points: np.ndarray, random) -> tuple[np.ndarray, ...]:
        feature, cut, low, high, length = [], [], [], [], []

        def node(rows: np.ndarray, least: np.ndarray, most: np.ndarray, depth: int) -> int:
            at = len(feature)
            for values in (feature, low, high):
                values.append(-1)
            cut.append(0.0)
            length.append(depth + float(_usual_path(len(rows))))
            if depth < DEPTH and len(rows) > 1:
                f = int(random.integers(len(least)))
                c = float(random.uniform(least[f], most[f]))
                below, inner = rows[:, f] <= c, np.arange(len(least)) == f
                feature[at], cut[at] = f, c
                low[at] = node(rows[below], least, np.where(inner, c, most), depth + 1)
                high[at] = node(rows[~below], np.where(inner, c, least), most, depth + 1)
            return at

        node(usual, points.min(axis=0), points.max(axis=0), 0)
        return tuple(map(np.array, (feature, cut, low, high, length)))

    def score(self, points: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher: isolated sooner."""
        total = np.zeros(len(points))
        for feature, cut, low, high, length in self.trees:
            at = np.zeros(len(points), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                below = points[np.arange(len(points)), np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(below, low[at], high[at]))
            total += length[at]
        return 2.0 ** (-total / (max(len(self.trees), 1) * self.scale))


class TwoForests:
    """A forest on ``RATES`` and one on distances from the usual ``SHAPE``, over all columns
    of ``points``; the second one's scores are shifted onto the first one's scale."""

    def __init__(self, points: np.ndarray, usual: np.ndarray):
        n = len(RATES)
        self.rates = IsolationForest(points[:, :n], usual[:, :n])
        self.middle = np.median(usual[:, n:], axis=0) if len(usual) else np.zeros(len(SHAPE))
        box = np.vstack([self._apart(points), np.zeros(len(SHAPE)), FAR])
        self.shape, self.shift = IsolationForest(box, self._apart(usual)), 0.0
        if len(usual):
            first, second = self.rates.score(usual[:, :n]), self.shape.score(self._apart(usual))
            self.shift = float(np.quantile(first, MATCHED[0]) - np.quantile(second, MATCHED[1]))

    def _apart(self, points: np.ndarray) -> np.ndarray:
        return np.abs(points[:, len(RATES) :] - self.middle)

    def score(self, points: np.ndarray) -> np.ndarray:
        """The higher of both; higher: isolated sooner."""
        first = self.rates.score(points[:, : len(RATES)])
        return np.maximum(first, self.shape.score(self._apart(points)) + self.shift)


def fit_forest(statistics: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> TwoForests:
    """Forests from at most ``sample`` labelled rows that the two rules leave, the first by
    a hash of their id: all of them bound the box, the good ones are the usual points."""
    chosen = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = (
        statistics.where("NOT base_failed").join(F.broadcast(chosen), "doc_id")
        .select("quality", *RATES, *SHAPE).orderBy(F.xxhash64("doc_id"), *RATES, *SHAPE).limit(sample).toPandas()
    )
    points = rows[[*RATES, *SHAPE]].to_numpy(dtype=float)
    return TwoForests(points, points[rows["quality"].to_numpy() == 1])


def with_anomaly(statistics: DataFrame, forest: TwoForests) -> DataFrame:
    """The statistics with ``anomaly``, the forest's score."""

    @F.pandas_udf(T.DoubleType())
    def anomaly(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack(columns)))

    return statistics.withColumn("anomaly", anomaly(*RATES, *SHAPE))


def calibrated(scored: DataFrame, labels: DataFrame, spared: float = 0.003) -> float:
    """The lowest threshold that rejects at most ``spared`` of all good labelled rows that
    the two rules leave."""
    good = (
        scored.where("NOT base_failed").join(labels.where("quality = 1").select("doc_id"), "doc_id")
        .groupBy(F.ceil(F.col("anomaly") * 10_000).alias("step")).count().toPandas()
        .sort_values("step", ascending=False)
    )
    if good.empty:
        return float("inf")
    above = good["count"].cumsum() - good["count"]
    return float(good["step"][above <= spared * good["count"].sum()].min()) / 10_000


def rule_verdicts(frame: DataFrame, labels: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The frame with its statistics, ``base_failed``, ``anomaly`` and ``kept``. The frame
    needs ``doc_id``; ``labels`` has doc_id and quality (1: good)."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = written(with_statistics(frame, text, keep).withColumn("base_failed", failed))
    scored = with_anomaly(counted, fit_forest(counted, labels))
    threshold = calibrated(scored, labels)
    kept = ~F.col("base_failed") & (F.col("anomaly") <= threshold)
    return scored.withColumn("kept", kept)
