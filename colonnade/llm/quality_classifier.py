"""Quality as a sparse ensemble of rules.

Small trees over text statistics are taken apart: the path to each of their nodes is a
conjunction of conditions. A lasso-penalised logistic regression weighs the conjunctions and
leaves few. They are compiled into one Spark column, so scoring never leaves the JVM.

Trees and weights are fitted on at most ``SAMPLE`` labelled rows (the first by a hash of
their id), whose statistics, not texts, reach the driver.

Rules: a null text counts as empty; without labelled rows, or with one class only, every
score is the smoothed share of ones (0.5 without rows); a row labelled twice counts twice,
null labels and null ids never; repeated rows score alike. Columns named like the results
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
#: Trees, their depth, rows each grows on, cuts tried per feature, the lasso's weight.
TREES, DEPTH, ROWS, CUTS, LASSO = 24, 3, 4_000, 24, 0.002

_SPACE = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name, as columns."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    n, chars = F.size(words), F.greatest(F.length(text), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    return {
        "words": n.cast("double"),
        "word_length": F.length(text) / F.greatest(n, F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_words": n / F.greatest(F.size(lines), F.lit(1)),
        "upper": share(r"\p{Lu}"),
        "symbols": share(r"[#*$%&<>^~=_\\/{}\[\]]"),
        "bars": share(r"\|"),
        "shouts": share("[!?]"),
        "stops": share(r"[.,;:]"),
        "digits": share("[0-9]"),
    }


Condition = tuple[int, bool, float]  # feature, above the cut, cut


@dataclass
class RuleEnsemble:
    """Conjunctions of conditions with their weights."""

    features: list[str]
    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def column(self) -> Column:
        """The score over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            met = F.lit(True)
            for feature, above, cut in rule:
                value = F.col(self.features[feature])
                met = met & ((value > cut) if above else (value <= cut))
            total = total + F.when(met, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def score(self, points: np.ndarray) -> np.ndarray:
        """The same over an array."""
        met = indicators(points, [rule for rule, _ in self.rules])
        return 1 / (1 + np.exp(-self.intercept - met @ np.array([w for _, w in self.rules])))


def indicators(points: np.ndarray, rules: list[tuple[Condition, ...]]) -> np.ndarray:
    """One column per rule: 1 where all its conditions hold."""
    out = np.ones((len(points), len(rules)))
    for i, rule in enumerate(rules):
        for feature, above, cut in rule:
            out[:, i] *= (points[:, feature] > cut) == above
    return out


def tree_paths(points: np.ndarray, target: np.ndarray, random: np.random.Generator) -> list[tuple[Condition, ...]]:
    """The paths to all nodes below the root of one tree: splits by least impurity among
    cuts at quantiles, on a random half of the features."""
    paths = []

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            paths.append(path)
        y = target[rows]
        if len(path) == DEPTH or len(rows) < 20 or y.min() == y.max():
            return
        best = (np.inf, 0, 0.0)
        for f in random.permutation(points.shape[1])[: (points.shape[1] + 1) // 2]:
            values = points[rows, f]
            cuts = np.unique(np.quantile(values, np.linspace(0.02, 0.98, CUTS)))
            below = values[:, None] <= cuts
            n, ones = below.sum(axis=0), (below & (y[:, None] == 1)).sum(axis=0)
            rest, other = len(y) - n, y.sum() - ones
            impurity = ones * (n - ones) / np.maximum(n, 1) + other * (rest - other) / np.maximum(rest, 1)
            impurity = np.where((n == 0) | (rest == 0), np.inf, impurity)
            i = int(impurity.argmin())
            best = min(best, (float(impurity[i]), int(f), float(cuts[i])))
        if np.isfinite(best[0]):
            below = points[rows, best[1]] <= best[2]
            grow(rows[below], (*path, (best[1], False, best[2])))
            grow(rows[~below], (*path, (best[1], True, best[2])))

    grow(np.arange(len(points)), ())
    return paths


def lasso_weights(met: np.ndarray, target: np.ndarray, penalty: float = LASSO, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an absolute penalty, by
    accelerated proximal steps."""
    n, k = met.shape
    size = 4 * n / max(np.linalg.norm(met, 2) ** 2 + n, 1.0)
    weights = ahead = np.zeros(k)
    intercept = ahead_intercept = float(np.log((target.sum() + 1) / (n - target.sum() + 1)))
    pace = 1.0
    for _ in range(steps):
        off = 1 / (1 + np.exp(-met @ ahead - ahead_intercept)) - target
        moved = ahead - size * (met.T @ off) / n
        moved = np.sign(moved) * np.maximum(np.abs(moved) - size * penalty, 0)
        moved_intercept = ahead_intercept - size * off.mean()
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved + (pace - 1) / faster * (moved - weights)
        ahead_intercept = moved_intercept + (pace - 1) / faster * (moved_intercept - intercept)
        weights, intercept, pace = moved, moved_intercept, faster
    return weights, float(intercept)


def fit_rules(points: np.ndarray, target: np.ndarray, features: list[str], seed: int = 0) -> RuleEnsemble:
    """Rules from trees on random rows, weighed together on all rows. Classes weigh alike
    in the trees by drawing as many rows of each."""
    ones = int(target.sum())
    if ones in (0, len(target)):
        rate = (ones + 1) / (len(target) + 2)
        return RuleEnsemble(features, [], float(np.log(rate / (1 - rate))))
    random = np.random.default_rng(seed)
    by_class = [np.flatnonzero(target == c) for c in (0, 1)]
    paths: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        rows = np.concatenate([random.choice(own, ROWS // 2) for own in by_class])
        paths |= dict.fromkeys(tree_paths(points[rows], target[rows], random))
    rules = list(paths)
    met = indicators(points, rules)
    _, first = np.unique(met, axis=1, return_index=True)  # rules that mean the same on all rows
    rules, met = [rules[i] for i in sorted(first)], met[:, sorted(first)]
    weights, intercept = lasso_weights(met, target)
    kept = [(rule, float(w)) for rule, w in zip(rules, weights) if w]
    return RuleEnsemble(features, kept, intercept)


def with_statistics(frame: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The frame with one column per statistic, and their names."""
    own = {f"__stat_{name}": column for name, column in statistics(F.col(text)).items()}
    return frame.withColumns(own), list(own)


def train(frame: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> RuleEnsemble:
    """Rules from the labelled rows of ``frame``; ``labels``: doc_id, quality."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    own = frame.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    counted, names = with_statistics(own, "text")
    rows = counted.select("doc_id", "quality", *names).orderBy(F.xxhash64("doc_id"), "doc_id", *names)
    rows = rows.limit(sample).toPandas()
    return fit_rules(rows[names].to_numpy(dtype=float), rows["quality"].to_numpy(dtype=float), names)


def with_quality(frame: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """The frame with ``score``, 0 to 1, higher for better texts."""
    kept = [c for c in frame.columns if c != "score"]
    counted, _ = with_statistics(frame, text)
    return counted.withColumn("score", model.column()).select(*kept, "score")


def accepted(frame: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """The rows whose score is at least one half, with the frame's own columns."""
    counted, _ = with_statistics(frame, text)
    return counted.where(model.column() >= 0.5).select(*frame.columns)
