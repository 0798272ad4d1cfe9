"""Exact nearest vectors by inner product, from a KD-tree per shard.

Vectors are dealt into shards, queries into blocks; a task holds one shard and one block. In
a shard, median splits make a tree whose nodes keep the tight box around their vectors. The
greatest inner product a query can have with a box bounds what lies in it; a search opens
boxes from the best bound on and ends when the bound falls below the query's kth score. Each
block is first searched in one shard; the kth scores found there go along to all others, so
those open few boxes. Only scores that can still count are returned and merged.

Rules: components become floor(64 * x) (in double precision); a vector that is null or holds
a null or a non-finite component takes no part, nor does one with a null id; shorter vectors
count as filled up with zeros; rows with the query's id are not its candidates; ties go to
the smaller id; an empty table gives no rows. Scores beyond a long stay at its bounds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.batches import MOST_TASKS
from colonnade.scratch import written

SHARD, BLOCK, LEAF = 8_192, 512, 128
_FOUND = "query_id long, vec_id long, score long"


class BoxTree:
    """Median splits along the widest side of each box. Nodes are numbered from the root;
    leaves hold rows of ``points`` that stand together."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.arange(len(points))
        self.spans, self.children, low, high = [], [], [], []
        todo = [(0, len(points), None, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            at = len(self.spans)
            if parent is not None:
                self.children[parent][side] = at
            own = points[order[start:end]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            self.spans.append((start, end))
            self.children.append([-1, -1])
            if end - start > LEAF:
                middle = (end - start) // 2
                widest = int((high[-1] - low[-1]).argmax())
                part = np.argpartition(own[:, widest], middle)
                order[start:end] = order[start:end][part]
                todo += [(start, start + middle, at, 0), (start + middle, end, at, 1)]
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest possible inner product of each query with each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, query_id: int, bounds: np.ndarray, k: int, least: float):
        """(ids, scores) of the k best rows with at least the score ``least``."""
        ids, scores = np.empty(0, np.int64), np.empty(0)
        heap, bounds, children = [(-bounds[0], 0)], bounds.tolist(), self.children
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            if children[node][0] >= 0:
                for child in children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            start, end = self.spans[node]
            found = self.points[start:end] @ query
            chosen = np.flatnonzero(found >= least)
            if not len(chosen):
                continue
            own = self.ids[start:end][chosen]
            other = own != query_id
            ids, scores = np.concatenate([ids, own[other]]), np.concatenate([scores, found[chosen][other]])
            if len(ids) >= k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                least = max(least, scores[-1])
        return ids, scores


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, vector in enumerate(vectors):
        out[i, : len(vector)] = vector
    return out


def search_shard(shard: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best rows of a shard for each query of a block (columns vec_id, cells; the
    block's also kth, a score that k others reach, or null)."""
    if shard.empty or block.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    width = max(shard["cells"].map(len).max(), block["cells"].map(len).max(), 1)
    points, queries = _matrix(shard["cells"], width), _matrix(block["cells"], width)
    ids, out = shard["vec_id"].to_numpy(np.int64), []
    exact = np.abs(points).max() * np.abs(queries).max() * width < 2.0**52
    tree = BoxTree(points, ids) if exact else None
    bounds = tree.bounds(queries) if exact else None
    kth = block["kth"].fillna(-np.inf).to_numpy(dtype=float)
    for i, query_id in enumerate(block["vec_id"].to_numpy(np.int64)):
        if exact:
            found, scores = tree.search(queries[i], query_id, bounds[i], k, kth[i])
            scores = scores.astype(np.int64)
        else:  # too large for doubles: whole numbers of any size, every row
            large = np.array([[int(c) for c in row] for row in points], dtype=object)
            scores = large.dot(np.array([int(c) for c in queries[i]], dtype=object))
            scores = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in scores], dtype=object)
            order = sorted(np.flatnonzero(ids != query_id), key=lambda r: (-scores[r], ids[r]))[:k]
            found, scores = ids[order], scores[order].astype(np.int64)
        out.append((np.full(len(found), query_id), found, scores))
    query, found, scores = (np.concatenate(part) for part in zip(*out))
    return pd.DataFrame({"query_id": query, "vec_id": found, "score": scores})


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best others for each row that ``is_query``
    holds for. ``vectors``: vec_id, embedding."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cells = F.transform("embedding", lambda x: x.cast("double") * 64)
    rows = written(
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
        .select("vec_id", cells.alias("cells"), is_query.alias("is_query"))
    )
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    shards, blocks = max(1, -(-total["n"] // shard)), max(1, -(-total["q"] // block))
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards))
    candidates = rows.select("vec_id", "cells", part.alias("shard"))
    queries = rows.where("is_query").select(  # columns of their own beside the candidates'
        F.col("vec_id").alias("vec_id"), F.col("cells").alias("cells"),
        F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).alias("block"),
    )
    home = F.pmod(F.col("block"), F.lit(shards))
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))

    def searched(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        def work(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            for side in (own, asked):
                side["cells"] = side["cells"].map(np.floor)
            return search_shard(own, asked, k)

        sides = [  # their number is given, lest groups of few bytes be merged into one task
            side.repartition(min(shards * blocks, MOST_TASKS), "shard", "block").groupBy("shard", "block")
            for side in (candidates, queries)
        ]
        return sides[0].cogroup(sides[1]).applyInPandas(work, _FOUND)

    spread = candidates.withColumn("block", F.explode(every))
    at_home = searched(
        spread.where(home == F.col("shard")),
        queries.withColumn("shard", home).withColumn("kth", F.lit(None).cast("double")),
    )
    first = written(at_home)
    kth = first.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count(F.lit(1)).alias("n"))
    kth = kth.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda s: s != home)
    asked = queries.join(kth, "vec_id", "left").withColumn("shard", F.explode(others))
    rest = searched(spread.where(home != F.col("shard")), asked)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
