"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.scratch import written


def least_reachable(links: DataFrame) -> DataFrame:
    """(node, label) of every node in a link, with the least node it reaches. ``links``:
    (a, b) longs. Each round takes the least label among neighbours, then the label of that
    label; a node with many links is only ever aggregated over."""
    both = written(links.union(links.select(F.col("b"), F.col("a"))).toDF("node", "other").distinct())
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        seen = both.join(labels.toDF("other", "seen"), "other")
        least = seen.groupBy("node").agg(F.min("seen").alias("seen"))
        nearer = labels.join(least, "node").select(
            "node", F.least("label", "seen").alias("nearer"), F.col("label").alias("was")
        )
        jump = labels.toDF("nearer", "further")
        moved = written(
            nearer.join(jump, "nearer", "left").select(
                "node", F.least("nearer", F.coalesce("further", "nearer")).alias("label"), "was"
            )
        )
        changed = moved.where(F.col("label") != F.col("was")).limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
