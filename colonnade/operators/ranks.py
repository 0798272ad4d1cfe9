"""Exact order statistics without sorting the data.

Entries are counted by a bucket of their key; buckets are ordered like the keys, so a
running total over the (few) buckets tells which one holds a wanted rank. Only those
buckets are looked at again, with finer buckets, until one key is left or the rest fits
one task. Every round is a scan with a partially aggregated count: no data-sized
shuffle, no unbounded group, and only wanted buckets reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from colonnade.small import small_table

FINE_BUCKETS = 1024
PER_OCTAVE = 16


def log_linear(key: Column) -> Column:
    """Order-preserving bucket for doubles: 16 equal parts of each power of two."""
    size = F.abs(key)
    octave = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * PER_OCTAVE)
    place = (octave + 1100) * PER_OCTAVE + part
    return F.when(key == 0, F.lit(0)).otherwise(F.signum(key) * place).cast("bigint")


def even(key: Column, low: Column, high: Column, buckets: int = FINE_BUCKETS) -> Column:
    """Order-preserving equal-width bucket of a key between two bounds. The bounds land
    in different buckets, so every round makes progress. Integers are subtracted exactly
    unless they lie too far apart, where doubles are fine enough."""

    def distance(upper: Column) -> Column:
        exact = F.try_subtract(upper, low).cast("double")
        return F.coalesce(exact, upper.cast("double") - low.cast("double"))

    share = F.try_divide(distance(key), distance(high))
    return F.coalesce(F.floor(share * buckets), F.lit(0)).cast("bigint")


def values_at_ranks(
    entries: DataFrame,
    targets: dict[int, list[int]],
    sizes: dict[int, int],
    limit: int,
    first_bucket: Column | None = None,
    unit: bool = False,
) -> dict[tuple[int, int], float]:
    """``{(group, rank): key}`` for zero-based ranks in the order of ``key``.

    ``entries`` holds ``(group, key, n)``, an entry standing for ``n`` equal rows.
    ``sizes`` gives the number of entries of each group; groups above ``limit`` are
    narrowed down first. ``unit`` says that every ``n`` is 1, so a rank can be met by
    equality, which suits long lists of ranks.
    """
    spark = entries.sparkSession
    found: dict[tuple[int, int], float] = {}
    small = [g for g in targets if sizes[g] <= limit]
    large = [g for g in targets if sizes[g] > limit]
    if small:
        chosen = [(g, 0, targets[g]) for g in small]
        picked = small_table(spark, chosen, "group int, before bigint, ranks array<bigint>")
        found |= _look_up(entries, ["group"], picked, unit)
    if not large:
        return found
    wanted = small_table(spark, 
        [(g, targets[g]) for g in large], "group int, ranks array<bigint>"
    )
    bucket = log_linear(F.col("key")) if first_bucket is None else first_bucket
    frame = entries.where(F.col("group").isin(large)).withColumn("before", F.lit(0).cast("bigint"))
    keys, level = ["group"], 0
    while True:
        part = f"b{level}"
        frame = frame.withColumn(part, bucket)
        hits = _buckets_with_ranks(frame, keys, part, wanted).collect()
        keys = [*keys, part]
        pending = []
        for hit in hits:
            if hit["low"] == hit["high"]:
                found |= {(hit["group"], rank): hit["low"] for rank in hit["ranks"]}
            else:
                pending.append(hit)
        if not pending:
            return found
        key_types = ", ".join("group int" if k == "group" else f"{k} bigint" for k in keys)
        key_type = frame.schema["key"].dataType.simpleString()
        picked = small_table(spark, 
            [(*(h[k] for k in keys), h["start"], h["low"], h["high"], h["ranks"]) for h in pending],
            f"{key_types}, before bigint, low {key_type}, high {key_type}, ranks array<bigint>",
        )
        frame = frame.drop("before", "low", "high")
        if max(hit["entries"] for hit in pending) <= limit:
            return found | _look_up(frame, keys, picked.drop("low", "high"), unit)
        # At most as many rows as there are wanted ranks, so the broadcast is bounded.
        frame = frame.join(F.broadcast(picked.drop("ranks")), keys)
        bucket = even(F.col("key"), F.col("low"), F.col("high"))
        level += 1


def _buckets_with_ranks(
    frame: DataFrame, keys: list[str], part: str, wanted: DataFrame
) -> DataFrame:
    totals = frame.groupBy(*keys, "before", part).agg(
        F.sum("n").alias("weight"),
        F.count(F.lit(1)).alias("entries"),
        F.min("key").alias("low"),
        F.max("key").alias("high"),
    )
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    inside = F.filter(
        "ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("weight"))
    )
    return (
        totals.withColumn("start", start)
        .join(F.broadcast(wanted), "group")
        .withColumn("ranks", inside)
        .where(F.size("ranks") > 0)
    )


def _look_up(
    frame: DataFrame, keys: list[str], picked: DataFrame, unit: bool
) -> dict[tuple[int, int], float]:
    """Ranks inside groups that are known to fit one task."""
    upto = Window.partitionBy(*keys).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    starts = picked.select(*keys, "before")
    running = frame.drop("before").join(F.broadcast(starts), keys).withColumn(
        "end", F.col("before") + F.sum("n").over(upto)
    )
    if unit:
        ranks = picked.select(*keys, F.explode(F.transform("ranks", lambda r: r + 1)).alias("end"))
        found = running.join(F.broadcast(ranks), [*keys, "end"]).select(
            "group", "key", (F.col("end") - 1).alias("rank")
        )
    else:
        inside = F.filter("ranks", lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end")))
        ranks = picked.select(*keys, "ranks")
        found = running.join(F.broadcast(ranks), keys).select(
            "group", "key", F.explode(inside).alias("rank")
        )
    return {(row["group"], row["rank"]): row["key"] for row in found.collect()}
