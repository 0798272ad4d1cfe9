"""Facts about pairs of columns from one scan.

Rows are grouped by the set of columns that are valid in them (a bit mask). The few
groups hold everything a pair needs, so the cost of the scan does not grow with the
number of pairs and nothing is exploded per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.dataset import Dataset, parsing


@dataclass(frozen=True)
class Operand:
    """A column taking part in pairs. ``labels`` lists all values of a categorical one
    (at most 30); ``scale``, by which values are divided, asks for moments of a numeric one."""

    name: str
    kind: str
    labels: tuple[str, ...] = ()
    scale: float | None = None


def operand_value(ds: Dataset, operand: Operand) -> Column:
    """A fixed-width value that is null exactly where the cell is not valid."""
    if operand.kind == "numeric":
        return ds.number(operand.name) + 0.0
    if operand.kind == "datetime":
        return F.unix_micros(ds.instant(operand.name))
    code = F.array_position(F.array(*(F.lit(v) for v in operand.labels)), ds.text(operand.name))
    return F.when(ds.present(operand.name), code)


def pair_facts(ds: Dataset, operands: list[Operand], pairs: list[tuple[int, int]]) -> DataFrame:
    """``(pair, valid_rows, x_varies, y_varies, pearson_r)`` for each pair of operands.

    A side varies when it has two distinct values among the rows valid on both sides.
    ``pearson_r`` is null unless both sides asked for moments.
    """
    ds = parsing(ds, [operand.name for operand in operands if operand.kind != "categorical"])
    places = range(len(operands))
    measured = {i for i in places if operands[i].scale is not None}
    values = ds.frame.select(*(operand_value(ds, operands[i]).alias(f"v{i}") for i in places))
    mask = F.lit(0).cast("bigint")
    for i in places:
        mask = mask + F.when(F.col(f"v{i}").isNotNull(), F.lit(1 << i)).otherwise(0)

    def scaled(i: int) -> Column:
        return F.col(f"v{i}") / operands[i].scale

    joint = [p for p, (i, j) in enumerate(pairs) if i in measured and j in measured]
    by_mask = values.groupBy(mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.min(f"v{i}").cast("string").alias(f"low{i}") for i in places),
        *(F.max(f"v{i}").cast("string").alias(f"high{i}") for i in places),
        # All rows of a mask are valid in the same columns, so these are the pair's own rows.
        *(F.avg(scaled(i)).alias(f"s{i}") for i in measured),
        *(F.var_pop(scaled(i)).alias(f"q{i}") for i in measured),
        *(F.covar_pop(scaled(pairs[p][0]), scaled(pairs[p][1])).alias(f"p{p}") for p in joint),
    )

    def listed(prefix: str, indexes, present) -> Column:
        empty = F.lit(None).cast("double")
        return F.array(*(F.col(f"{prefix}{k}") if k in present else empty for k in indexes))

    everyone = set(places)
    arrays = by_mask.select(
        "mask", "n",
        listed("low", places, everyone).alias("low"),
        listed("high", places, everyone).alias("high"),
        listed("s", places, measured).alias("s"),
        listed("q", places, measured).alias("q"),
        listed("p", range(len(pairs)), set(joint)).alias("p"),
    )
    wanted = F.array(
        *(
            F.struct(
                F.lit(p).alias("pair"), F.lit(i).alias("i"), F.lit(j).alias("j"),
                F.lit((1 << i) | (1 << j)).cast("bigint").alias("need"),
            )
            for p, (i, j) in enumerate(pairs)
        )
    )
    usable = F.filter(wanted, lambda w: w["need"].bitwiseAND(F.col("mask")) == w["need"])
    each = arrays.withColumn("w", F.explode(usable))

    def at(array: str, index: str) -> Column:
        return F.get(F.col(array), F.col(f"w.{index}"))

    def varies(side: str) -> Column:
        same = F.bool_and(at("low", side) == at("high", side))
        return ~(same & (F.min(at("low", side)) == F.max(at("low", side))))

    facts = each.groupBy("w.pair").agg(
        F.sum("n").alias("valid_rows"),
        varies("i").alias("x_varies"),
        varies("j").alias("y_varies"),
        F.collect_list(  # one entry per mask that holds the pair
            F.struct(
                "n", at("s", "i").alias("mx"), at("s", "j").alias("my"),
                at("q", "i").alias("vx"), at("q", "j").alias("vy"), at("p", "pair").alias("c"),
            )
        ).alias("parts"),
    )
    n = F.col("valid_rows")

    def total(term) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda acc, m: acc + m["n"] * term(m))

    mean_x, mean_y = total(lambda m: m["mx"]) / n, total(lambda m: m["my"]) / n
    facts = facts.withColumns({"mean_x": mean_x, "mean_y": mean_y})
    off_x, off_y = (lambda m: m["mx"] - F.col("mean_x")), (lambda m: m["my"] - F.col("mean_y"))
    covariance = total(lambda m: m["c"] + off_x(m) * off_y(m))
    spread_x = total(lambda m: m["vx"] + off_x(m) * off_x(m))
    spread_y = total(lambda m: m["vy"] + off_y(m) * off_y(m))
    r = F.try_divide(covariance, F.sqrt(spread_x) * F.sqrt(spread_y))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    testable = (n >= 3) & F.col("x_varies") & F.col("y_varies") & ~F.isnan(r)
    return facts.select(
        "pair", "valid_rows", "x_varies", "y_varies",
        F.when(testable, bounded).alias("pearson_r"),
    )
