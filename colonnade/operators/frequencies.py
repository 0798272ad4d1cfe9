"""Value frequencies: the one shuffle from which every per-column result follows.

All cells of a row go through one unpivot as slots of one shape, and one grouped count.
Numbers and dates that are stored as such take eight bytes. A text of at most ``KEY``
characters stands for itself; a longer one is held by its first ``KEY`` characters and a
digest of 128 bits, so that no long text is ever a shuffle key. What the rules say about a
long text is worked out before the shuffle; the text itself is fetched from the row that
holds it first, and only for values that are shown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colonnade.dataset import ROW, Dataset, quoted
from colonnade.functions import finite_or_null, instant_from_text, is_blank, nanosecond_tail
from colonnade.functions import number_from_text, stripped

#: Characters up to which a text is its own key.
KEY = 64
#: Long texts that are fetched by a list of their rows; more are fetched by a join.
FETCHED = 10_000
#: The position of the entry that counts complete rows.
COMPLETE = -1
#: Boolean words are shorter than this.
_WORD = 16
_KINDS = {"l": "long", "d": "double", "s": "string", "h": "long"}


def _family(kind: T.DataType) -> str:
    native = (T.DoubleType, T.TimestampType, T.TimestampNTZType, T.DateType)
    if isinstance(kind, T.IntegralType):
        return "bigint"
    return kind.simpleString() if isinstance(kind, native) else "string"


def _families(ds: Dataset) -> dict[str, list[int]]:
    """Column positions by the type in which their values are counted."""
    found: dict[str, list[int]] = {}
    for i, name in enumerate(ds.columns):
        found.setdefault(_family(ds.types[name]), []).append(i)
    return found


def _nanoseconds(instant: Column, tail: Column | int) -> Column:
    micros = F.unix_micros(instant).cast("decimal(18,0)")
    return (micros * 1000 + tail).cast("decimal(21,0)")


def _start(text: Column) -> Column:
    """The first characters but for blanks, enough to tell the boolean words."""
    return F.substring(stripped(F.coalesce(text, F.lit(""))), 1, _WORD)


def entry_start() -> Column:
    """``_start`` of an entry's whole text."""
    return F.coalesce("start", _start(F.col("value")))


def entry_blank() -> Column:
    """Whether an entry counts cells that are missing."""
    return entry_start() == ""


def entry_unsure() -> Column:
    """Whether an entry's text is long and could by its beginning be blank, a boolean, a
    number or a date: what can be seen is blank, or little, or begins as numbers and dates
    do. ``settled`` reads these texts."""
    seen = stripped(F.col("value"))
    return F.col("cut") & F.col("start").isNull() & ((F.length(seen) < _WORD) | seen.rlike(r"\A[0-9+.,-]"))


def _slot(ds: Dataset, name: str) -> dict[str, Column]:
    """A cell as a long, a double or a text; what is not named is null."""
    family = _family(ds.types[name])
    if family == "bigint":
        return {"l": quoted(name).cast("long")}
    if family == "double":
        return {"d": quoted(name)}
    if family == "date":
        return {"l": F.unix_date(quoted(name)).cast("long")}
    if family != "string":
        return {"l": F.unix_micros(quoted(name).cast("timestamp"))}
    return {"s": ds.text(name)}


def _cut_texts(cells: DataFrame) -> DataFrame:
    """Texts of more than ``KEY`` characters cut, with a digest in ``l`` and ``h``."""
    text, cut = F.col("s"), F.length("s") > KEY
    return cells.select(
        ROW, "column", *(c for c in cells.columns if c not in (ROW, "column", "l", "s")),
        F.substring(text, 1, KEY).alias("s"),
        F.coalesce("l", F.when(cut, F.xxhash64(text))).alias("l"),
        F.when(cut, F.xxhash64(F.lit("second"), text)).alias("h"),
    )


def _counted(ds: Dataset, complete: bool = False) -> DataFrame:
    """``(position, ..., n, first_row)`` for each distinct cell of each column, the key in
    parts; with ``complete`` also the rows without a missing cell, under ``COMPLETE``."""
    slots = {i: _slot(ds, name) for i, name in enumerate(ds.columns)}
    if complete:
        whole = reduce(lambda a, b: a & b, (ds.present(name) for name in ds.columns))
        slots[COMPLETE] = {"l": whole.cast("long")}
    texts = any("s" in slot for slot in slots.values())
    given = [p for p in ("l", "d", "s") if texts and p == "l" or any(p in slot for slot in slots.values())]

    def shaped(slot: dict[str, Column]) -> Column:
        return F.struct(*(slot.get(p, F.lit(None)).cast(_KINDS[p]).alias(p) for p in given))

    cells = [shaped(slot).alias(str(i)) for i, slot in slots.items()]
    long = ds.frame.select(ROW, *cells).unpivot(ROW, [str(i) for i in slots], "column", "cell")
    long = long.select(ROW, "column", *(F.col(f"cell.{p}").alias(p) for p in given))
    long = _cut_texts(long) if texts else long
    parts = [p for p in _KINDS if p in long.columns]
    counted = long.groupBy(F.col("column").cast("int").alias("position"), *parts).agg(
        F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first_row")
    )
    return counted.withColumns({p: F.lit(None).cast(_KINDS[p]) for p in _KINDS if p not in parts})


def _by_family(ds: Dataset, made: dict[str, Column]) -> Column:
    """One column out of an expression per family."""
    families = _families(ds)
    listed = [(made[family], positions) for family, positions in families.items() if family in made]
    if len(families) == 1 and listed:
        return listed[0][0]
    chosen = F.lit(None)
    for column, positions in listed:
        chosen = F.when(F.col("position").isin(positions), column).otherwise(chosen)
    return chosen


def _value(ds: Dataset) -> Column:
    """The text of an entry, of a long one its beginning."""
    l, instant = F.col("l"), F.timestamp_micros(F.col("l"))
    return _by_family(ds, {
        "bigint": l.cast("string"), "double": F.col("d").cast("string"), "string": F.col("s"),
        "date": F.date_from_unix_date(l.cast("int")).cast("string"), "timestamp": instant.cast("string"),
        "timestamp_ntz": instant.cast("timestamp_ntz").cast("string"),
    })


def keyed_frequencies(ds: Dataset) -> DataFrame:
    """``(position, value, cut, n, first_row)``; of values that are ``cut`` the beginning."""
    return _counted(ds).select("position", _value(ds).alias("value"), F.col("h").isNotNull().alias("cut"), "n", "first_row")


def parsed_frequencies(ds: Dataset) -> DataFrame:
    """``keyed_frequencies`` with each distinct value parsed: ``x`` as a number, ``nanos``
    as nanoseconds since 1970 (a timestamp holds microseconds only). Long texts have neither
    until they are ``settled``, which also gives their ``start``. Complete rows are counted
    under ``COMPLETE``."""
    counted = _counted(ds, complete=True).withColumns({"value": _value(ds), "cut": F.col("h").isNotNull()})
    counted = counted.withColumn("short", F.when(F.col("h").isNull(), F.col("s")))
    short, l = F.col("short"), F.col("l")
    number = _by_family(
        ds, {"bigint": l.cast("double"), "double": finite_or_null(F.col("d")), "string": number_from_text(short)}
    )
    counted = counted.withColumn("x", F.when(F.col("position") == COMPLETE, l).otherwise(number).cast("double"))
    # No text is both a number and a date, so dates are tried on the rest only.
    counted = counted.withColumn("t", _by_family(ds, {
        "date": F.date_from_unix_date(l.cast("int")).cast("timestamp"), "timestamp": F.timestamp_micros(l),
        "timestamp_ntz": F.timestamp_micros(l), "string": F.when(F.col("x").isNull(), instant_from_text(short)),
    }).cast("timestamp"))
    tail = F.when(F.col("s").isNotNull(), nanosecond_tail(short)).otherwise(0)
    nanos = F.when(F.col("t").isNotNull(), _nanoseconds(F.col("t"), tail))
    start = F.lit(None).cast("string").alias("start")
    return counted.select("position", "value", "cut", "n", "first_row", "x", nanos.alias("nanos"), start)


def settled(ds: Dataset, parsed: DataFrame) -> DataFrame:
    """Parsed frequencies with what the rules say of the whole text where that was unsure."""
    whole = whole_texts(ds, parsed.where(entry_unsure()), few=True)
    text = F.col("value")
    whole = whole.withColumn("x", number_from_text(text))
    whole = whole.withColumn("t", F.when(F.col("x").isNull(), instant_from_text(text)))
    nanos = F.when(F.col("t").isNotNull(), _nanoseconds(F.col("t"), nanosecond_tail(text)))
    whole = whole.withColumns({"nanos": nanos, "start": _start(text)})
    return parsed.where(~entry_unsure()).unionByName(whole.withColumn("value", F.substring(text, 1, KEY)).drop("t"))


def whole_texts(ds: Dataset, entries: DataFrame, few: bool = False) -> DataFrame:
    """Entries with the whole text of every value that is ``cut``, read from the row that
    holds it first. ``few``: the entries are as many as are shown, so the rows of the long
    ones are listed, if they are no more than ``FETCHED``; all others are met by a join."""
    texts = [i for i in _families(ds).get("string", []) if not isinstance(ds.types[ds.columns[i]], (T.NumericType, T.BooleanType))]
    if not texts:
        return entries
    rows = ds.frame.select(F.col(ROW).alias("_held"), *(ds.text(ds.columns[i]).alias(f"_text{i}") for i in texts))
    if few:
        listed = {r[0] for r in entries.where("cut").select("first_row").distinct().limit(FETCHED + 1).collect()}
        if not listed:
            return entries
        if len(listed) <= FETCHED:
            rows = F.broadcast(rows.where(F.col("_held").isin(list(listed))))
    held = F.coalesce(*(F.when(F.col("position") == i, F.col(f"_text{i}")) for i in texts))
    met = entries.join(rows, F.col("cut") & (F.col("first_row") == F.col("_held")), "left")
    return met.withColumn("value", F.when(F.col("cut"), held).otherwise(F.col("value"))).select(*entries.columns)


def value_frequencies(ds: Dataset) -> DataFrame:
    """``(position, value, n, first_row)`` for each distinct cell text of each column.

    The map-side half of the count collapses frequent values before the shuffle, so a value
    held by a third of all rows costs one record per task. Missing cells keep their own
    entries.
    """
    return whole_texts(ds, keyed_frequencies(ds)).select("position", "value", "n", "first_row")


def column_names(ds: Dataset) -> Column:
    """The name that belongs to ``position``."""
    return F.element_at(F.array(*(F.lit(name) for name in ds.columns)), F.col("position") + 1)


def ranked(frame: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows of each group. The bound reaches the map side of the shuffle
    as a group limit, so a group of any size moves at most ``limit`` rows per task."""
    window = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def _present(freq: DataFrame) -> DataFrame:
    return freq.where(~(entry_blank() if "start" in freq.columns else is_blank(F.col("value"))))


def top_values(freq: DataFrame, limit: int = 10, ds: Dataset | None = None) -> DataFrame:
    """Most frequent non-missing values of each column, ties by value. Long texts in ``freq``
    need their dataset: as many as could be among the first by their beginnings are fetched
    before ties are settled."""
    present = _present(freq)
    if ds is not None:
        near = Window.partitionBy("position").orderBy(F.desc("n"), F.asc("value"), F.asc("cut"))
        near_best = present.withColumn("near", F.rank().over(near)).where(F.col("near") <= limit)
        present = whole_texts(ds, near_best.drop("near"), few=True)
    best = ranked(present, ["position"], [F.desc("n"), F.asc("value")], limit)
    return best.select("position", "rank", "value", "n")


def first_values(freq: DataFrame, limit: int, ds: Dataset | None = None) -> DataFrame:
    """First distinct non-missing values of each column in source order."""
    best = ranked(_present(freq), ["position"], [F.asc("first_row")], limit)
    return (whole_texts(ds, best, few=True) if ds is not None else best).select("position", "rank", "value")


def gathered(best: DataFrame, fields: list[str], name: str) -> DataFrame:
    """One array per column from the bounded rows of ``top_values``/``first_values``."""
    rows = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    kept = F.transform(
        rows, lambda r: r[fields[0]] if len(fields) == 1 else F.struct(*(r[f] for f in fields))
    )
    return best.groupBy("position").agg(kept.alias(name))


TOP_TYPE = T.ArrayType(
    T.StructType([T.StructField("value", T.StringType()), T.StructField("n", T.LongType())])
)
