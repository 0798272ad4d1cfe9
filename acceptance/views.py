"""Text views of the given tables, written once in SQL that both engines accept.

The tables are typed and clean. These views turn whole tables into the kind of text a
delimited file holds: grouped thousands, mixed date layouts, blank and invalid cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colonnade import Dataset


def _text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def _grouped(amount: str) -> str:
    whole = f"CAST(floor({amount}) AS BIGINT)"
    thousands = _text(f"CAST(floor({amount} / 1000) AS BIGINT)")
    return f"concat({thousands}, ',', lpad({_text(f'{whole} % 1000')}, 3, '0'))"


def _iso(date: str) -> str:
    month, day = (f"lpad({_text(f'{part}({date})')}, 2, '0')" for part in ("month", "day"))
    return f"concat({_text(f'year({date})')}, '-', {month}, '-', {day})"


def _slashed(date: str) -> str:
    parts = (_text(f"{part}({date})") for part in ("month", "day", "year"))
    return "concat({}, '/', {}, '/', {})".format(*parts)


SHIPMENTS = {
    "Part Number": "CASE WHEN l_linenumber = 3 AND l_tax >= 0.04 THEN '' "
    "WHEN l_linenumber = 5 AND l_discount >= 0.06 THEN 'bad' "
    f"ELSE {_text('l_partkey')} END",
    "Sales": f"CASE WHEN l_linenumber = 2 AND l_tax >= 0.06 THEN '  ' ELSE {_grouped('l_extendedprice')} END",
    "Quantity": _text("CAST(l_quantity AS BIGINT)"),
    "Net Price": _text("CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT)"),
    "Return Flag": "CASE WHEN l_linenumber = 4 AND l_discount >= 0.07 THEN ' ' ELSE l_returnflag END",
    "Shipped": "CASE WHEN l_quantity = 50 THEN 'unknown' "
    f"WHEN l_linestatus = 'O' THEN {_iso('l_shipdate')} "
    f"WHEN l_returnflag = 'A' THEN {_slashed('l_shipdate')} "
    f"WHEN l_returnflag = 'N' THEN concat({_iso('l_shipdate')}, 'T06:15:00Z') "
    f"ELSE concat({_iso('l_shipdate')}, ' 12:30') END",
    "Is Open": "CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE 'no' END",
    "Note": f"concat('part ', {_text('l_partkey')}, ' from ', {_text('l_suppkey')}, ' in ', {_text('l_orderkey')})",
}
SALES = {
    "Order ID": _text("o_orderkey"),
    "Customer Ref": "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '' "
    "WHEN o_orderpriority = '2-HIGH' AND o_totalprice > 450000 THEN 'n/a' "
    f"ELSE {_text('o_custkey')} END",
    "Total Sales": _grouped("o_totalprice"),
    "Order Date": f"CASE WHEN o_orderstatus = 'P' THEN {_slashed('o_orderdate')} ELSE {_iso('o_orderdate')} END",
    "Status": "CASE WHEN o_totalprice < 20000 THEN ' ' ELSE o_orderstatus END",
    "Priority": "o_orderpriority",
    "Is Urgent": "CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END",
    "Note": f"concat('order ', {_text('o_orderkey')}, ' of ', {_text('o_custkey')})",
}
VIEWS = {"shipments": ("lineitem", SHIPMENTS), "sales": ("orders", SALES)}
ORDER_KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey",
              "events": "event_id", "documents": "doc_id", "supplier": "s_suppkey",
              "sales": "o_orderkey"}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def typed(spark: SparkSession, folder: str, table: str, columns: list[str] | None = None) -> Dataset:
    return Dataset.from_table(read(spark, folder, table), ORDER_KEYS.get(table), columns)


def view(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> Dataset:
    """A text view as a dataset."""
    table, cells = VIEWS[name]
    chosen = columns or list(cells)
    key = ORDER_KEYS.get(name)
    shaped = read(spark, folder, table).selectExpr(
        *([key] if key else []), *(f"{cells[c]} AS `{c}`" for c in chosen)
    )
    return Dataset.from_table(shaped, key, chosen)


def view_sql(name: str, with_key: bool = False) -> str:
    table, cells = VIEWS[name]
    listed = ", ".join(f'{expression} AS "{column}"' for column, expression in cells.items())
    key = f"{ORDER_KEYS[name]}, " if with_key else ""
    return f"SELECT {key}{listed} FROM {table}"
