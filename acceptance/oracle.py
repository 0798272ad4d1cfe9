"""DuckDB SQL with the answers each query must give."""

from __future__ import annotations

from acceptance.views import SALES, SHIPMENTS, view_sql

# The value rules, restated for DuckDB.
NUMBER = r"[+-]?(?:(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
DATE = r"(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}/\d{1,2}/\d{4})(?:[ T].+)?"
WORDS = "('true','false','yes','no','y','n','t','f')"


def number(cell: str) -> str:
    clean = f"trim({cell})"
    return (
        f"CASE WHEN regexp_full_match({clean}, '{NUMBER}') "
        f"THEN TRY_CAST(replace({clean}, ',', '') AS DOUBLE) END"
    )


def instant(cell: str) -> str:
    clean = f"trim({cell})"
    slashed = r"regexp_replace({0}, '^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})', '\3-\1-\2')".format(clean)
    return (
        f"CASE WHEN regexp_full_match({clean}, '{DATE}') "
        f"THEN TRY_CAST(replace({slashed}, 'Z', '') AS TIMESTAMP) END"
    )


def quoted(name: str) -> str:
    return f'"{name}"'


def cells(source: str, columns: list[str]) -> str:
    """One row per cell."""
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS name, CAST({quoted(c)} AS VARCHAR) AS value FROM {source}"
        for i, c in enumerate(columns)
    )


def facts(source: str, columns: list[str], hinted: str = "") -> str:
    """CTE bodies ``freq`` and ``facts`` over a source that is already defined."""
    boolean_digits = f"position IN ({hinted})" if hinted else "FALSE"
    return f"""freq AS (
      SELECT position, name, value, count(*) AS n, trim(coalesce(value, '')) = '' AS blank,
        lower(trim(value)) AS clean, {number('value')} AS x, {instant('value')} AS t
      FROM ({cells(source, columns)}) GROUP BY position, name, value),
    counted AS (
      SELECT position, name, CAST(sum(n) AS BIGINT) AS rows,
        CAST(coalesce(sum(n) FILTER (blank), 0) AS BIGINT) AS missing_count,
        CAST(count(*) FILTER (NOT blank) AS BIGINT) AS unique_count,
        CAST(coalesce(sum(n) FILTER (x IS NOT NULL), 0) AS BIGINT) AS numeric_valid,
        CAST(coalesce(sum(n) FILTER (t IS NOT NULL), 0) AS BIGINT) AS datetime_valid,
        count(*) FILTER (NOT blank AND clean NOT IN {WORDS}) AS not_word,
        count(*) FILTER (NOT blank AND clean NOT IN ('0','1')) AS not_digit,
        min(x) AS minimum, max(x) AS maximum
      FROM freq GROUP BY position, name),
    facts AS (
      SELECT *, round(missing_count * 100.0 / rows, 2) AS missing_percentage,
        CASE WHEN rows = missing_count THEN 'text'
          WHEN not_word = 0 OR (not_digit = 0 AND {boolean_digits}) THEN 'boolean'
          WHEN numeric_valid >= 0.9 * (rows - missing_count) THEN 'numeric'
          WHEN datetime_valid >= 0.9 * (rows - missing_count) THEN 'datetime'
          WHEN unique_count <= 0.5 * (rows - missing_count) THEN 'categorical'
          ELSE 'text' END AS detected_type
      FROM counted)"""


def over(name: str, with_key: bool = False) -> str:
    columns, hinted = (list(SHIPMENTS), "6") if name == "shipments" else (list(SALES), "6")
    return f"WITH src AS ({view_sql(name, with_key)}), {facts('src', columns, hinted)} "


SHIP, SOLD = over("shipments"), over("sales", True)
MEASURES = ["Part Number", "Sales", "Quantity", "Net Price"]
SALES_FILTER = (
    f"\"Status\" IN ('O', 'P') AND {number(quoted('Total Sales'))} BETWEEN 50000 AND 400000 "
    f"AND CAST({instant(quoted('Order Date'))} AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"
)
PARSED = (
    "parsed AS (SELECT "
    + ", ".join(f"{number(quoted(c))} AS v{i}" for i, c in enumerate(MEASURES))
    + f", {instant(quoted('Shipped'))} AS v4 FROM src)"
)
PAIR_NAMES = [*MEASURES, "Shipped"]


def numeric_rows(source: str, columns: list[str], position: bool = True) -> str:
    """Statistics of numeric columns from their cells."""
    place = "position, " if position else ""
    return f"""SELECT {place}name, count(x) AS count,
      count(*) FILTER (trim(coalesce(value, '')) <> '' AND x IS NULL) AS invalid_count,
      round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median,
      round(stddev_samp(x), 4) AS standard_deviation, round(min(x), 4) AS minimum,
      round(max(x), 4) AS maximum, round(quantile_cont(x, 0.25), 4) AS q1,
      round(quantile_cont(x, 0.75), 4) AS q3
    FROM (SELECT *, {number('value')} AS x FROM ({cells(source, columns)})) GROUP BY position, name"""


def pair_rows(pairs: list[tuple[int, int]], body) -> str:
    return " UNION ALL ".join(
        f"SELECT '{PAIR_NAMES[i]}|{PAIR_NAMES[j]}' AS pair, {body(i, j)} "
        f"FROM parsed WHERE v{i} IS NOT NULL AND v{j} IS NOT NULL"
        for i, j in pairs
    )


def ranked_points(grouped: str, order: str) -> str:
    return f"SELECT x, y, row_number() OVER (ORDER BY {order}) - 1 AS position FROM ({grouped})"


def months(columns: list[str], date: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, strftime({instant(quoted(date))}, '%Y-%m') AS month, "
        f"avg({number(quoted(c))}) AS mean, count({number(quoted(c))}) AS valid_rows FROM src "
        f"WHERE {instant(quoted(date))} IS NOT NULL AND {number(quoted(c))} IS NOT NULL GROUP BY month"
        for c in columns
    )


BY_CUSTOMER = (
    "SELECT o_custkey, min(o_orderkey) AS dataset_id, arg_min(o_orderpriority, o_orderkey) AS filename, "
    "count(*) AS row_count, 6 AS column_count FROM orders GROUP BY o_custkey"
)
ORDER_COLUMNS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()
LINE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()
DOCUMENT_COLUMNS = "doc_id text lang source n_chars".split()
METADATA = (
    "SELECT position, name, detected_type, missing_count, missing_percentage, unique_count FROM facts"
)
FIVE_FIRST = """firsts AS (
  SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY first_row) AS rank
  FROM (SELECT name, value, min(k) AS first_row FROM keyed
        WHERE trim(coalesce(value, '')) <> '' GROUP BY name, value)
  QUALIFY rank <= 5)"""


def keyed(source: str, key: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, {key} AS k, CAST({quoted(c)} AS VARCHAR) AS value FROM {source}"
        for c in columns
    )


def candidate_sql() -> str:
    """Kept columns with their kind, valid rows and rank."""
    return """usable AS (
      SELECT position, name,
        CASE WHEN detected_type IN ('categorical', 'boolean') THEN 'categorical' ELSE detected_type END AS kind,
        CASE detected_type WHEN 'numeric' THEN numeric_valid WHEN 'datetime' THEN datetime_valid
          ELSE rows - missing_count END AS valid_rows, rows, unique_count,
        name IN ('Sales', 'Quantity') AS additive
      FROM facts WHERE detected_type <> 'text' AND unique_count >= 2),
    kept AS (
      SELECT *, row_number() OVER (PARTITION BY kind ORDER BY valid_rows DESC, additive DESC, position) - 1 AS rank
      FROM usable)"""


def recommendation_sql() -> str:
    """Candidates in rule order with scores, for the shipments view."""
    columns = list(SHIPMENTS)
    valid = {c: number(quoted(c)) for c in MEASURES}
    valid["Shipped"] = instant(quoted("Shipped"))
    for c in ("Return Flag", "Is Open"):
        valid[c] = f"CASE WHEN trim({quoted(c)}) <> '' THEN {quoted(c)} END"
    flags = ", ".join(f"({e}) IS NOT NULL AS f{columns.index(c)}" for c, e in valid.items())
    pairs = []
    for x in valid:
        for y in MEASURES:
            if x != y:
                i, j = columns.index(x), columns.index(y)
                pairs.append(f"SELECT {i} AS px, {j} AS py, count(*) FILTER (f{i} AND f{j}) AS n FROM flags")
    return f"""{candidate_sql()}, flags AS (SELECT {flags} FROM src),
    pair AS ({' UNION ALL '.join(pairs)}),
    offers AS (
      SELECT 1 AS block, rank AS a, -1 AS b, 'line' AS chart_type, name AS x_column, NULL AS y_column,
        'count' AS aggregation, 0.58 AS base, valid_rows, rows FROM kept WHERE kind = 'datetime'
      UNION ALL
      SELECT 1, d.rank, v.rank, 'line', d.name, v.name, CASE WHEN v.additive THEN 'sum' ELSE 'mean' END,
        0.65, n, d.rows FROM kept d, kept v, pair
        WHERE d.kind = 'datetime' AND v.kind = 'numeric' AND px = d.position AND py = v.position
      UNION ALL
      SELECT 2, rank, -1, 'donut', name, NULL, 'count', 0.54, valid_rows, rows FROM kept
        WHERE kind = 'categorical'
      UNION ALL
      SELECT 2, d.rank, v.rank, 'bar', d.name, v.name, CASE WHEN v.additive THEN 'sum' ELSE 'mean' END,
        0.60, n, d.rows FROM kept d, kept v, pair
        WHERE d.kind = 'categorical' AND v.kind = 'numeric' AND px = d.position AND py = v.position
      UNION ALL
      SELECT 3, rank, -1, 'histogram', name, NULL, 'count', 0.50, valid_rows, rows FROM kept
        WHERE kind = 'numeric'
      UNION ALL
      SELECT 4, d.rank, v.rank, 'scatter', d.name, v.name, 'none', 0.55, n, d.rows FROM kept d, kept v, pair
        WHERE d.kind = 'numeric' AND v.kind = 'numeric' AND d.rank < v.rank
          AND px = d.position AND py = v.position),
    scored AS (
      SELECT *, round(least(1.0, base + 0.2 * valid_rows / rows + 0.1 * least(valid_rows / 30.0, 1)
        + CASE WHEN aggregation = 'sum' THEN 0.05 ELSE 0 END), 4) AS score FROM offers),
    capped AS (
      SELECT *, row_number() OVER (PARTITION BY chart_type ORDER BY score DESC, block, a, b) AS nth FROM scored
      QUALIFY nth <= 2)
    SELECT row_number() OVER (ORDER BY score DESC, block, a, b) - 1 AS position, chart_type,
      CASE WHEN chart_type = 'scatter' THEN y_column || ' vs ' || x_column
        WHEN y_column IS NOT NULL THEN upper(aggregation[1]) || aggregation[2:] || ' ' || y_column || ' by ' || x_column
        WHEN chart_type = 'histogram' THEN 'Distribution of ' || x_column
        ELSE 'Records by ' || x_column END AS title,
      x_column, y_column, aggregation, CAST(score AS DOUBLE) AS score, valid_rows
    FROM capped QUALIFY position < 6"""


def insight_sql() -> str:
    """All rules in order over the shipments view."""
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    correlations = " UNION ALL ".join(
        f"SELECT '{MEASURES[i]}' AS x, '{MEASURES[j]}' AS y, corr(v{i}, v{j}) AS r FROM parsed "
        f"WHERE v{i} IS NOT NULL AND v{j} IS NOT NULL" for i, j in pairs
    )
    fences = " UNION ALL ".join(
        f"""SELECT '{c}' AS name, (SELECT count(*) FROM parsed WHERE v{i} < q1 - 1.5 * (q3 - q1)
          OR v{i} > q3 + 1.5 * (q3 - q1)) AS outside
        FROM (SELECT quantile_cont(v{i}, 0.25) AS q1, quantile_cont(v{i}, 0.75) AS q3 FROM parsed)"""
        for i, c in enumerate(MEASURES)
    )
    return f"""{SHIP}, {PARSED}, rules AS (
      SELECT 1 AS block, row_number() OVER (ORDER BY missing_percentage DESC, position) AS nth, 'missing_data' AS type,
        'Missing values in ' || name AS title, 'warning' AS severity, name AS columns FROM facts WHERE missing_count > 0
      UNION ALL
      SELECT 2, row_number() OVER (ORDER BY numeric_valid DESC, position), 'outlier',
        'Potential outliers in ' || name, 'warning', name
      FROM facts JOIN ({fences}) USING (name) WHERE outside > 0
      UNION ALL
      SELECT 3, row_number() OVER (ORDER BY abs(r) DESC), 'correlation', a || ' and ' || b || ' move together', 'info', a || '|' || b
      FROM (SELECT r, CASE WHEN fx.numeric_valid > fy.numeric_valid OR (fx.numeric_valid = fy.numeric_valid AND fx.position < fy.position) THEN x ELSE y END AS a,
          CASE WHEN a = x THEN y ELSE x END AS b
        FROM ({correlations}) JOIN facts fx ON fx.name = x JOIN facts fy ON fy.name = y WHERE abs(r) >= 0.4)
      UNION ALL
      SELECT 4, row_number() OVER (ORDER BY position), 'top_category', 'Most frequent ' || name, 'info', name
      FROM facts WHERE detected_type IN ('categorical', 'boolean') AND unique_count BETWEEN 2 AND 30
      UNION ALL
      SELECT 5, row_number() OVER (ORDER BY numeric_valid DESC, position), 'trend', 'Monthly change in ' || name, 'info', 'Shipped|' || name
      FROM (SELECT name, numeric_valid, position FROM facts WHERE detected_type = 'numeric' ORDER BY numeric_valid DESC, position LIMIT 2)
      WHERE name IN (SELECT name FROM (
        SELECT name, month, mean, lag(month) OVER w AS before, lag(mean) OVER w AS base,
          row_number() OVER (PARTITION BY name ORDER BY month DESC) AS back
        FROM ({months(MEASURES, 'Shipped')}) WINDOW w AS (PARTITION BY name ORDER BY month))
        WHERE back = 1 AND base <> 0 AND mean <> base
          AND date_diff('month', CAST(before || '-01' AS DATE), CAST(month || '-01' AS DATE)) = 1))
    SELECT row_number() OVER (ORDER BY block, nth) - 1 AS position, type, title, severity, columns FROM rules WHERE nth <= 2"""


def check_sql(dataset: str) -> str:
    """Every check holds, over as many rows as columns, filters and charts of the sales view
    ask for. Filters keep types and recommendations, so both queries have the same counts."""
    whole = ("dimensions", "missing_total")
    by_column = ("unique_bound", "statistics_match", "row_balance")
    by_chart = ("axis_types", "valid_row_bound", "chart_alignment", "chart_points")
    names = ", ".join(
        f"('{name}', '{per}')"
        for per, group in (("whole", whole), ("column", by_column), ("chart", by_chart), ("filter", ("filter_columns",)))
        for name in group
    )
    return f"""{SOLD}, n AS (
      SELECT count(*) FILTER (detected_type = 'datetime') AS d, count(*) FILTER (detected_type = 'numeric') AS q,
        count(*) FILTER (detected_type IN ('categorical', 'boolean')) AS c,
        count(*) FILTER (detected_type IN ('categorical', 'boolean') AND unique_count <= 8) AS s
      FROM facts WHERE unique_count >= 2),
    sizes AS (
      SELECT least(6, least(2, d * (1 + q)) + least(2, s) + least(2, c - s + c * q) + least(2, q)
          + least(2, q * (q - 1) // 2)) AS charts,
        (SELECT count(*) FROM facts) AS columns,
        (SELECT count(*) FROM facts WHERE detected_type IN ('numeric', 'datetime')
          OR (detected_type <> 'text' AND unique_count <= 50)) AS filters FROM n),
    checks (check_name, per) AS (VALUES {names})
    SELECT '{dataset}' AS dataset_id, check_name, TRUE AS ok, CAST(CASE per WHEN 'whole' THEN 1
      WHEN 'column' THEN columns WHEN 'chart' THEN charts ELSE filters END AS BIGINT) AS rows FROM checks, sizes"""


ORACLE = {
    "analysis_checks": check_sql("sales"),
    "filtered_analysis_checks": check_sql("sales, filtered"),
    "insights_all": insight_sql(),
    "csv_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
    "CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer",
    "csv_long_preamble": "SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment FROM customer",
    "csv_malformed_rows": "SELECT fields, count(*) AS records FROM (SELECT 3 + (c_mktsegment = 'MACHINERY')::INT "
    "+ (c_acctbal > 9000)::INT AS fields FROM customer) WHERE fields <> 3 GROUP BY fields",
    "preview_first_rows": f"SELECT o_orderkey AS _row, * EXCLUDE (o_orderkey) FROM ({view_sql('sales', True)}) ORDER BY _row LIMIT 100",
    "missing_cells": f"{SHIP} SELECT name, missing_count AS missing FROM facts",
    "parse_numeric": f"WITH src AS ({view_sql('shipments')}) SELECT \"Sales\" AS cell, {number(quoted('Sales'))} AS number, count(*) AS n FROM src GROUP BY ALL",
    "parse_datetime": "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || ' 00:00:00' AS parsed FROM orders",
    "valid_invalid_counts": f"""{SHIP} SELECT name, valid, rows - missing_count - valid AS invalid, missing_count AS missing
      FROM (SELECT *, CASE detected_type WHEN 'numeric' THEN numeric_valid ELSE datetime_valid END AS valid FROM facts
            WHERE detected_type IN ('numeric', 'datetime'))""",
    "scaled_sum": "SELECT l_returnflag AS x, round(sum(l_extendedprice), 2) AS y FROM lineitem GROUP BY x",
    "value_frequencies": f"SELECT name, value, count(*) AS n, min(k) AS first_row FROM ({keyed('customer', 'c_custkey', ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'])}) GROUP BY name, value",
    "detect_types": f"{SHIP} SELECT position, name, detected_type FROM facts",
    "column_metadata": f"""{SOLD}, keyed AS ({keyed('src', 'o_orderkey', list(SALES))}), {FIVE_FIRST}
      SELECT position, name, detected_type, missing_count, missing_percentage, unique_count, sample_values
      FROM facts JOIN (SELECT name, string_agg(value, '|' ORDER BY rank) AS sample_values FROM firsts GROUP BY name) USING (name)""",
    "column_metadata_typed": f"WITH {facts('lineitem', LINE_COLUMNS)} {METADATA}",
    "column_metadata_documents": f"WITH {facts('documents', DOCUMENT_COLUMNS)} {METADATA}",
    "sample_values": f"WITH keyed AS ({keyed('part', 'p_partkey', ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'])}), {FIVE_FIRST} SELECT name, rank, value FROM firsts",
    "dataset_summary": f"""{SHIP} SELECT max(rows) AS row_count, count(*) AS column_count, max(rows) * count(*) AS total_cells,
      CAST(sum(missing_count) AS BIGINT) AS missing_cells, round(sum(missing_count) * 100.0 / (max(rows) * count(*)), 2) AS missing_percentage,
      count(*) FILTER (detected_type = 'numeric') AS numeric_columns, count(*) FILTER (detected_type = 'categorical') AS categorical_columns,
      count(*) FILTER (detected_type = 'datetime') AS datetime_columns, count(*) FILTER (detected_type = 'boolean') AS boolean_columns,
      count(*) FILTER (detected_type = 'text') AS text_columns,
      (SELECT count(*) FROM src WHERE {' AND '.join(f"trim({quoted(c)}) <> ''" for c in SHIPMENTS)}) AS complete_rows FROM facts""",
    "type_counts": f"{SOLD} SELECT detected_type, count(*) AS columns FROM facts GROUP BY detected_type",
    "numeric_stats": f"WITH src AS ({view_sql('shipments')}) {numeric_rows('src', MEASURES)}",
    "numeric_stats_typed": numeric_rows("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "datetime_stats": " UNION ALL ".join(
        f"""SELECT '{c}' AS name, count(*) AS count, 0 AS invalid_count,
        strftime(min({c}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(min({c})) % 1000000 = 0 THEN '' ELSE strftime(min({c}), '.%f') END || '+00:00' AS earliest,
        strftime(max({c}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(max({c})) % 1000000 = 0 THEN '' ELSE strftime(max({c}), '.%f') END || '+00:00' AS latest,
        round((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0, 4) AS range_days FROM {t}"""
        for t, c in (("events", "ts"), ("orders", "o_orderdate"))
    ),
    "top_categories": f"""SELECT name, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank, value, n
      FROM (SELECT name, value, count(*) AS n FROM ({cells('part', ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'])}) GROUP BY name, value)
      QUALIFY rank <= 10""",
    "kpi_metrics": f"""{SHIP} SELECT 0 AS position, 'Records' AS label, max(rows)::DOUBLE AS value FROM facts
      UNION ALL SELECT 1, 'Columns', count(*)::DOUBLE FROM facts
      UNION ALL SELECT 2, 'Missing cells', sum(missing_count)::DOUBLE FROM facts
      UNION ALL SELECT 3, 'Average Sales', round(avg({number(quoted('Sales'))}), 4) FROM src""",
    "outliers_iqr": " UNION ALL ".join(
        f"""SELECT '{c}' AS name, (SELECT count(*) FROM events WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS count,
        valid_rows, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper, round(q1, 6) AS q1, round(q3, 6) AS q3
        FROM (SELECT count({c}) AS valid_rows, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM events)"""
        for c in ("value", "user_id")
    ),
    "bar_sum": ranked_points("SELECT o_orderpriority AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY x", "y DESC, x"),
    "bar_mean": f"WITH src AS ({view_sql('shipments')}) " + ranked_points(
        f"SELECT \"Return Flag\" AS x, round(avg({number(quoted('Sales'))}), 4) AS y FROM src WHERE trim(\"Return Flag\") <> '' GROUP BY x", "y DESC, x"),
    "bar_count": ranked_points("SELECT p_brand AS x, count(*)::DOUBLE AS y FROM part GROUP BY x", "y DESC, x"),
    "bar_many_categories": ranked_points("SELECT CAST(p_partkey AS VARCHAR) AS x, round(sum(p_retailprice), 2) AS y FROM part GROUP BY x", "y DESC, x"),
    "donut_counts": f"WITH src AS ({view_sql('sales')}) " + ranked_points(
        "SELECT \"Status\" AS x, count(*)::DOUBLE AS y FROM src WHERE trim(\"Status\") <> '' GROUP BY x", "x"),
    "line_daily": "SELECT strftime(ts, '%Y-%m-%d') AS x, round(sum(value), 2) AS y, 'days' AS unit FROM events GROUP BY x",
    "line_period_ladder": f"""WITH src AS ({view_sql('sales')}),
      parsed AS (SELECT {instant(quoted('Order Date'))} AS t, {number(quoted('Total Sales'))} AS y FROM src),
      level AS (SELECT CASE WHEN count(DISTINCT CAST(t AS DATE)) <= 120 THEN 'days'
        WHEN count(DISTINCT strftime(t, '%Y-%m')) <= 120 THEN 'months' ELSE 'years' END AS unit FROM parsed)
      SELECT CASE unit WHEN 'days' THEN strftime(t, '%Y-%m-%d') WHEN 'months' THEN strftime(t, '%Y-%m') ELSE strftime(t, '%Y') END AS x,
        round(avg(y), 4) AS y, unit FROM parsed, level WHERE t IS NOT NULL AND y IS NOT NULL GROUP BY x, unit""",
    "line_counts": f"""WITH src AS ({view_sql('shipments')}), parsed AS (SELECT {instant(quoted('Shipped'))} AS t FROM src)
      SELECT strftime(t, '%Y-%m') AS x, count(*)::DOUBLE AS y, 'months' AS unit FROM parsed WHERE t IS NOT NULL GROUP BY x""",
    "histogram": """WITH b AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders),
      hits AS (SELECT least(19, floor((o_totalprice - low) / ((high - low) / 20))) AS position, count(*)::DOUBLE AS y
        FROM orders, b GROUP BY 1)
      SELECT i AS position, round(low + i * (high - low) / 20, 4) AS lower, round(low + (i + 1) * (high - low) / 20, 4) AS upper,
        coalesce(y, 0) AS y FROM b, range(20) r(i) LEFT JOIN hits ON hits.position = i""",
    "scatter_sample": f"""WITH src AS ({view_sql('sales', True)}),
      valid AS (SELECT x, y, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS total
        FROM (SELECT o_orderkey, {number(quoted('Customer Ref'))} AS x, {number(quoted('Total Sales'))} AS y FROM src)
        WHERE x IS NOT NULL AND y IS NOT NULL)
      SELECT i AS position, x, y FROM range(500) r(i) JOIN valid ON place = (i * (total - 1)) // 499""",
    "pair_validity": f"WITH src AS ({view_sql('shipments')}), {PARSED} " + pair_rows(
        [(i, j) for i in range(5) for j in range(i + 1, 5)],
        lambda i, j: f"count(*) AS valid_rows, min(v{i}) <> max(v{i}) AS x_varies, min(v{j}) <> max(v{j}) AS y_varies"),
    "correlation_pairs": f"WITH src AS ({view_sql('shipments')}), {PARSED} " + pair_rows(
        [(i, j) for i in range(4) for j in range(i + 1, 4)],
        lambda i, j: f"count(*) AS valid_rows, round(corr(v{i}, v{j}), 6) AS pearson_r"),
    "correlation_partial_overlap": "SELECT count(*) AS valid_rows, round(corr(l_quantity, l_extendedprice), 6) AS pearson_r FROM lineitem WHERE l_linenumber <> 1",
    "monthly_mean": f"WITH src AS ({view_sql('shipments')}) SELECT name, month, round(mean, 4) AS mean, valid_rows FROM ({months(['Sales', 'Quantity'], 'Shipped')})",
    "insight_trend": f"""{SOLD}, chosen AS (SELECT name FROM facts WHERE detected_type = 'numeric' ORDER BY numeric_valid DESC, position LIMIT 2),
      monthly AS (SELECT * FROM ({months(['Order ID', 'Customer Ref', 'Total Sales'], 'Order Date')}) WHERE name IN (SELECT name FROM chosen)),
      last2 AS (SELECT *, lag(month) OVER w AS previous_period, lag(mean) OVER w AS previous_value,
        sum(valid_rows) OVER (PARTITION BY name) AS total, row_number() OVER (PARTITION BY name ORDER BY month DESC) AS back
        FROM monthly WINDOW w AS (PARTITION BY name ORDER BY month))
      SELECT 'Monthly change in ' || name AS title, previous_period, month AS current_period, round(previous_value, 4) AS previous_value,
        round(mean, 4) AS current_value, round((mean - previous_value) / abs(previous_value) * 100, 4) AS percentage_change,
        CAST(total AS BIGINT) AS valid_rows FROM last2
      WHERE back = 1 AND date_diff('month', CAST(previous_period || '-01' AS DATE), CAST(month || '-01' AS DATE)) = 1
        AND previous_value <> 0 AND mean <> previous_value""",
    "insight_missing": f"""{SHIP} SELECT 'Missing values in ' || name AS title, CAST(missing_count AS VARCHAR) AS missing_count,
      CAST(CAST(missing_percentage AS DOUBLE) AS VARCHAR) AS percentage FROM facts WHERE missing_count > 0
      ORDER BY missing_percentage DESC, position LIMIT 2""",
    "insight_top_category": f"""{SOLD}, chosen AS (SELECT * FROM facts WHERE detected_type IN ('categorical', 'boolean')
        AND unique_count BETWEEN 2 AND 30 ORDER BY position LIMIT 2)
      SELECT 'Most frequent ' || c.name AS title, f.value AS category, CAST(f.n AS VARCHAR) AS count,
        CAST(c.rows - c.missing_count AS VARCHAR) AS valid_rows FROM chosen c JOIN freq f USING (position)
      WHERE NOT f.blank QUALIFY row_number() OVER (PARTITION BY c.name ORDER BY f.n DESC, f.value) = 1""",
    "aggregation_hint": f"""WITH src AS ({view_sql('shipments')}), {facts('src', MEASURES)}
      SELECT name, CASE WHEN name IN ('Sales', 'Quantity') THEN 'sum' ELSE 'mean' END AS hint, numeric_valid FROM facts""",
    "candidate_columns": f"{SHIP}, {candidate_sql()} SELECT kind, rank, name, valid_rows FROM kept",
    "recommendations": f"{SHIP}, {recommendation_sql()}",
    "filter_fields": f"""{SHIP} SELECT position, name,
      CASE WHEN detected_type IN ('numeric', 'datetime') THEN detected_type ELSE 'categorical' END AS kind,
      CASE WHEN detected_type IN ('numeric', 'datetime') THEN '' ELSE
        (SELECT string_agg(value, '|' ORDER BY value) FROM freq WHERE freq.position = facts.position AND NOT blank) END AS values
      FROM facts WHERE detected_type IN ('numeric', 'datetime')
        OR (detected_type IN ('categorical', 'boolean') AND unique_count <= 50)""",
    "filter_categorical": f"SELECT o_orderkey, \"Status\", \"Priority\" FROM ({view_sql('sales', True)}) WHERE \"Status\" IN ('O', 'P')",
    "filter_numeric": f"SELECT o_orderkey, \"Total Sales\" FROM ({view_sql('sales', True)}) WHERE {number(quoted('Total Sales'))} BETWEEN 50000 AND 400000",
    "filter_date": f"SELECT o_orderkey, \"Order Date\" FROM ({view_sql('sales', True)}) WHERE CAST({instant(quoted('Order Date'))} AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
    "filter_combined": f"SELECT o_orderkey, \"Status\", \"Total Sales\", \"Order Date\" FROM ({view_sql('sales', True)}) WHERE {SALES_FILTER}",
    "filter_typed": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 400000 "
    "AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND o_orderstatus IN ('O', 'P')",
    "filtered_stats": f"WITH src AS (SELECT * FROM ({view_sql('sales')}) WHERE {SALES_FILTER}) {numeric_rows('src', ['Customer Ref', 'Total Sales'], False)}",
    "filtered_chart": f"WITH src AS (SELECT * FROM ({view_sql('sales')}) WHERE {SALES_FILTER}) " + ranked_points(
        f"SELECT \"Priority\" AS x, round(sum({number(quoted('Total Sales'))}), 2) AS y FROM src GROUP BY x", "y DESC, x"),
    "search_any_cell": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') OR contains(lower(source), 'the') "
    "OR contains(lower(lang), 'the') OR contains(CAST(doc_id AS VARCHAR), 'the') OR contains(CAST(n_chars AS VARCHAR), 'the')",
    "natural_sort": """SELECT row_number() OVER (ORDER BY CAST(replace(p_brand, 'Brand#', '') AS INT) DESC, p_partkey) - 1 AS position,
      p_partkey, p_brand FROM part ORDER BY position LIMIT 50""",
    "page_rows": "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 75",
    "page_rows_deep": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 50 OFFSET 10000",
    "saved_analysis": f"SELECT 'shipments' AS dataset_id, 'project' AS project_id, * FROM ({SHIP}, {recommendation_sql()})",
    "catalog_listing": f"""SELECT c_custkey AS project_id, c_nationkey AS owner_id, c_acctbal AS updated_at, c_name, filename, row_count,
        column_count, (SELECT count(*) FROM customer WHERE c_nationkey = 7) AS total
      FROM (SELECT * FROM customer WHERE c_nationkey = 7 ORDER BY c_acctbal DESC, c_custkey LIMIT 12 OFFSET 12)
      LEFT JOIN ({BY_CUSTOMER}) ON c_custkey = o_custkey""",
    "owner_scope": "SELECT o_custkey AS project_id, o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 7)",
    "catalog_new_only": """SELECT o_orderkey AS project_id, o_custkey, o_orderpriority FROM orders
      WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
    "catalog_columns": f"""{SHIP} SELECT 'shipments' AS dataset_id, position, name, detected_type, missing_count > 0 AS nullable,
      missing_count, missing_percentage, unique_count FROM facts""",
    "catalog_checks": """SELECT 'unknown_type' AS rule, l_orderkey AS dataset_id, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 2
      UNION ALL SELECT 'negative_count', l_orderkey, count(*) FROM lineitem WHERE l_quantity < 2 GROUP BY 2
      UNION ALL SELECT 'repeated_position', l_orderkey, count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY 2
      UNION ALL SELECT 'repeated_name', l_orderkey, count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1) GROUP BY 2
      UNION ALL SELECT 'no_rows', o_orderkey, count(*) FROM orders WHERE o_totalprice <= 20000 GROUP BY 2
      UNION ALL SELECT 'column_count', o_orderkey, count(*) FROM orders WHERE o_custkey % 250 NOT BETWEEN 1 AND 200 GROUP BY 2
      UNION ALL SELECT 'repeated_project', min(o_orderkey), 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1""",
}
