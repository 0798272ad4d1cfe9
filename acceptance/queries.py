"""One query per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acceptance.views import read, typed, view
from colonnade import CategoryFilter, Dataset, DateFilter, NumberFilter, Profile, analyze
from colonnade.functions.names import aggregation_hint
from colonnade.operators import browse, charts, filters, frequencies, kpi, schema, statistics
from colonnade.operators.outliers import iqr_outliers
from colonnade.operators.pairs import Operand, pair_facts
from colonnade.plans import insights, recommend
from colonnade.scratch import new_path
from colonnade.sinks import catalog, checks
from colonnade.sources.delimited import malformed_records, read_delimited, write_delimited

MEASURES = ["Part Number", "Sales", "Quantity", "Net Price"]
RULES = [
    CategoryFilter("Status", ("O", "P")),
    NumberFilter("Total Sales", 50_000, 400_000),
    DateFilter("Order Date", "1996-01-01", "1999-12-31"),
]


def _rounded(frame: DataFrame, digits: int = 4) -> DataFrame:
    return frame.select(
        *(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes)
    )


def _listed(column: str):
    return F.array_join(column, "|").alias(column)


# Sources.


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    ds = typed(spark, folder, "customer")
    path = new_path(spark)
    write_delimited(ds.frame.select(*(ds.text(c).alias(c) for c in ds.columns)), path)
    rows = read_delimited(spark, path).dataset.frame
    return charts.positioned(rows, F.asc("_row")).drop("_row")


def csv_long_preamble(spark: SparkSession, folder: str) -> DataFrame:
    """Customers below three hundred lines of notes, in one file."""
    path = new_path(spark)
    notes = spark.range(0, 300, 1, 1).select(F.format_string("# note %s", "id").alias("value"))
    header = spark.range(1).select(F.lit("key;segment").alias("value"))
    customers = read(spark, folder, "customer").select(
        F.concat_ws(";", F.col("c_custkey").cast("string"), "c_mktsegment").alias("value")
    )
    notes.union(header).union(customers).coalesce(1).write.text(path)
    return read_delimited(spark, path).dataset.frame.drop("_row")


def csv_malformed_rows(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark)
    lines = read(spark, folder, "customer").select(
        F.concat_ws(
            ",", F.col("c_custkey").cast("string"), "c_name",
            F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("extra")), "c_mktsegment",
            F.when(F.col("c_acctbal") > 9000, F.lit("more")),
        )
    )
    lines.write.text(path)
    bad = malformed_records(spark, path, 3)
    return bad.groupBy("fields").agg(F.count(F.lit(1)).alias("records"))


def preview_first_rows(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "sales").preview()


# Cells.


def missing_cells(spark: SparkSession, folder: str) -> DataFrame:
    counted = statistics.missing_cells(view(spark, folder, "shipments"))
    return counted.unpivot([], counted.columns, "name", "missing")


def parse_numeric(spark: SparkSession, folder: str) -> DataFrame:
    ds = view(spark, folder, "shipments", ["Sales"])
    rows = ds.frame.select(ds.text("Sales").alias("cell"), ds.number("Sales").alias("number"))
    return rows.groupBy("cell", "number").agg(F.count(F.lit(1)).alias("n"))


def parse_datetime(spark: SparkSession, folder: str) -> DataFrame:
    ds = view(spark, folder, "sales", ["Order Date"])
    day = F.date_format(ds.instant("Order Date"), "yyyy-MM-dd HH:mm:ss")
    return ds.frame.select(F.col("_row").alias("o_orderkey"), day.alias("parsed"))


def valid_invalid_counts(spark: SparkSession, folder: str) -> DataFrame:
    profile = Profile(view(spark, folder, "shipments"))
    kind = F.col("detected_type")
    valid = F.when(kind == "numeric", F.col("numeric_valid")).otherwise(F.col("datetime_valid"))
    return profile.counts.where(kind.isin("numeric", "datetime")).select(
        "name", valid.alias("valid"),
        (F.col("rows") - F.col("missing_count") - valid).alias("invalid"),
        F.col("missing_count").alias("missing"),
    )


def scaled_sum(spark: SparkSession, folder: str) -> DataFrame:
    rows = charts.category_rows(typed(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice")
    huge = rows.withColumn("y", F.col("y") * F.lit(1e290))
    total = charts.aggregated(huge, "x", "sum")
    return total.select("x", F.round(F.col("y") / 1e290, 2).alias("y"))


# Schema.


def value_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    ds = typed(spark, folder, "customer")
    freq = frequencies.value_frequencies(ds)
    return freq.select(frequencies.column_names(ds).alias("name"), "value", "n", "first_row")


def detect_types(spark: SparkSession, folder: str) -> DataFrame:
    return schema.type_table(Profile(view(spark, folder, "shipments")))


def column_metadata(spark: SparkSession, folder: str) -> DataFrame:
    table = schema.column_metadata(Profile(view(spark, folder, "sales")))
    return table.withColumn("sample_values", _listed("sample_values"))


def column_metadata_typed(spark: SparkSession, folder: str) -> DataFrame:
    return schema.column_metadata(Profile(typed(spark, folder, "lineitem"))).drop("sample_values")


def column_metadata_documents(spark: SparkSession, folder: str) -> DataFrame:
    return schema.column_metadata(Profile(typed(spark, folder, "documents"))).drop("sample_values")


def sample_values(spark: SparkSession, folder: str) -> DataFrame:
    return schema.sample_values(typed(spark, folder, "part"), 5)


# Statistics.


def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.dataset_summary(Profile(view(spark, folder, "shipments")))


def type_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = Profile(view(spark, folder, "sales")).counts
    return counts.groupBy("detected_type").agg(F.count(F.lit(1)).alias("columns"))


def numeric_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(statistics.numeric_statistics(Profile(view(spark, folder, "shipments", MEASURES))))


def numeric_stats_typed(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return _rounded(statistics.numeric_statistics(Profile(typed(spark, folder, "lineitem", columns))))


def datetime_stats(spark: SparkSession, folder: str) -> DataFrame:
    profiles = (Profile(typed(spark, folder, t, [c])) for t, c in (("events", "ts"), ("orders", "o_orderdate")))
    first, second = (statistics.datetime_statistics(p).drop("position") for p in profiles)
    return _rounded(first.unionByName(second))


def top_categories(spark: SparkSession, folder: str) -> DataFrame:
    ds = typed(spark, folder, "part")
    top = frequencies.top_values(frequencies.value_frequencies(ds), 10)
    return top.select(frequencies.column_names(ds).alias("name"), "rank", "value", "n")


def kpi_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(kpi.kpi_metrics(Profile(view(spark, folder, "shipments"))).drop("shown"))


def outliers_iqr(spark: SparkSession, folder: str) -> DataFrame:
    found = iqr_outliers(Profile(typed(spark, folder, "events", ["value", "user_id"])))
    return _rounded(found.drop("position"), 6)


# Charts.


def bar_sum(spark: SparkSession, folder: str) -> DataFrame:
    points = charts.category_chart(typed(spark, folder, "orders"), "o_orderpriority", "o_totalprice", "sum")
    return _rounded(charts.positioned(points, F.desc("y"), F.asc("x")), 2)


def bar_mean(spark: SparkSession, folder: str) -> DataFrame:
    points = charts.category_chart(view(spark, folder, "shipments"), "Return Flag", "Sales", "mean")
    return _rounded(charts.positioned(points, F.desc("y"), F.asc("x")))


def bar_count(spark: SparkSession, folder: str) -> DataFrame:
    points = charts.category_chart(typed(spark, folder, "part"), "p_brand")
    return charts.positioned(points, F.desc("y"), F.asc("x"))


def bar_many_categories(spark: SparkSession, folder: str) -> DataFrame:
    """More categories than a shown chart may have; the operator keeps them all."""
    points = charts.category_chart(typed(spark, folder, "part"), "p_partkey", "p_retailprice", "sum")
    return _rounded(charts.positioned(points, F.desc("y"), F.asc("x")), 2)


def donut_counts(spark: SparkSession, folder: str) -> DataFrame:
    profile = Profile(view(spark, folder, "sales", ["Status"]))
    return charts.positioned(charts.category_chart(profile, "Status"), F.asc("x"))


def line_daily(spark: SparkSession, folder: str) -> DataFrame:
    points, unit = charts.line_chart(typed(spark, folder, "events"), "ts", "value", "sum")
    return _rounded(points.withColumn("unit", F.lit(unit)), 2)


def line_period_ladder(spark: SparkSession, folder: str) -> DataFrame:
    points, unit = charts.line_chart(view(spark, folder, "sales"), "Order Date", "Total Sales", "mean")
    return _rounded(points.withColumn("unit", F.lit(unit)))


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    points, unit = charts.line_chart(Profile(view(spark, folder, "shipments", ["Shipped"])), "Shipped")
    return points.withColumn("unit", F.lit(unit))


def histogram(spark: SparkSession, folder: str) -> DataFrame:
    bins = charts.histogram(Profile(typed(spark, folder, "orders", ["o_totalprice"])), "o_totalprice")
    return _rounded(bins)


def scatter_sample(spark: SparkSession, folder: str) -> DataFrame:
    ds = view(spark, folder, "sales")
    return charts.scatter_sample(ds, "Customer Ref", "Total Sales", 1_000_000)[0]


# Pairs and findings.


def pair_validity(spark: SparkSession, folder: str) -> DataFrame:
    ds = view(spark, folder, "shipments")
    operands = [Operand(n, "numeric") for n in MEASURES] + [Operand("Shipped", "datetime")]
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    names = F.array(*(F.lit(f"{operands[i].name}|{operands[j].name}") for i, j in pairs))
    facts = pair_facts(ds, operands, pairs)
    return facts.select(F.get(names, "pair").alias("pair"), "valid_rows", "x_varies", "y_varies")


def correlation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    profile = Profile(view(spark, folder, "shipments", MEASURES))
    operands = insights.numeric_operands(profile.facts)
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    names = F.array(*(F.lit(f"{MEASURES[i]}|{MEASURES[j]}") for i, j in pairs))
    facts = pair_facts(profile.ds, operands, pairs)
    return facts.select(
        F.get(names, "pair").alias("pair"), "valid_rows", F.round("pearson_r", 6).alias("pearson_r")
    )


def correlation_partial_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Text columns whose largest values stand where the other side is blank."""
    items = read(spark, folder, "lineitem")
    first = F.col("l_linenumber") == 1
    table = items.select(
        F.when(first, F.col("l_extendedprice") * 1e9).otherwise(F.col("l_quantity")).cast("string").alias("Load"),
        F.when(first, F.lit("")).otherwise(F.col("l_extendedprice").cast("string")).alias("Cost"),
    )
    profile = Profile(Dataset.from_table(table))
    facts = pair_facts(profile.ds, insights.numeric_operands(profile.facts), [(0, 1)])
    return facts.select("valid_rows", F.round("pearson_r", 6).alias("pearson_r"))


def monthly_mean(spark: SparkSession, folder: str) -> DataFrame:
    profile = Profile(view(spark, folder, "shipments", ["Shipped", "Sales", "Quantity"]))
    facts = profile.of_type("numeric")
    means = insights.monthly_means(profile, "Shipped", facts)
    scale = F.create_map(*(F.lit(v) for f in facts for v in (f["name"], statistics.magnitude(f))))
    value = F.col("mean") * F.element_at(scale, F.col("name"))
    return means.select("name", "month", F.round(value, 4).alias("mean"), "valid_rows")


def _evidence(profile: Profile, items: list, *keys: str) -> DataFrame:
    table = insights.insights_table(profile, items)
    return table.select("title", *(F.col("evidence")[k].alias(k) for k in keys))


def insight_trend(spark: SparkSession, folder: str) -> DataFrame:
    profile = Profile(view(spark, folder, "sales"))
    table = _evidence(
        profile, insights.trend_insights(profile), "previous_period", "current_period",
        "previous_value", "current_value", "percentage_change", "valid_rows",
    )
    values = ("previous_value", "current_value", "percentage_change")
    return table.select(
        "title", "previous_period", "current_period",
        *(F.round(F.col(c).cast("double"), 4).alias(c) for c in values),
        F.col("valid_rows").cast("bigint").alias("valid_rows"),
    )


def insight_missing(spark: SparkSession, folder: str) -> DataFrame:
    profile = Profile(view(spark, folder, "shipments"))
    return _evidence(profile, insights.missing_insights(profile), "missing_count", "percentage")


def insight_top_category(spark: SparkSession, folder: str) -> DataFrame:
    profile = Profile(view(spark, folder, "sales"))
    return _evidence(profile, insights.category_insights(profile), "category", "count", "valid_rows")


def insights_all(spark: SparkSession, folder: str) -> DataFrame:
    profile = Profile(view(spark, folder, "shipments"))
    items = insights.generate_insights(profile)
    return insights.insights_table(profile, items).select(
        "position", "type", "title", "severity", _listed("columns")
    )


# Recommendations.


def aggregation_hints(spark: SparkSession, folder: str) -> DataFrame:
    profile = Profile(view(spark, folder, "shipments", MEASURES))
    hints = F.array(*(F.lit(aggregation_hint(f["name"])) for f in profile.facts))
    return profile.counts.select("name", F.get(hints, "position").alias("hint"), "numeric_valid")


def candidate_columns(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.candidate_columns(Profile(view(spark, folder, "shipments")))


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    profile = Profile(view(spark, folder, "shipments"))
    return recommend.recommendations_table(profile, recommend.recommend(profile)).drop("reason")


# Filters.


def filter_fields(spark: SparkSession, folder: str) -> DataFrame:
    fields = filters.filter_fields(Profile(view(spark, folder, "shipments")))
    return fields.withColumn("values", _listed("values"))


def _passing(ds: Dataset, rules: list) -> DataFrame:
    kept = filters.filtered(ds, rules)
    return kept.frame.select(F.col("_row").alias("o_orderkey"), *(kept.text(c).alias(c) for c in kept.columns))


def filter_categorical(spark: SparkSession, folder: str) -> DataFrame:
    return _passing(view(spark, folder, "sales", ["Status", "Priority"]), RULES[:1])


def filter_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return _passing(view(spark, folder, "sales", ["Total Sales"]), RULES[1:2])


def filter_date(spark: SparkSession, folder: str) -> DataFrame:
    return _passing(view(spark, folder, "sales", ["Order Date"]), RULES[2:])


def filter_combined(spark: SparkSession, folder: str) -> DataFrame:
    return _passing(view(spark, folder, "sales", ["Status", "Total Sales", "Order Date"]), RULES)


def filter_typed(spark: SparkSession, folder: str) -> DataFrame:
    rules = [
        NumberFilter("o_totalprice", 50_000, 400_000),
        DateFilter("o_orderdate", "1996-01-01", "1999-12-31"),
        CategoryFilter("o_orderstatus", ("O", "P")),
    ]
    kept = filters.filtered(typed(spark, folder, "orders"), rules)
    return kept.frame.drop("_row").select("o_orderkey", "o_custkey", "o_totalprice")


def filtered_stats(spark: SparkSession, folder: str) -> DataFrame:
    full = Profile(view(spark, folder, "sales", ["Customer Ref", "Total Sales", "Status", "Order Date"]))
    types = {f["name"]: f["detected_type"] for f in full.facts}
    kept = Profile(filters.filtered(full.ds, RULES), frozen_types=types)
    return _rounded(statistics.numeric_statistics(kept).drop("position"))


def filtered_chart(spark: SparkSession, folder: str) -> DataFrame:
    kept = filters.filtered(view(spark, folder, "sales"), RULES)
    points = charts.category_chart(kept, "Priority", "Total Sales", "sum")
    return _rounded(charts.positioned(points, F.desc("y"), F.asc("x")), 2)


# Browsing.


def search_any_cell(spark: SparkSession, folder: str) -> DataFrame:
    found = browse.search(typed(spark, folder, "documents"), " THE ")
    return found.frame.select("doc_id", "source")


def natural_sort(spark: SparkSession, folder: str) -> DataFrame:
    ds = typed(spark, folder, "part", ["p_partkey", "p_brand", "p_name"])
    page = browse.page(ds, 0, 50, "p_brand", descending=True)
    order = browse.natural_order(ds, "p_brand", descending=True)
    return charts.positioned(page, *order).select("position", "p_partkey", "p_brand")


def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    page = browse.page(typed(spark, folder, "customer"), 3, 25)
    return page.select("c_custkey", "c_name", "c_mktsegment")


def page_rows_deep(spark: SparkSession, folder: str) -> DataFrame:
    ds = typed(spark, folder, "orders")
    return browse.page(ds, 200, 50, "o_orderpriority").select("o_orderkey", "o_orderpriority")


# Saved analyses. Customers stand in for projects, nations for owners, and each
# customer's first order for a dataset.


def _projects(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    projects = read(spark, folder, "customer").select(
        F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("owner_id"),
        F.col("c_acctbal").alias("updated_at"), "c_name",
    )
    datasets = read(spark, folder, "orders").groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("dataset_id"), F.min_by("o_orderpriority", "o_orderkey").alias("filename"),
        F.count(F.lit(1)).alias("row_count"), F.lit(6).alias("column_count"),
    )
    return projects, datasets.withColumnRenamed("o_custkey", "project_id")


def catalog_listing(spark: SparkSession, folder: str) -> DataFrame:
    projects, datasets = _projects(spark, folder)
    return catalog.project_page(projects, datasets, 7, 2)


def owner_scope(spark: SparkSession, folder: str) -> DataFrame:
    projects, _ = _projects(spark, folder)
    orders = read(spark, folder, "orders").select(F.col("o_custkey").alias("project_id"), "o_orderkey")
    return catalog.owned(orders, projects, 7)


def catalog_new_only(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without a returned line; every customer of the tables has an order."""
    orders = read(spark, folder, "orders").withColumnRenamed("o_orderkey", "project_id")
    lines = read(spark, folder, "lineitem").where(F.col("l_returnflag") == "R")
    taken = lines.select(F.col("l_orderkey").alias("project_id"))
    return catalog.without_dataset(orders, taken).select("project_id", "o_custkey", "o_orderpriority")


def catalog_columns(spark: SparkSession, folder: str) -> DataFrame:
    metadata = schema.column_metadata(Profile(view(spark, folder, "shipments")))
    return catalog.column_rows(metadata, F.lit("shipments")).drop("sample_values")


def catalog_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as datasets and their items as columns; line numbers repeat in many."""
    orders = read(spark, folder, "orders")
    items = read(spark, folder, "lineitem")
    kinds = F.when(F.col("l_returnflag") == "A", "numeric").when(F.col("l_returnflag") == "N", "text")
    columns = items.select(
        F.col("l_orderkey").alias("dataset_id"), F.col("l_linenumber").alias("position"),
        F.col("l_partkey").cast("string").alias("name"), kinds.alias("detected_type"),
        (F.col("l_quantity") - 2).alias("missing_count"), F.col("l_suppkey").alias("unique_count"),
    )
    datasets = orders.select(
        F.col("o_orderkey").alias("dataset_id"), F.col("o_custkey").alias("project_id"),
        (F.col("o_totalprice") - 20000).alias("row_count"), (F.col("o_custkey") % 250).alias("column_count"),
    )
    return catalog.violations(datasets, columns)


def analysis_checks(spark: SparkSession, folder: str) -> DataFrame:
    analysis = analyze(view(spark, folder, "sales"))
    return checks.analysis_checks(analysis, "sales")


def filtered_analysis_checks(spark: SparkSession, folder: str) -> DataFrame:
    analysis = analyze(view(spark, folder, "sales")).filter(RULES)
    return checks.analysis_checks(analysis, "sales, filtered")


def saved_analysis(spark: SparkSession, folder: str) -> DataFrame:
    saved = catalog.Catalog(spark, new_path(spark))
    saved.save(analyze(view(spark, folder, "shipments")), "project", "shipments", "shipments.csv", 1)
    return saved.load("shipments")["visualizations"].drop("reason")


QUERIES = {
    f.__name__: f
    for f in (
        csv_round_trip, csv_long_preamble, csv_malformed_rows, preview_first_rows, missing_cells, parse_numeric,
        parse_datetime, valid_invalid_counts, scaled_sum, value_frequencies, detect_types,
        column_metadata, column_metadata_typed, column_metadata_documents, sample_values,
        dataset_summary, type_counts, numeric_stats, numeric_stats_typed, datetime_stats,
        top_categories, kpi_metrics, outliers_iqr, bar_sum, bar_mean, bar_count, bar_many_categories, donut_counts,
        line_daily, line_period_ladder, line_counts, histogram, scatter_sample, pair_validity,
        correlation_pairs, correlation_partial_overlap, monthly_mean, insight_trend, insight_missing, insight_top_category,
        insights_all, candidate_columns, recommendations, filter_fields, filter_categorical,
        filter_numeric, filter_date, filter_combined, filter_typed, filtered_stats,
        filtered_chart, search_any_cell, natural_sort, page_rows, page_rows_deep, catalog_listing, owner_scope,
        catalog_new_only, catalog_columns, catalog_checks, analysis_checks,
        filtered_analysis_checks, saved_analysis,
    )
}
QUERIES["aggregation_hint"] = aggregation_hints
