"""What the physical plans must look like for large tables."""

import pytest

from colonnade import Dataset, DateFilter, NumberFilter
from colonnade.operators import charts, filters, frequencies
from colonnade.scratch import shared_folder

ORDERS = "/root/testdata/sf0.001/orders.parquet"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", params=["o_orderkey", None])
def orders(spark, request):
    return Dataset.from_table(spark.read.parquet(ORDERS), request.param)


def test_filters_on_typed_columns_reach_the_scan(orders):
    rules = [NumberFilter("o_totalprice", 10, 20), DateFilter("o_orderdate", "1996-01-01")]
    text = plan(filters.filtered(orders, rules).frame.select("o_orderkey"))
    pushed = text.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(o_totalprice,10.0)" in text or "GreaterThanOrEqual(o_totalprice" in pushed
    assert "LessThanOrEqual(o_totalprice" in text and "o_orderdate" in text.split("DataFilters")[1]


def test_charts_read_two_columns_and_count_before_the_shuffle(orders):
    text = plan(charts.category_chart(orders, "o_orderpriority", "o_totalprice", "sum"))
    assert "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in text
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_top_values_are_limited_before_the_shuffle(orders):
    text = plan(frequencies.top_values(frequencies.value_frequencies(orders), 10))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_the_named_folder_is_used(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    from colonnade import DatasetError, scratch

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(DatasetError) as caught:
        scratch.shared_folder(Session())
    assert caught.value.code == "no_shared_folder"
    Context.master = "local[4]"
    assert scratch.shared_folder(Session())


def test_released_analyses_leave_no_files(spark, text_dataset):
    from pathlib import Path

    from colonnade import analyze

    before = set(Path(shared_folder(spark)).iterdir())
    found = analyze(text_dataset({"a": ["1", "2", "3", "4"], "b": ["5", "1", "2", "9"], "d": ["2001-01-01", "2001-02-01"] * 2}))
    assert found.charts
    assert set(Path(shared_folder(spark)).iterdir()) > before
    found.release()
    assert set(Path(shared_folder(spark)).iterdir()) == before


def test_places_taken_in_a_block_are_noted(spark):
    from colonnade.scratch import noting, removed, written

    outer, inner, own = [], [], []
    with noting(outer):
        first = written(spark.range(3), own)
        with noting(inner):
            written(spark.range(2))
        assert first.count() == 3
    written(spark.range(1))
    assert len(outer) == 2 and own == outer[:1] and inner == outer[1:]
    removed(spark, outer)
    assert outer == []


def test_typed_tables_are_scanned_and_shuffled_once(spark):
    ds = Dataset.from_table(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    text = plan(frequencies.parsed_frequencies(ds))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "partial_count" in text


def test_long_texts_are_no_shuffle_keys(spark):
    ds = Dataset.from_table(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id")
    text = plan(frequencies.parsed_frequencies(ds))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    keys = text.split("hashpartitioning(")[1].split(")")[0]
    assert "s#" in keys and "h#" in keys and "text#" not in keys


@pytest.mark.parametrize("sort_by,descending", [("o_totalprice", True), ("o_orderpriority", False), (None, False)])
def test_pages_of_an_index_write_nothing_and_read_their_blocks(spark, sort_by, descending):
    from pathlib import Path

    from colonnade.operators import browse

    ds = Dataset.from_table(spark.read.parquet(ORDERS), "o_orderkey")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one block holds this table
    try:
        index = browse.page_index(ds, sort_by, descending)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.rows == ds.frame.count() and len(index.counts) > 2
    order = browse.natural_order(ds, sort_by, descending) if sort_by else ["_row"]
    wanted = [r["_row"] for r in ds.frame.orderBy(*order).select("_row").collect()]
    before = sorted(str(p) for p in Path(shared_folder(spark)).rglob("*"))
    last = -(-len(wanted) // 25) - 1
    for number in (0, last // 2, last, last + 9):
        page = index.page(number, 25)
        own = min(number, last)
        assert [r["_row"] for r in page.collect()] == wanted[own * 25 : own * 25 + 25]
        assert "PartitionFilters: [" in plan(page) and "_range" in plan(page).split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(str(p) for p in Path(shared_folder(spark)).rglob("*")) == before
    index.release()
    assert index.paths == []


def test_an_index_of_an_empty_table_has_an_empty_page(spark):
    from colonnade.operators import browse

    ds = Dataset.from_table(spark.createDataFrame([], "a string, b long"))
    assert browse.page_index(ds, "a").page(3).count() == 0
