import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from colonnade import CategoryFilter, DatasetError, DateFilter, NumberFilter, ProfileConfig, analyze
from colonnade.operators import browse, kpi
from colonnade.plans.insights import generate_insights
from colonnade.sinks.catalog import Catalog
from colonnade.sinks.checks import analysis_checks


def by_type(items, kind):
    return [item for item in items if item.type == kind]


def test_correlation_takes_rows_valid_on_both_sides(profile_of):
    """Large values where the other side is blank must not drown the pair's own rows."""
    deep = ["1", "2", "3", "4", "5", "1e12", "2e12", "", ""]
    wide = ["2.1", "3.9", "6.2", "7.8", "10.1", "", "", "500", "-900"]
    found = by_type(generate_insights(profile_of({"Deep": deep, "Wide": wide})), "correlation")
    r = np.corrcoef([1, 2, 3, 4, 5], [2.1, 3.9, 6.2, 7.8, 10.1])[0, 1]
    assert found[0].evidence["pearson_r"] == pytest.approx(r, abs=1e-12)
    assert found[0].evidence["valid_pairs"] == 5 and found[0].columns == ["Deep", "Wide"]


def test_correlation_over_several_sets_of_valid_columns(profile_of):
    chance = random.Random(6)
    a = [chance.gauss(5, 2) for _ in range(200)]
    b = [v + chance.gauss(0, 1) + (1e6 if i % 3 else 0) for i, v in enumerate(a)]
    cells = {"A": list(map(repr, a)), "B": list(map(repr, b)), "C": ["7", "8", ""] * 66 + ["7", ""]}
    found = by_type(generate_insights(profile_of(cells)), "correlation")
    r = np.corrcoef(a, b)[0, 1]
    assert [f.evidence["pearson_r"] for f in found if f.columns == ["A", "B"]] == ([pytest.approx(r)] if abs(r) >= 0.5 else [])


def test_a_side_that_does_not_vary_gives_no_correlation(profile_of):
    table = {"Flat": ["4", "4", "4", "9"], "Steep": ["1", "5", "7", ""]}
    assert by_type(generate_insights(profile_of(table)), "correlation") == []


def test_correlation_matches_numpy_far_from_zero(profile_of):
    chance = random.Random(2)
    x = [1e9 + chance.gauss(0, 1) for _ in range(400)]
    y = [v * 2 + chance.gauss(0, 1) for v in x]
    found = generate_insights(profile_of({"X": [repr(v) for v in x], "Y": [repr(v) for v in y]}))
    r = by_type(found, "correlation")[0].evidence["pearson_r"]
    assert r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-7)


def test_correlation_with_a_distant_outlier(profile_of):
    chance = random.Random(4)
    x = [chance.random() for _ in range(300)] + [1e7]
    y = [v + chance.random() for v in x]
    found = generate_insights(profile_of({"X": [repr(v) for v in x], "Y": [repr(v) for v in y]}))
    r = by_type(found, "correlation")[0].evidence["pearson_r"]
    assert r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


@pytest.mark.parametrize(
    "months, values, change",
    [
        (["1995-11", "1995-11", "1995-12", "1995-12"], [40, 60, 30, 10], -60),
        (["1995-12", "1996-01"], [8, 10], 25),
        (["1995-11", "1996-01"], [8, 10], None),  # no month beside it
        (["1995-11", "1995-12"], [0, 10], None),  # nothing to compare with
    ],
)
def test_change_from_month_to_month(profile_of, months, values, change):
    table = {"Docked": [f"{m}-0{i + 1}" for i, m in enumerate(months)], "Cargo amount": list(map(str, values))}
    found = by_type(generate_insights(profile_of(table)), "trend")
    assert [f.evidence["percentage_change"] for f in found] == ([] if change is None else [pytest.approx(change)])


def test_category_ties_and_caps(profile_of):
    found = generate_insights(profile_of({"Region": ["West", "East"] * 20, "Value": [str(i) for i in range(40)]}))
    assert by_type(found, "top_category")[0].evidence["category"] == "East"
    assert len(found) <= 12


HARBOURS = [["Oslo", "Riga", "Cork", ""][i % 4] for i in range(80)]
LOADS = [["12.5", "700", "none", "33"][(i // 4) % 4] for i in range(80)]
DAYS = [f"2019-03-{1 + i % 28:02d}T{i % 24:02d}:00:00Z" for i in range(80)]


@pytest.fixture(scope="module")
def dashboard(text_dataset):
    return analyze(text_dataset({"Harbour": HARBOURS, "Load": LOADS, "Day": DAYS}), ProfileConfig(numeric_threshold=0.7))


def test_filters_recompute_over_the_rows_that_pass(dashboard):
    rules = [CategoryFilter("Harbour", ("Oslo", "Cork")), NumberFilter("Load", 12.5, 33), DateFilter("Day", "2019-03-02", "2019-03-20")]
    passed = [
        i for i in range(80)
        if HARBOURS[i] in ("Oslo", "Cork") and LOADS[i] in ("12.5", "33") and 2 <= 1 + i % 28 <= 20
    ]
    kept = dashboard.filter(rules)
    assert kept.row_count == kept.summary.first()["row_count"] == len(passed)
    assert [r["Day"] for r in kept.preview().collect()] == [DAYS[i] for i in passed]
    assert [(r.title, r.chart_type) for r in kept.recommendations] == [(r.title, r.chart_type) for r in dashboard.recommendations]
    assert all(c.error is None for c in kept.charts)
    back = kept.filter([])
    assert back.charts == dashboard.charts and back.statistics.collect() == dashboard.statistics.collect()


def test_filters_that_nothing_passes(dashboard):
    none = dashboard.filter([NumberFilter("Load", maximum=-1)])
    assert none.row_count == 0 and none.preview().isEmpty() and none.insights == []
    assert not any(c.points for c in none.charts)


INVALID = {
    "another column": NumberFilter("Depth", 1),
    "another kind": CategoryFilter("Load", ("700",)),
    "an unknown label": CategoryFilter("Harbour", ("Oslo", "Bonn")),
    "no label": CategoryFilter("Harbour", ()),
    "too many labels": CategoryFilter("Harbour", tuple(f"h{i}" for i in range(51))),
    "no bound": DateFilter("Day"),
    "crossed bounds": NumberFilter("Load", 3.5, 3.25),
    "crossed days": DateFilter("Day", "2019-03-09", "2019-03-08"),
    "no number": NumberFilter("Load", float("nan")),
    "no end": NumberFilter("Load", 1, float("inf")),
    "a loose date": DateFilter("Day", "2019-3-9"),
    "a day that is not": DateFilter("Day", end="2019-11-31"),
}


@pytest.mark.parametrize("name", INVALID)
def test_filters_are_checked(dashboard, name):
    with pytest.raises(DatasetError) as caught:
        dashboard.filter([INVALID[name]])
    assert caught.value.code == "invalid_filter"


def test_a_column_takes_one_rule(dashboard):
    with pytest.raises(DatasetError):
        dashboard.filter([DateFilter("Day", "2019-03-01"), DateFilter("Day", end="2019-03-09")])


def test_checks_hold_and_catalog_keeps_results(spark, dashboard, tmp_path):
    assert all(row["ok"] for row in analysis_checks(dashboard).collect())
    saved = Catalog(spark, str(tmp_path / "catalog"))
    with pytest.raises(DatasetError):
        saved.load("d1")
    saved.save(dashboard, "p1", "d1", "sales.csv", 10)
    saved.save(dashboard, "p1", "d1", "sales.csv", 10)
    with pytest.raises(DatasetError) as error:
        saved.save(dashboard, "p1", "d2", "sales.csv", 10)
    assert error.value.code == "dataset_exists"
    saved.save(dashboard, "p2", "d2", "sales.csv", 10)
    tables = saved.load("d1")
    assert {n: t.count() for n, t in tables.items()} == {
        "dataset_columns": 3, "visualizations": len(dashboard.recommendations),
        "insights": len(dashboard.insights), "datasets": 1,
    }
    assert saved.table("dataset_columns").count() == 6


def test_unfinished_save_is_invisible(spark, dashboard, tmp_path):
    saved = Catalog(spark, str(tmp_path / "catalog"))
    saved.save(dashboard, "p1", "d1", "sales.csv", 10)
    rows = saved._table("dataset_columns").withColumn("dataset_id", __import__("pyspark").sql.functions.lit("lost"))
    saved._write(rows, "dataset_columns")
    assert saved._table("dataset_columns").count() == 6
    assert saved.table("dataset_columns").count() == 3


def test_replacing_is_seen_whole_or_not_at_all(spark, dashboard, tmp_path, monkeypatch):
    saved = Catalog(spark, str(tmp_path / "catalog"))
    saved.save(dashboard, "p1", "d1", "old.csv", 10)
    before = {n: t.drop("created_at").collect() for n, t in saved.load("d1").items()}
    write = Catalog._write

    def torn(self, rows, table):
        if table == "datasets":
            raise OSError("lost")
        write(self, rows, table)

    monkeypatch.setattr(Catalog, "_write", torn)
    with pytest.raises(OSError):
        saved.save(dashboard.filter([NumberFilter("Load", minimum=30)]), "p1", "d1", "new.csv", 10)
    assert {n: t.drop("created_at").collect() for n, t in saved.load("d1").items()} == before
    monkeypatch.undo()
    saved.vacuum()
    assert {n: t.drop("created_at").collect() for n, t in saved.load("d1").items()} == before
    assert saved._table("dataset_columns").count() == 3
    with pytest.raises(DatasetError):
        saved.save(dashboard, "p1", "d1", "old.csv", -1)


def test_of_concurrent_saves_one_wins(spark, dashboard, tmp_path):
    saved = Catalog(spark, str(tmp_path / "catalog"))

    def save(dataset_id):
        try:
            saved.save(dashboard, "p1", dataset_id, "sales.csv", 10)
            return "saved"
        except DatasetError as error:
            return error.code

    with ThreadPoolExecutor(4) as pool:
        results = list(pool.map(save, [f"d{i}" for i in range(4)]))
    assert sorted(results) == ["dataset_exists"] * 3 + ["saved"]
    assert saved.table("datasets").count() == 1


def test_vacuum_clears_odd_names_and_lost_claims(spark, dashboard, tmp_path):
    saved = Catalog(spark, str(tmp_path / "catalog"))
    for _ in range(2):
        saved.save(dashboard, "p 1", "d 1:%/x", "sales.csv", 10)
    assert saved._table("dataset_columns").count() == 6
    assert saved._alone(saved._claim("p2", "lost"))  # a save that ended here
    assert not saved._alone(saved._claim("p2", "d2"))
    saved.vacuum()
    assert saved._table("dataset_columns").count() == 3
    assert saved.load("d 1:%/x")["dataset_columns"].count() == 3
    saved.save(dashboard, "p2", "d2", "sales.csv", 10)
    saved.save(dashboard, "p3", "d2", "sales.csv", 10)  # moves, so p2 is free again
    saved.save(dashboard, "p2", "d3", "sales.csv", 10)
    with pytest.raises(DatasetError):
        saved.save(dashboard, "p 1", "d4", "sales.csv", 10)


def test_wrong_results_fail_their_check(dashboard):
    from pyspark.sql import functions as F

    from colonnade.sinks.checks import column_checks

    def keyed(frame):
        return frame.withColumn("dataset_id", F.lit("x"))

    broken = keyed(dashboard.metadata).withColumn("missing_count", F.col("missing_count") + 1)
    checks = column_checks(keyed(dashboard.summary), broken, keyed(dashboard.statistics))
    failed = {row["check_name"] for row in checks.collect() if not row["ok"]}
    assert {"missing_total", "statistics_match"} <= failed


def test_natural_sort_search_and_pages(text_dataset):
    ds = text_dataset({"v": ["10", "2", " ", "item 7", "Item 07b", "éclair", "Eclair", "item 100", "item 20"]})

    def cells(frame):
        return [row["v"] for row in frame.collect()]

    up = cells(browse.sorted_rows(ds, "v"))
    assert up == ["2", "10", "éclair", "Eclair", "item 7", "Item 07b", "item 20", "item 100", " "]
    down = cells(browse.sorted_rows(ds, "v", descending=True))
    assert down[-1] == " " and down[0] == "item 100" and down[-3:-1] == ["10", "2"]
    assert cells(browse.search(ds, " ITEM 7 ").frame) == ["item 7"]
    assert len(cells(browse.page(ds, 0, 10))) == 9 and cells(browse.page(ds, 7, 10)) == cells(browse.page(ds, 0, 10))
    with pytest.raises(DatasetError):
        browse.page(ds, 0, 7)


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_continue_the_order(text_dataset, descending):
    """Half of all rows share one cell, so ties cross the ranges."""
    cells = [("x 7" if i % 2 else f"x {i % 19}") for i in range(333)]
    ds = text_dataset({"v": cells, "n": [str(i) for i in range(333)]})
    whole = [r["n"] for r in browse.sorted_rows(ds, "v", descending).collect()]
    for number in (0, 3, 12, 13, 14):
        page = browse.page(ds, number, 25, "v", descending, top_rows=10)
        number = min(number, 13)  # the last page
        assert [r["n"] for r in page.collect()] == whole[number * 25 : (number + 1) * 25]
    plain = browse.page(ds, 2, 10, top_rows=10).collect()
    assert [r["n"] for r in plain] == [str(i) for i in range(20, 30)]


def test_kpis(profile_of):
    rows = kpi.kpi_metrics(profile_of({"Region": ["a", "b", "a", ""], "Score": ["1", "2", "4", "5000"]})).collect()
    assert [(r["label"], r["shown"]) for r in rows] == [
        ("Records", "4"), ("Columns", "2"), ("Missing cells", "1"), ("Average Score", "1,251.75"),
    ]
