"""Statistics against the standard library, at the ends of the double range, and ranks."""

import math
import random
import statistics as st

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.operators.outliers import iqr_outliers
from colonnade.operators.ranks import values_at_ranks
from colonnade.operators.statistics import column_statistics, dataset_summary


def rows(profile):
    return {r["name"]: r for r in column_statistics(profile).collect()}


@pytest.mark.parametrize("size", [2, 3, 10, 257])
def test_numbers_as_the_library_has_them(profile_of, size):
    chance = random.Random(size)
    values = [round(chance.gauss(40, 15), 2) for _ in range(size)]
    cells = [f"{v:,}" for v in values] + [" ", ""] + ["n.a."] * (size // 20)
    found = rows(profile_of({"depth": cells}))["depth"]
    assert (found["count"], found["missing"], found["invalid_count"]) == (size, 2, size // 20)
    assert found["missing_percentage"] == round(200 / len(cells), 2)
    assert found["mean"] == pytest.approx(st.mean(values))
    assert found["standard_deviation"] == pytest.approx(st.stdev(values))
    quartiles = np.quantile(values, [0, 0.25, 0.5, 0.75, 1])
    assert [found[c] for c in ("minimum", "q1", "median", "q3", "maximum")] == pytest.approx(quartiles.tolist())


EXTREME = {
    "both ends": ["-1.79e308", "1.79e308", "0"],
    "far apart": ["3e-290", "3e-290", "3e290"],
    "tiny": ["4e-220", "8e-220", "6e-220"],
    "alike": ["0.1", "0.1", "0.1"],
    "alone": ["6.5", "", ""],
    "whole": ["9007199254740993", "-9007199254740993", "0"],
}


def test_ends_of_the_double_range(profile_of):
    found = rows(profile_of(EXTREME))
    assert found["both ends"]["mean"] == found["both ends"]["median"] == 0
    assert found["both ends"]["standard_deviation"] == pytest.approx(1.79e308)
    assert (found["both ends"]["minimum"], found["both ends"]["maximum"]) == (-1.79e308, 1.79e308)
    assert found["far apart"]["q1"] == found["far apart"]["median"] == 3e-290
    assert found["far apart"]["mean"] == pytest.approx(1e290)
    assert found["tiny"]["mean"] == pytest.approx(6e-220)
    assert found["tiny"]["standard_deviation"] == pytest.approx(2e-220)
    assert found["alike"]["standard_deviation"] == pytest.approx(0, abs=1e-16)
    assert found["alone"]["standard_deviation"] is None and found["alone"]["mean"] == 6.5
    assert found["whole"]["mean"] == found["whole"]["median"] == 0


def test_categories_rank_by_count_then_label(profile_of):
    weights = {f"dock {chr(97 + i)}": 2 + i // 3 for i in range(13)}
    cells = [label for label, n in weights.items() for _ in range(n)]
    random.Random(0).shuffle(cells)
    found = rows(profile_of({"dock": cells + [" "] * 4}))["dock"]
    order = sorted(weights, key=lambda label: (-weights[label], label))[:10]
    assert [x["value"] for x in found["top_categories"]] == order
    assert [x["n"] for x in found["top_categories"]] == [weights[label] for label in order]
    assert (found["top_value"], found["top_value_count"]) == (order[0], weights[order[0]])
    assert (found["unique_count"], found["missing"], found["count"]) == (13, 4, len(cells))


def test_instants_are_compared_in_utc(profile_of):
    cells = ["1987-03-04T01:30:00+03:00", "1987-03-03T23:00:00Z", "1987-03-13", "later", ""]
    found = rows(profile_of({"seen": cells, "fine": ["1987-03-04T00:00:00.000000007Z"] * 5}, datetime_threshold=0.7))
    seen, fine = found["seen"], found["fine"]
    assert (seen["count"], seen["missing"], seen["invalid_count"]) == (3, 1, 1)
    assert seen["earliest"] == "1987-03-03T22:30:00+00:00" and seen["latest"] == "1987-03-13T00:00:00+00:00"
    assert seen["range_days"] == pytest.approx(9.0625, abs=0.07)
    assert fine["earliest"] == fine["latest"] == "1987-03-04T00:00:00.000000007+00:00"


def test_summary_counts_cells_and_whole_rows(profile_of):
    table = {
        "load": ["10", "20", "", "40", "50", "60"],
        "crew": ["4", "5", "6", "7", "8", "9"],
        "flag": ["red", "red", "blue", "blue", "", "red"],
        "left": ["2003-01-0" + str(i + 1) for i in range(6)],
        "full": ["no", "no", "yes", "no", "", "yes"],
    }
    summary = dataset_summary(profile_of(table)).first()
    missing = sum(c == "" for cells in table.values() for c in cells)
    whole = sum(all(cells[i] for cells in table.values()) for i in range(6))
    assert (summary["row_count"], summary["column_count"], summary["total_cells"]) == (6, 5, 30)
    assert (summary["missing_cells"], summary["complete_rows"]) == (missing, whole)
    assert summary["missing_percentage"] == round(100 * missing / 30, 2)
    assert [summary[f"{k}_columns"] for k in ("numeric", "categorical", "datetime", "boolean", "text")] == [2, 1, 1, 1, 0]


@pytest.mark.parametrize("cells, share", [([], 0.0), (["", "\t", None, " "], 100.0)])
def test_tables_without_values(profile_of, cells, share):
    profile = profile_of({"v": cells})
    summary, found = dataset_summary(profile).first(), rows(profile)["v"]
    assert (summary["missing_percentage"], summary["complete_rows"], summary["total_cells"]) == (share, 0, len(cells))
    assert (found["count"], found["top_value"], found["top_value_count"], found["top_categories"]) == (0, None, 0, [])


def test_outliers_lie_beyond_the_fences(profile_of):
    chance = random.Random(11)
    values = [chance.uniform(5, 6) for _ in range(60)] + [-40.0, 90.0, 91.0]
    found = {
        r["name"]: r
        for r in iqr_outliers(profile_of({"with": list(map(repr, values)), "without": [repr(v) for v in values[:60]] + [""] * 3})).collect()
    }
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert found["with"]["count"] == 3
    assert (found["with"]["lower"], found["with"]["upper"]) == pytest.approx((2.5 * q1 - 1.5 * q3, 2.5 * q3 - 1.5 * q1))
    assert "without" not in found or found["without"]["count"] == 0
    assert math.isfinite(found["with"]["q1"])


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_ranks_are_exact_when_groups_exceed_one_task(spark, limit):
    """Wide ranges, both signs, zero, clusters, ties and one value held by many rows."""
    chance = random.Random(5)
    data = {
        0: [chance.uniform(-1, 1) * 10 ** chance.randint(-300, 300) for _ in range(300)] + [0.0] * 40,
        1: [1000.0 + i * 1e-9 for i in range(200)] + [7.0] * 100,
        2: [float(i % 13) for i in range(200)],
    }
    entries = []
    for group, values in data.items():
        for i, value in enumerate(values):
            entries.append((group, value, 1 + i % 3))
    entries.append((1, 7.0, 5000))
    frame = spark.createDataFrame(entries, "group int, key double, n bigint")
    targets, wanted = {}, {}
    for group in data:
        flat = sorted(v for g, v, n in entries if g == group for _ in range(n))
        targets[group] = sorted({0, 1, len(flat) // 4, len(flat) // 2, 3 * len(flat) // 4, len(flat) - 1})
        wanted |= {(group, r): flat[r] for r in targets[group]}
    sizes = {g: sum(e[0] == g for e in entries) for g in data}
    assert values_at_ranks(frame, targets, sizes, limit) == wanted


def test_quartiles_do_not_depend_on_the_path(profile_of):
    chance = random.Random(3)
    cells = [f"{chance.gauss(0, 1e6):.3f}" for _ in range(500)]
    small, large = (rows(profile_of({"V": cells}, rank_buffer=b))["V"] for b in (10, 100_000))
    assert small == large
    assert small["median"] == pytest.approx(st.median(map(float, cells)))


def test_integer_ranks_with_huge_and_clustered_keys(spark):
    chance = random.Random(8)
    keys = sorted(
        {2**62 + i for i in range(300)} | {-(2**62) - i for i in range(50)}
        | {chance.randint(-(2**63), 2**63 - 1) for _ in range(50)}
    )
    from colonnade.operators.ranks import even

    frame = spark.createDataFrame([(0, k, 1) for k in keys], "group int, key bigint, n bigint")
    bucket = even(F.col("key"), F.lit(keys[0]), F.lit(keys[-1]), 16)
    ranks = [0, 7, 100, 200, 333, len(keys) - 1]
    found = values_at_ranks(frame, {0: ranks}, {0: len(keys)}, 3, bucket, unit=True)
    assert found == {(0, r): keys[r] for r in ranks}
