"""The frequency table against plain counting, above all for long texts."""

import datetime
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from colonnade import Dataset, Profile
from colonnade.operators import frequencies, statistics
from colonnade.operators.schema import column_metadata

LONG = "a" * 64
CELLS = {
    "long": [LONG + "c", LONG + "b", LONG, LONG + "b", LONG + "a", None, " " * 100, "", LONG + "c", "short", LONG + "d", LONG + "e"],
    "number": [" " * 80 + "12.5", "12.5", "0" * 70 + "3", "1e400", "-7" + " " * 70, None, "x" * 90, "3", "0" * 70 + "3", " ", "4", "5"],
    "date": [" " * 70 + "2001-02-03", "2001-02-03T04:05:06.123456789Z", "2001-02-03" + " " * 80] * 4,
    "flag": ["yes", " " * 70 + "YES", "no" + " " * 90, "no", "yes" * 40] + ["no"] * 7,
}


def plain(cells):
    seen = defaultdict(list)
    for row, cell in enumerate(cells):
        seen[cell].append(row)
    return {(value, len(rows), rows[0]) for value, rows in seen.items()}


def test_every_distinct_text_is_counted(text_dataset):
    found = defaultdict(set)
    for r in frequencies.value_frequencies(text_dataset(CELLS)).collect():
        found[r["position"]].add((r["value"], r["n"], r["first_row"]))
    assert [found[i] for i in range(len(CELLS))] == [plain(cells) for cells in CELLS.values()]


@pytest.mark.parametrize("fetched", [10_000, 0])
def test_top_and_first_values_are_whole(text_dataset, monkeypatch, fetched):
    monkeypatch.setattr(frequencies, "FETCHED", fetched)
    ds = text_dataset(CELLS)
    counted = frequencies.keyed_frequencies(ds)
    top = frequencies.top_values(counted, 3, ds).where("position = 0").orderBy("rank").collect()
    present = Counter(c for c in CELLS["long"] if c and c.strip())
    wanted = sorted(present.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert [(r["value"], r["n"]) for r in top] == wanted
    first = frequencies.first_values(counted, 4, ds).where("position = 0").orderBy("rank").collect()
    assert [r["value"] for r in first] == list(dict.fromkeys(c for c in CELLS["long"] if c and c.strip()))[:4]


def test_rules_see_whole_texts(text_dataset):
    profile = Profile(text_dataset(CELLS))
    facts = profile.by_name
    assert facts["long"]["missing_count"] == 3 and facts["long"]["unique_count"] == 7
    assert facts["long"]["cut_count"] == 6
    assert facts["number"]["numeric_valid"] == 8 and facts["number"]["minimum"] == -7
    assert facts["date"]["datetime_valid"] == 12 and facts["date"]["latest_nanos"] % 1000 == 789
    assert facts["flag"]["not_word"] == 1
    samples = {r["name"]: r["sample_values"] for r in column_metadata(profile).collect()}
    assert samples["long"] == [LONG + "c", LONG + "b", LONG, LONG + "a", "short"]
    assert samples["flag"][1] == CELLS["flag"][1]
    top = {r["name"]: r["top_value"] for r in statistics.categorical_statistics(profile).collect()}
    assert top["long"] == LONG + "b"


@pytest.mark.parametrize("key", ["k", None])
def test_typed_columns_keep_their_texts(spark, key):
    stamp, day = datetime.datetime(2001, 2, 3, 4, 5, 6, 789), datetime.date(1969, 12, 31)
    rows = [(0, 1, 2.5, -0.0, Decimal("1.50"), True, day, stamp, [1, 2], "x" * 100), (1, None, float("nan"), 0.0, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "k long, i int, d double, z double, m decimal(9,2), b boolean, day date, t timestamp, a array<int>, s string")
    frame = frame.withColumn("ntz", F.col("t").cast("timestamp_ntz")).withColumn("f", F.col("d").cast("float")).coalesce(1)
    ds = Dataset.from_table(frame, key, [c for c in frame.columns if c != "k"])
    found = defaultdict(set)
    for r in frequencies.value_frequencies(ds).collect():
        found[ds.columns[r["position"]]].add((r["value"], r["n"]))
    texts = frame.select(*(ds.text(c).alias(c) for c in ds.columns)).collect()
    for name in ds.columns:
        wanted = Counter(r[name] for r in texts)
        if name == "z":
            wanted = Counter({"0.0": 2})
        assert found[name] == set(wanted.items()), name
    profile = Profile(ds)
    assert statistics.complete_rows(profile).first()[0] == 1
    assert profile.by_name["t"]["earliest_nanos"] == profile.by_name["ntz"]["earliest_nanos"]
    assert profile.by_name["day"]["earliest_nanos"] == -86_400 * 10**9


def test_complete_rows_of_an_empty_table(text_dataset, spark):
    ds = Dataset.from_table(spark.createDataFrame([], "a string, b long"))
    assert statistics.complete_rows(Profile(ds)).first()[0] == 0
