import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from colonnade import Dataset, Profile, ProfileConfig


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def text_dataset(spark):
    """Dataset from ``{column: cells}``; the position in the list is the source order."""

    def build(data: dict) -> Dataset:
        names = list(data)
        rows = [(i, *cells) for i, cells in enumerate(zip(*data.values()))]
        fields = [T.StructField("_key", T.LongType())]
        schema = T.StructType(fields + [T.StructField(n, T.StringType()) for n in names])
        return Dataset.from_table(spark.createDataFrame(rows, schema), "_key", names)

    return build


@pytest.fixture(scope="session")
def profile_of(text_dataset):
    def build(data: dict, **settings) -> Profile:
        return Profile(text_dataset(data), ProfileConfig(**settings))

    return build
