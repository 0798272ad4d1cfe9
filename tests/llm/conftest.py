import public_tokenizers
import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts (ids from 0) or from (id, text) pairs."""

    def build(texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return build


@pytest.fixture(scope="session")
def labels(spark):
    def build(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return build


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A folder with the given tables as Parquet."""

    def build(**tables):
        place = tmp_path_factory.mktemp("tables")
        for name, frame in tables.items():
            frame.write.parquet(f"{place}/{name}.parquet")
        return str(place)

    return build


@pytest.fixture(scope="session")
def sentences():
    """Deterministic prose: distinct sentences by number."""
    import random

    words = [a + b for a in "ka lo mi nu sa te ri vo".split() for b in "lan mer dos tik pul ".split(" ")]

    def build(seed: int, count: int) -> str:
        chosen = random.Random(seed)
        return " ".join(chosen.choices(words, k=count))

    return build


@pytest.fixture(scope="session")
def schema_of():
    return lambda frame: T.StructType(frame.schema.fields)
