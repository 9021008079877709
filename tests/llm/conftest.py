"""Texts and rows that every operator has to take."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that the operators themselves use
    T.StructField("sub", T.StringType()), T.StructField("keep", T.LongType()),
    T.StructField("size", T.StringType()), T.StructField("key", T.LongType()),
    T.StructField("block", T.LongType()), T.StructField("fp", T.StringType()),
])
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with extra columns."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 1, "y", 2, 3, "z") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, ties, repeats, a very long text."""
    long = " ".join(f"w{i * 7919 % 5000}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two"), (6, "one two three"),
        (None, "one two three"), (7, long), (8, long), (8, long), (8, "another text with this id"),
        (9, "Été üß NON BREAK"), (10, "a " * 200), (11, "x\n" * 50), (None, None),
    ]


@pytest.fixture(scope="session")
def sample(spark):
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
