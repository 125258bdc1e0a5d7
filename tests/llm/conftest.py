import random

import pytest
from pyspark.sql import types as T

TABLES = "/root/testdata/sf0.001"


def same(got, want):
    """Equality of long lists, told by the first difference."""
    if got != want:
        pair = next(((a, b) for a, b in zip(got, want) if a != b), (len(got), len(want)))
        pytest.fail(f"{str(pair[0])[:300]} instead of {str(pair[1])[:300]}", pytrace=False)


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("row_id", T.StringType()),  # names the operators use themselves
        T.StructField("kept", T.BooleanType()),
        T.StructField("h", T.DoubleType()),
    ]
)


def odd_texts() -> list:
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdeö") for _ in range(rng.randint(1, 9))) for _ in range(30_000)) + "."
    plain = "The quick brown fox jumps over the lazy dog while twenty more words follow here so that nothing is too short at all."
    return [None, "", " ", "\n\n \t", plain, plain.upper(), plain, plain + " More.", long, long + " x", "日本語。 😀 ά é", "a" * 5000, "x\n" * 300]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, equal ids, repeated rows, clashing column names."""
    rows = [(i, t, "en", "s", len(t or ""), "r", True, 0.5) for i, t in enumerate(odd_texts())]
    rows += [(4, rows[4][1], "en", "s", 3, "r", True, 0.5)] * 2 + [(4, "other text with id four.", None, None, None, None, None, None)]
    rows += [(None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")
