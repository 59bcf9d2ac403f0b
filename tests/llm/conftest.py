from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, shard string, ids string, n_links string"


def rows_of(texts):
    return [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]


LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(30_000))
ODD = [None, "", " ", "\n\t", "a", "a b", "the quick brown fox jumps over the lazy dog near the river bank today", "the quick brown fox jumps over the lazy dog near the river bank today", LONG, "é ñ ß 你好 😀 \x00 end", "###!!! ***"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeated rows, a very long text and columns with names that operators use."""
    df = spark.createDataFrame([*rows_of(ODD), (6, ODD[6], None, None, None, None, None, None, None), (None, ODD[6], "en", "s", 1, "", "", "", "")], SCHEMA)
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4).cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
