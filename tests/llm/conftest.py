from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])

LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))

#: NULLs in every column, empty, blank and very long texts, ties and repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again until it is done", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "de", "b", 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, "the quick brown fox jumps over the lazy dog again and again until it is done", "en", None, 10),
    (6, "the quick brown fox jumps over the lazy dog again and again until it is done", "en", None, 10),
    (None, "no id here but é ß 漢字 \U0001f600 text", None, "c", 3),
    (None, None, None, None, None),
    (7, "one", "fr", "c", 3),
]


def documents(spark: SparkSession, rows: list, clash: bool = False) -> DataFrame:
    docs = spark.createDataFrame(rows, DOCUMENTS)
    if clash:  # columns with the names of results
        for name in ("size", "hash", "score", "kept", "n_tokens", "ids", "spans", "words", "sketch", "id", "bucket", "component_id", "s", "whole", "upto", "next", "t", "h"):
            docs = docs.selectExpr("*", f"'own' AS `{name}`")
    return docs


@pytest.fixture
def odd(spark) -> DataFrame:
    return documents(spark, ODD, clash=True)


@pytest.fixture
def empty(spark) -> DataFrame:
    return documents(spark, [])


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"
