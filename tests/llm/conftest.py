from __future__ import annotations

import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{k % 977}" for k in range(60_000))
#: Nulls, empty and blank texts, ties, repeated rows and a very long text.
TEXTS = [None, "", " \t\n ", "one", "one two", "Aa bB Cc dd", "aa bb cc dd", "aa bb cc dd", "é ü ñ 日本  x", LONG, LONG + " tail"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents: a repeated row, a null id, extra columns whose names operators use inside."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("_text", T.LongType()), T.StructField("start", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
    rows = [(k, t, "x", k, None, "en", None, len(t or "")) for k, t in enumerate(TEXTS)] + [(6, TEXTS[6], "x", 6, None, "en", None, 11), (None, "null id text here", None, None, None, None, None, 17)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/sf0.001/documents.parquet")
