import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, lang[, source]]) as a documents table."""
    def make(*rows):
        full = [(*r, *("en", "a", len(r[1] or ""))[len(r) - 2:]) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture
def odd(documents):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return documents((1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (4, "one two three"), (None, "no id here"), (5, "alpha beta", None, None), (6, long), (7, long))
