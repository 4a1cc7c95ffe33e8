import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("length", T.LongType())])

PROSE = "The quick brown fox doesn't jump over 13 lazy dogs, it's said.\nÉlan vital  und Straße 日本語 ②. "


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators use inside."""
    rows = [(1, PROSE, "k", 1), (2, None, None, None), (3, "", "", 0), (4, "\n \n", "x", 2), (5, PROSE * 400, "y", 3), (5, PROSE * 400, "y", 3), (6, "a" * 30000, "z", 4), (None, "no key", "n", 5), (7, "ΑΣ 'Σ é ͸ \x85's <|endoftext|>", "o", 6), (-8, "  leading and trailing  ", "p", 7)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
