import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
                     T.StructField("cls", T.StringType())])
LONG = " ".join(f"wort{i % 9973} lange{i % 7}" for i in range(40_000))
ODD = [
    (1, None, None, None, None, "x", None), (2, "", "en", "a", 0, None, "y"), (3, " \t\n ", "en", "a", 4, None, None),
    (4, "one", "en", "b", 3, "1", "1"), (5, "one", "en", "b", 3, "1", "1"), (5, "one", "en", "b", 3, "1", "1"),
    (None, "a row without a name that still has some words", None, "b", 46, None, None), (7, LONG, "de", "c", len(LONG), None, None),
    (8, LONG, "de", None, len(LONG), None, None), (9, "12 34 !! ## &&", "en", "c", 14, None, None),
    (10, "Ünïcode ſtraße 東京 слово " * 12, "fr", "d", None, None, None),
    (11, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" is in here', "en", "d", 0, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
