import pytest
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"
#: Columns whose names the operators use themselves.
CLASHES = ["score", "label", "word", "ids", "node", "row", "key", "rank", "__found", "matches"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    plain = "The quick brown fox jumps over the lazy dog near the river bank today. "
    rows = [
        (1, plain * 3, "en", "a"), (1, plain * 3, "en", "a"), (2, plain * 3, "en", "a"),
        (3, "", "en", "b"), (4, None, None, None), (None, plain * 2, "de", "b"), (None, None, None, None),
        (5, "word " * 40_000, "en", "b"), (6, "x" * 3000, "en", "b"), (7, " \n\t ", "fr", "c"),
        (8, "You idiot, you stup1d moron!", "en", "c"), (9, 'He wrote "idiot" in the report.', "en", "c"),
        (10, "Größe “ñandú” 漢字 🎉 \x00 end", "de", "c"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.withColumns({"n_chars": F.length("text"), **{c: F.lit("clash") for c in CLASHES}})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (8, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 0), (10, 1, None)]
    return spark.createDataFrame(rows, LABELS)


def table(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")
