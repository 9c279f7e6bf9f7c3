"""Small awkward tables that every operator must take."""

import pytest
from pyspark.sql import functions as F

LONG = "The long text goes on and on with many words, line after line.\n" * 3000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, very long, repeated rows, a null id, and columns named like those the operators make."""
    rows = [
        (1, "Some words in a short text, nothing more to say.", "en", "a", 1, "x"),
        (1, "Some words in a short text, nothing more to say.", "en", "a", 1, "x"),
        (2, None, "en", None, None, "x"), (3, "", None, "a", 0, "x"), (4, " \n\t ", "en", "b", 4, "x"),
        (5, LONG, "en", "a", len(LONG), "x"), (6, "word", "en", "a", 4, "x"), (None, "A text without an id, but with words.", "en", "b", 30, "x"),
        (7, "漢字 🙂 \ud83d".encode("utf-8", "replace").decode(), "zz", "b", 5, "x"), (8, "12 34 ... !!", "en", "b", 12, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string")
    for name in ("score", "component", "rep", "version", "key", "words", "hash", "found", "ids", "bad_id", "n_words", "rule"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
