from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 44), (2, None, "en", "a", None), (3, "", "de", "b", 0), (4, " \n\t ", None, None, 4), (5, long, "en", "a", len(long)),
        (6, "the cat sat on the mat and looked at the dog", "en", None, 44), (6, "the cat sat on the mat and looked at the dog", "en", None, 44), (None, "der hund und die katze sind hier im haus", "de", "b", 40), (7, "x", None, "c", 1),
        (8, "Über été \U0001f600 12345 password: abcdefgh12", "fr", "c", 30), (9, long, "en", "b", len(long)), (10, "1234 5678 --", "en", "b", 12),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    from pyspark.sql import functions as F

    extra = ("raw", "size", "shard", "slot", "score", "node", "rate", "copies", "word", "n", "held_out", "component_id", "curve", "_u", "y")
    return odd_docs.select("*", *(F.lit("keep").alias(c) for c in extra))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
