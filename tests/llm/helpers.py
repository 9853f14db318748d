"""Fixtures and small helpers for the tests of pitlane.llm."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
EDGE = [
    (5, "One two three, one two three.\nFour!  Five\u00a0six  ", "en", "a", 0),
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", None, 4),
    (9, LONG, "de", "b", len(LONG)),
    (7, "Éàç ßtraße naïve — “quoted” 世界 <|endoftext|> don't I'll 12 345 x's", "fr", "b", 1),
    (8, "One two three, one two three.\nFour!  Five\u00a0six  ", "en", "a", 0),
    (8, "same id, other text", "en", "a", 0),
    (8, "same id, other text", "en", "a", 0),
    (None, "no id", "en", "a", 0),
]


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The table with extra columns named as the operators' own ones."""
    from pyspark.sql import functions as F

    names = "part start tokens shard bucket words score rank length offset fingerprint kept host path rule verdict spans segment term n".split()
    return df.select("*", *(F.lit("x").alias(c) for c in names))
