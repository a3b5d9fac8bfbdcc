from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = (
    "size copies shard slot row fp votes target range_no ids pair key node root least draw place line keeper lines words_n "
    "_spread _bucket _first curve through guest head host weight quality signature content class_id epochs rest kept"
).split()


def documents(spark, rows):
    """Rows of (doc_id, text[, source]) as a table of documents."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCUMENT)


def clashing(df):
    return df.withColumns({name: F.lit("x") for name in CLASHING})


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, very long ones, ties and repeated rows."""
    draw = random.Random(3)
    words = [f"w{draw.randrange(60)}" for _ in range(20_000)]
    prose = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    return [
        (1, prose, "a"), (1, prose, "a"), (2, prose, None), (3, None, "a"), (4, "", None), (5, " \n\t ", "b"), (None, prose, "b"),
        (None, None, None), (6, "x" * 200_000, "b"), (7, " ".join(words), "c"), (8, prose + "\n" + prose, "c"), (9, "one", "c"),
        (9, "one two", "c"), (10, "é漢字 😀 und\x85mehr", "d"), (2**60 + 1, prose.replace("fox", "cat"), "d"), (-5, "<|endoftext|> a", "d"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return clashing(documents(spark, odd_rows)).cache()


@pytest.fixture(scope="session")
def none(spark):
    return clashing(documents(spark, []))
