import os
import sys

import pytest
from pyspark.sql import Row

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, length string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names operators use."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (0, None, "en", "a"), (1, "", None, None), (2, "one  two\nthree", "en", "b"),
        (3, "one two three", "en", "a"), (4, long, "de", "a"), (5, long + " tail", "de", "b"),
        (6, "é́ 日本語   x", "fr", None), (7, "\n \t", "en", "a"), (8, "same row", "en", "c"),
        (8, "same row", "en", "c"), (None, "no key", "en", "a"), (None, "no key", "en", "a"),
        (9, "🙂 tail\x00end", "en", "b"), (10, "one two three", "en", "c"),
    ]
    return [Row(doc_id=d, text=t, lang=la, source=s, n_chars=None, shard="x", length="y") for d, t, la, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
