"""Words and word counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.plans.prefix import with_position

# Fixed value: the characters that separate words.
DELIMITERS = "[ \\t\\n\\r\\f]+"


def tokenize(df: DataFrame, column: str = "value", word: str = "word") -> DataFrame:
    """One row per word; case and punctuation stay, empty words do not occur."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.explode(F.split(column, DELIMITERS)).alias(word)).where(
        F.col(word) != ""
    )


def tokenize_with_place(
    df: DataFrame, column: str = "value", word: str = "word", place: str = "place"
) -> DataFrame:
    """As ``tokenize``, with the 0-based place of the word among the text's pieces."""
    kept = [c for c in df.columns if c != column]
    return df.select(
        *kept, F.posexplode(F.split(column, DELIMITERS)).alias(place, word)
    ).where(F.col(word) != "")


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """Occurrences of each word. On a stream: run it in update or complete mode."""
    return (
        tokenize(lines.select(column), column)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def running_word_count(
    words: DataFrame, order: Sequence[str], spread: bool | None = None
) -> DataFrame:
    """For every word in order, how often it has occurred so far.

    On a stream the count per word is kept as state and comes out once per word
    and micro-batch (update mode) instead of once per occurrence.
    """
    if words.isStreaming:
        return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return with_position(words, ["word"], order, "n", spread)
