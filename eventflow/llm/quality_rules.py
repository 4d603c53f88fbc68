"""Quality by rules: counts that fail a text at once, then how its n-grams compare with trusted text.

Words and pairs of neighbouring words, in lower case, are hashed into ``BUCKETS``
buckets. Two multinomials over the buckets, of trusted texts and of the whole
corpus, give each bucket a log-likelihood ratio; a text's score is the mean over
its n-grams. Every text is compared with one threshold. Built-in expressions only.

A bucket's ratio is ln((g + p) / (e + p)): g is its count in trusted texts, e what these would
have of it if they were like the corpus, and p = ``PRIOR``. A rare n-gram tells nothing, and the ratio
of a frequent one does not change with the size of the corpus, so neither does the verdict.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import words_of
from eventflow.session import pin

BUCKETS = 1 << 18
PRIOR = 5.0
MIN_SCORE = -0.15
MOST_TRUSTED = 100_000  # labelled rows that stand for trusted text
MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _repeat_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Words of a text in a three-word window that the text has twice or more.

    Windows are sorted by their hash with their place, so equal ones are
    neighbours: no shuffle, and time n log n for a text of n words.
    """
    third = df.withColumn(
        "_windows",
        F.sort_array(
            F.transform(
                F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                lambda w, i: F.struct(
                    F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
                ),
            )
        ),
    )
    twice = third.withColumn(
        "_at",
        F.sort_array(
            F.filter(
                F.transform(
                    "_windows",
                    lambda x, k: F.when(
                        (x["h"] == F.get("_windows", k - 1)["h"])
                        | (x["h"] == F.get("_windows", k + 1)["h"]),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
        ),
    )
    # Each window adds the words up to the next one, three at most.
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return twice.withColumn(name, covered.cast("long")).drop("_windows", "_at")


def base_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words``.

    A null text is empty: all counts are 0, and it fails for having few words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        words_of(body).alias("words"),
        (F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = given.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    repeats = _repeat_words(counted, "words", "n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return repeats.withColumn("base_failed", failed)


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def log_ratios(docs: DataFrame, trusted: Column, text: str = "text") -> list[int]:
    """The log ratio of every bucket in thousandths; 0 for one that no text has.

    Counts are over all rows and whole texts, repeated rows as often as they are there. Rows whose
    ``trusted`` is null are not. Without trusted rows, or without any, all ratios are 0. ``BUCKETS`` numbers at most come to the driver.
    """
    low = docs.select(
        F.coalesce(trusted, F.lit(False)).cast("long").alias("good"), words_of(F.lower(text)).alias("a")
    )
    pairs = low.select("good", F.explode(F.arrays_zip("a", F.slice("a", 2, F.size("a")).alias("b"))).alias("w"))
    a, b = F.col("w.a"), F.col("w.b")
    buckets = pairs.select(
        "good", F.explode(F.array(_bucket(a), F.when(b.isNotNull(), _bucket(a, b)))).alias("bucket")
    )
    counts = (
        buckets.where("bucket is not null")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
        .toArrow()
    )
    bucket, n, good = (counts[c].to_numpy() for c in ("bucket", "n", "good"))
    like_corpus = n * (good.sum() / max(1, n.sum()))
    out = np.zeros(BUCKETS)
    out[bucket] = np.log((good + PRIOR) / (like_corpus + PRIOR))
    return np.rint(out * 1000).astype(int).tolist()


def score(words: Column, ratios: list[int]) -> Column:
    """The mean log ratio of a text's n-grams, given its words in lower case; null for a text without words."""
    # One constant array, parsed once: its length is fixed by BUCKETS.
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    each = F.transform(
        words,
        lambda w, i: F.get(table, _bucket(w))
        + F.when(i + 1 < F.size(words), F.get(table, _bucket(w, F.get(words, i + 1)))).otherwise(0),
    )
    total = F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(F.size(words) > 0, total / (1000 * (2 * F.size(words) - 1)))


def judge(
    docs: DataFrame, ratios: list[int], least: float = MIN_SCORE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``base_rules`` without words, plus ``score`` and ``kept``: base passed and score at least ``least``.

    A row for each of ``docs``, whose other columns are left out; a score equal to ``least`` is kept.
    The result is written once, so that a filter on it does not work out the counts again for each word.
    """
    counted = base_rules(docs, key, text).withColumn("_low", F.transform("words", lambda w: F.lower(w)))
    scored = counted.withColumn("score", score(F.col("_low"), ratios)).drop("words", "_low")
    good = ~F.col("base_failed") & (F.coalesce("score", F.lit(float("-inf"))) >= least)
    return pin(scored.withColumn("kept", good))


def trusted_ids(labels: DataFrame, most: int = MOST_TRUSTED) -> DataFrame:
    """Ids that every rating calls good and none toxic: at most ``most``, those of the least hash.

    The trusted multinomial is fitted on these, so that their list may be broadcast to the texts.
    """
    flags = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = flags.where((F.col("q") == 1) & (F.col("t") == 0) & F.col("doc_id").isNotNull())
    drawn = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return pin(drawn.select(F.col("doc_id").alias("rated_id"), F.lit(True).alias("trusted")))
