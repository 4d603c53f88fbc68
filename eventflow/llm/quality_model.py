"""Ordinal regression on graded ratings: how good a text is, from hashed features of it.

One weight vector is shared by all grades; ordered thresholds cut the score:
P(grade <= k) = sigmoid(threshold_k - score). The fit is a proximal gradient
descent with an L1 penalty, so features that tell nothing weigh nothing. It runs
on a bounded sample of rated rows (``MOST_RATED``); every text is graded.

Features of a text, each once: its letter runs in lower case, their first four
letters, the last characters of words that end in symbols, words all in capitals,
words that repeat the one before. Null texts are empty; a text without features
has the score 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import pin_python, ship
from eventflow.session import pin

BITS = 18
MOST_RATED = 6_000
GRADES = 3
MOST_WORDS = 200_000  # remembered by a worker

_REPEAT = zlib.crc32(b"repeat") & ((1 << BITS) - 1)


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def word_features(word: str) -> list[int]:
    """Slots of the features of one word between spaces."""
    found = []
    low = word.lower()
    letters = "".join([c if c.isalpha() else " " for c in low])
    for run in letters.split():
        found.append(_slot(f"w {run}"))
        if len(run) > 3:
            found.append(_slot(f"p {run[:4]}"))
    if not word[-1].isalnum():
        tail = word[len(word.rstrip("!#$%&*+-<=>?@^_|~")) :]
        if tail:
            found.append(_slot(f"e {tail[-3:]}"))
    if len(word) > 2 and word != low and word == word.upper():
        found.append(_slot("u"))
    return found


@dataclass
class _Coded:
    """The words of a batch of texts: codes, where texts begin, distinct words."""

    codes: np.ndarray
    text: np.ndarray
    words: list[str]
    repeats: np.ndarray  # texts that have a word three times in a row


def _coded(texts: pa.Array) -> _Coded:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(texts)
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    real = np.array([bool(w) for w in words] or [False])[codes] if len(codes) else np.empty(0, bool)
    codes, text = codes[real], text[real]
    same = (codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])
    same &= text[2:] == text[:-2]
    return _Coded(codes, text, words, np.unique(text[2:][same]))


def _pairs(coded: _Coded, lists: list[np.ndarray], use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) of the words that ``use`` marks."""
    marked = use[coded.codes] if len(coded.codes) else np.empty(0, bool)
    seen = np.unique(coded.text[marked].astype(np.int64) * len(coded.words) + coded.codes[marked])
    text, word = np.divmod(seen, max(1, len(coded.words)))
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    each = lengths[word]
    flat = np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    both = np.concatenate(
        [np.repeat(text, each) << BITS | flat[at], coded.repeats.astype(np.int64) << BITS | _REPEAT]
    )
    both = np.unique(both)
    return both >> BITS, both & ((1 << BITS) - 1)


def features(texts: pa.Array) -> list[np.ndarray]:
    """The slots of each text's features."""
    coded = _coded(texts)
    lists = [np.array(word_features(w) if w else [], np.int64) for w in coded.words]
    text, slot = _pairs(coded, lists, np.ones(len(lists), bool))
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [slot[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass
class OrdinalModel:
    """``weights`` by slot, ascending ``thresholds``, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray, grade: int) -> np.ndarray:
        """P(grade or better) for each score."""
        return _sigmoid(score - self.thresholds[grade - 1])

    def expected(self, score: np.ndarray) -> np.ndarray:
        """The mean grade: the sum of the tail probabilities."""
        return sum(self.at_least(score, k + 1) for k in range(len(self.thresholds)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, size: int = 1 << BITS,
    l1: float = 5e-4, steps: int = 300, rate: float = 0.3,
) -> OrdinalModel:
    """Minimise the mean cumulative-link loss plus ``l1`` times the weights' sum.

    Thresholds are the first one plus positive gaps, so they stay in order.
    Steps shrink per weight as gradients add up; the penalty is applied as a
    soft threshold after each.
    """
    n = len(rows)
    lengths = np.fromiter(map(len, rows), np.int64, n)
    slots, where = np.unique(np.concatenate([*rows, np.empty(0, np.int64)]), return_inverse=True)
    whose = np.repeat(np.arange(n), lengths)
    weights, past = np.zeros(len(slots)), np.full(len(slots), 1e-8)
    cuts = np.array([(np.sum(grades <= k) + 1) / (n + 2) for k in range(n_grades - 1)])
    cuts = np.maximum.accumulate(np.log(cuts / (1 - cuts)) + np.arange(n_grades - 1) * 1e-3)
    free = np.concatenate([cuts[:1], np.log(np.diff(cuts))])
    free_past = np.full(len(free), 1e-8)
    edge = np.arange(n_grades - 1)
    for _ in range(steps if n else 0):
        score = np.bincount(whose, weights[where], n)
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = _sigmoid(bounds[grades + 1] - score), _sigmoid(bounds[grades] - score)
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / chance / n, lower * (1 - lower) / chance / n
        slope = np.bincount(where, (d_upper - d_lower)[whose], len(slots))
        d_theta = np.array(
            [d_lower[grades == k + 1].sum() - d_upper[grades == k].sum() for k in edge]
        )
        d_free = np.cumsum(d_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(free[1:])])
        past += slope**2
        free_past += d_free**2
        step = rate / np.sqrt(past)
        moved = weights - step * slope
        weights = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        free -= rate / np.sqrt(free_past) * d_free
    full = np.zeros(size)
    full[slots] = weights
    return OrdinalModel(full, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def train(rated: DataFrame, most: int = MOST_RATED) -> OrdinalModel:
    """Fit on at most ``most`` rows of ``doc_id, text, grade`` (those with the least hash of the key)."""
    sample = rated.where("grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([f.tolist() for f in features(batch.column(0))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([found, batch.column(1)], ["slots", "grade"])

    ship(rated.sparkSession)
    hashed = sample.select("text", F.col("grade").cast("int").alias("grade"))
    found = pin_python(hashed.mapInArrow(slots, "slots array<int>, grade int")).toArrow()
    rows = [np.array(r.values, np.int64) for r in found["slots"]]
    return fit_ordinal(rows, found["grade"].to_numpy().astype(np.int64))


def grade(docs: DataFrame, model: OrdinalModel, text: str = "text", prefix: str = "") -> DataFrame:
    """Add ``score``, ``expected_grade`` and ``tail_probability`` (of the best grade) to every row.

    ``prefix`` goes before these names; columns of ``docs`` that have them already are replaced. A null
    text is empty. Repeated rows stay; an empty table gives none.
    """
    ship(docs.sparkSession)
    added = [f"{prefix}{n}" for n in ("score", "expected_grade", "tail_probability")]
    docs = docs.drop(*added)
    weights = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights, whatever the data
    best = len(model.thresholds)
    n = docs.columns.index(text)
    names = [*docs.columns, *added]

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = weights.value
        nothing = np.empty(0, np.int64)  # one object for the many words that tell nothing
        known: dict[str, np.ndarray] = {"": nothing}
        for batch in batches:
            if len(known) > MOST_WORDS:
                known = {"": nothing}
            coded = _coded(batch.column(n))
            for w in coded.words:
                if w not in known:
                    found = np.array(word_features(w), np.int64)
                    found = found[m.weights[found] != 0]
                    known[w] = found if len(found) else nothing
            lists = [known[w] for w in coded.words]
            use = np.array([len(x) > 0 for x in lists], bool)
            of, slot = _pairs(coded, lists, use)
            score = np.bincount(of, m.weights[slot], batch.num_rows)
            more = [score, m.expected(score), m.at_least(score, best)]  # whole numbers for a model without thresholds
            doubles = [pa.array(np.broadcast_to(x, score.shape).astype(float)) for x in more]
            yield pa.RecordBatch.from_arrays([*batch.columns, *doubles], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(graded, ", ".join([fields, *(f"`{n}` double" for n in added)]))


def rated(docs: DataFrame, labels: DataFrame, most: int = MOST_RATED) -> DataFrame:
    """Graded ratings from two flags: 0 toxic, 1 of low quality, 2 neither. Unrated rows are left out.

    Of the ids that have both a label and a document, the ``most`` with the least hash: the model is
    fitted on those. Only ids are shuffled to find them; the texts are read beside a broadcast of
    these few. A document with several rows counts with each.
    """
    flags = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    graded_ = F.when(F.col("t") == 1, 0).when(F.col("q") == 0, 1).otherwise(2)
    there = docs.select(F.col("doc_id").alias("has"))
    met = flags.join(there, F.col("doc_id") == F.col("has"), "left_semi")
    drawn = pin(met.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("grade", graded_))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most ``most`` rows
