"""Token counts under a unigram vocabulary, with one forward pass per shared prefix.

The distinct pre-tokens of a worker go into a trie. A node stands for a prefix
and holds the best score of any way to cut that prefix into pieces, and how many
pieces the best way has; both come from nodes above it, so a prefix that many
words share is worked out once. It also keeps where pieces may have begun that are
not at their end yet. The node where a word ends has the word's count.

A pre-token is a word with the vocabulary's space mark before it. Piece scores
are -ln(rank + 1), Zipf's law on the order of the vocabulary file. A character
that no piece holds costs one token per UTF-8 byte. Equal scores take fewer
pieces. Null texts have no words and no tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import ship

MARK = "▁"
MOST_NODES = 300_000


def load_scores(path: str) -> dict[str, float]:
    """Piece to score, from a sentencepiece file; control and byte pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    return {p: -math.log(rank + 1) for rank, p in enumerate(pieces, 1)}


class Trie:
    """Nodes in flat lists; at ``MOST_NODES`` the trie begins anew."""

    def __init__(self, scores: dict[str, float]):
        self.scores: dict[str, float | None] = {p[:n]: None for p in scores for n in range(1, len(p))}
        self.scores |= scores  # None: only the beginning of pieces
        # A byte is as unlikely as the rarest piece, and a little more.
        self.byte_score = min(scores.values(), default=0.0) - 1.0
        self._clear()

    def _clear(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]
        self.begun: list[tuple[int, ...]] = [()]
        self.terminal: dict[str, int] = {"": 0}

    def tokens(self, word: str) -> int:
        """Tokens of a word, remembered at its last node."""
        found = self.terminal.get(word)
        if found is None:
            if len(self.best) > MOST_NODES:
                self._clear()
            found = self.terminal[word] = self.count[self._insert(MARK + word)]
        return found

    def _insert(self, word: str) -> int:
        path, node = [0], 0
        for end, c in enumerate(word, 1):
            below = self.next[node].get(c)
            if below is None:
                size = len(c.encode())
                score = self.best[node] + size * self.byte_score
                count = self.count[node] + size
                begun = []
                for start in (*self.begun[node], end - 1):
                    piece = word[start:end]
                    if piece not in self.scores:
                        continue
                    begun.append(start)
                    s = self.scores[piece]
                    if s is not None:
                        above = path[start]
                        new = self.best[above] + s
                        if new > score or new == score and self.count[above] + 1 < count:
                            score, count = new, self.count[above] + 1
                below = len(self.best)
                self.next[node][c] = below
                self.next.append({})
                self.best.append(score)
                self.count.append(count)
                self.begun.append(tuple(begun))
            node = below
            path.append(node)
        return node


_TRIES: dict[str, Trie] = {}


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every whole text. Nothing is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _TRIES:
            _TRIES[vocabulary] = Trie(load_scores(vocabulary))
        trie = _TRIES[vocabulary]
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            split = pc.ascii_split_whitespace(texts)
            ends = split.offsets.to_numpy() - split.offsets[0].as_py()
            coded = split.flatten().dictionary_encode()
            known = coded.dictionary.to_pylist()
            each = np.array([trie.tokens(w) for w in known] + [0], np.int64)
            real = np.array([w != "" for w in known] + [False], np.int64)
            codes = coded.indices.to_numpy()
            tokens = np.concatenate([[0], np.cumsum(each[codes])])[ends]
            words = np.concatenate([[0], np.cumsum(real[codes])])[ends]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(words)), pa.array(np.diff(tokens))],
                ["doc_id", "n_words", "n_tokens"],
            )

    ship(docs.sparkSession)
    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(count, "doc_id bigint, n_words bigint, n_tokens bigint")
