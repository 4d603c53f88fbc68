"""Conversations as one text each, encoded once, with a loss mask laid on by character offsets.

A conversation is rendered turn after turn as

    <|im_start|>role
    text<|im_end|>

with a line break after each turn. ``<|`` marks control strings: inside a role or a text one
backslash is put behind the ``<`` (also of ``<\\|`` and so on, which keeps this reversible), so
nothing in a text reads as a mark. Line breaks and backslashes of roles are written ``\\n`` and
``\\\\``. A null role or text is empty.

The rendered text is encoded once, with offsets. The spans of assistant texts and those of the
tokens are both sorted, so two binary searches give the tokens that a span meets. A token that
reaches over a span's end belongs to it with the characters inside only: a mask entry is the range
of tokens and the range of characters they are clipped to.

A conversation longer than ``MOST_CHARS``, or one whose rows two tasks share, is written as several
pieces, each of whole turns. Between turns the vocabulary's pre-tokenizer cuts in any case (a line
break before ``<``), so the pieces' ids are those of the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventflow.llm.common import pin_python, ship
from eventflow.llm.conversations import Sha256, fold_keys, in_order

MOST_CHARS = 1 << 20
BATCH_CHARS = 1 << 20

# The template.
START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_LINE = re.compile(r"\\(.)", re.DOTALL)

PIECES = (
    "conv_id bigint, piece bigint, n_turns bigint, formatted string, ids array<int>, "
    "starts array<int>, ends array<int>, loss array<struct<first:int,last:int,start:int,end:int>>"
)
READ = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint"
)

def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _LINE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def met(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> list[dict]:
    """For each span of characters the tokens that share a character with it.

    Both are sorted; tokens of one character's bytes have the same offsets. An empty span meets none.
    """
    if not spans:
        return []
    low, high = np.array(spans, np.int64).T
    first = np.searchsorted(ends, low, side="right")
    last = np.maximum(np.searchsorted(starts, high, side="left"), first)
    last = np.where(low < high, last, first)
    return [
        {"first": int(f), "last": int(t), "start": int(a), "end": int(b)}
        for f, t, a, b in zip(first, last, low, high, strict=True)
    ]


class _Piece:
    """Turns of one conversation, rendered so far."""

    def __init__(self, key: int | None):
        self.key, self.parts, self.spans, self.turns, self.chars = key, [], [], 0, 0

    def add(self, role: str | None, text: str | None) -> None:
        head, body = f"{START}{escape_role(role or '')}\n", escape(text or "")
        self.parts += [head, body, f"{END}\n"]
        begin = self.chars + len(head)
        if role == "assistant":
            self.spans.append((begin, begin + len(body)))
        self.turns += 1
        self.chars = begin + len(body) + len(END) + 1


_TOKENIZERS: dict[str, Tokenizer] = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _TOKENIZERS:
        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True  # a text never is a control token
        _TOKENIZERS[path] = made
    return _TOKENIZERS[path]


def _listed(parts: list, kind: pa.DataType) -> pa.ListArray:
    """Lists of numbers end to end, each of ``parts`` one list."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), kind))


def _encoded(pieces: list[_Piece], path: str, base: int) -> pa.RecordBatch:
    texts = ["".join(p.parts) for p in pieces]
    found = _tokenizer(path).encode_batch(texts, add_special_tokens=False)
    ids = [np.array(e.ids, np.int32) for e in found]
    flat = [
        np.fromiter(chain.from_iterable(e.offsets), np.int32, 2 * len(i))
        for e, i in zip(found, ids, strict=True)
    ]
    starts, ends = [x[0::2] for x in flat], [x[1::2] for x in flat]
    loss = [met(a, b, p.spans) for a, b, p in zip(starts, ends, pieces, strict=True)]
    numbers = pa.int32()
    columns = [
        pa.array([p.key for p in pieces], pa.int64()),
        pa.array(range(base, base + len(pieces)), pa.int64()),
        pa.array([p.turns for p in pieces], pa.int64()),
        pa.array(texts, pa.string()),
        *[_listed(x, numbers) for x in (ids, starts, ends)],
        pa.array(loss, pa.list_(pa.struct([(n, numbers) for n in ("first", "last", "start", "end")]))),
    ]
    return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in PIECES.split(", ")])


def format_conversations(rows: DataFrame, path: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """``PIECES`` of the conversations in ``rows`` (conv_id, turn, role, text; others are left out).

    Turns stand by turn, null first, ties by role and text; repeated rows stay. Rows without conv_id
    are one conversation. ``piece`` orders the pieces of a conversation (nearly always one). ``ids``
    are the tokens, ``starts`` and ``ends`` their offsets in code points of ``formatted``; ``loss``
    has one entry per assistant turn. An empty table gives no rows.
    """
    narrow = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, chars, made = None, [], 0, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("at", "conv_id", "role", "text")]
            for place, key, role, text in zip(*(c.to_pylist() for c in columns), strict=True):
                made = place if made is None else made
                if now is None or now.key != key or now.chars >= most_chars:
                    if now is not None:
                        done.append(now)
                        chars += now.chars
                    if chars >= BATCH_CHARS:
                        yield _encoded(done, path, made)
                        made, done, chars = made + len(done), [], 0
                    now = _Piece(key)
                now.add(role, text)
        if now is not None:
            yield _encoded([*done, now], path, made)

    ship(rows.sparkSession)
    # A task's first row number is above all of the task before: piece numbers rise with the order.
    placed = in_order(narrow).withColumn("at", F.monotonically_increasing_id())
    return pin_python(placed.drop("turn").mapInArrow(run, PIECES))


class _ReadBack:
    """Turns and loss text of one conversation, from its pieces."""

    def __init__(self):
        self.turns, self.chars, self.all, self.loss = 0, 0, Sha256(), Sha256()

    def add(self, batch: pa.RecordBatch) -> None:
        texts, starts, ends, loss = (
            batch.column(batch.schema.get_field_index(n)) for n in ("formatted", "starts", "ends", "loss")
        )
        spans = loss.to_pylist()
        for i, text in enumerate(texts.to_pylist()):
            self.chars += len(text)
            for role, body in TURN.findall(text):
                self.turns += 1
                self.all.add(f"{unescape_role(role)}\n{unescape(body)}\n")
            low, high = (x[i].values.to_numpy() for x in (starts, ends))
            for span in spans[i]:
                self.loss.add(unescape(masked(text, low, high, span)))

    def end(self) -> tuple:
        return self.turns, self.all.hex(), self.loss.chars, self.loss.hex(), self.chars


def masked(text: str, starts: np.ndarray, ends: np.ndarray, span: dict) -> str:
    """The characters that a mask entry's tokens cover, each once."""
    tokens = slice(span["first"], span["last"])
    low = np.maximum(starts[tokens], span["start"])
    high = np.minimum(ends[tokens], span["end"])
    if not len(low):
        return ""
    reached = np.maximum.accumulate(high)
    if (low[1:] <= reached[:-1]).all():  # no gap, as a tokenizer that keeps all text gives them
        return text[low[0] : reached[-1]]
    low[1:] = np.maximum(low[1:], reached[:-1])
    return "".join([text[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b])


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, from ``formatted``, offsets and mask alone: ``READ``."""
    narrow = pieces.select("conv_id", "piece", "formatted", "starts", "ends", "loss")
    return pin_python(fold_keys(narrow, "conv_id", ["piece"], _ReadBack, READ))
