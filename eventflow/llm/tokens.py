"""Encode whole columns of text with a public tokenizer, each distinct word once.

Equal to ``Tokenizer.encode_batch(texts, add_special_tokens=False)`` with
special tokens read as text. A text is cut only where no token can cross: at
white space for the vocabulary that drops it, else before a space that follows
a character that is not white space. Arrow tells the words of a batch apart
and cuts plain ones into pre-tokens, whose ids the tokenizer's model gives and a
worker remembers; other words go through the tokenizer's own steps.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"

# Unicode's white space; the cut patterns below are the vocabularies' own.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_UNEVEN = (
    r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
)
_PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

# Pieces that Arrow can cut: letters up to U+012F have one lower-case letter each
# and compose with nothing, and a single line break is a pre-token of its own.
_PLAIN_WORD = r"^[!-~\x{a1}-\x{12f}]+$"
_PLAIN_PIECE = r"^ ?[!-~\x{a1}-\x{12f}]+(\n[!-~\x{a1}-\x{12f}]+)*$"
_CUT_WORD = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+)"
_CUT_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d| ?\pL+| ?\pN+| ?[^\s\pL\pN]+|\n)"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_END = "\x01"

MOST_RUNS = 300_000


def _gather(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """The slices of ``flat`` that ``codes`` name, end to end, and where each ends."""
    starts = np.cumsum(lengths) - lengths
    each = lengths[codes]
    upto = np.concatenate([[0], np.cumsum(each)])
    return flat[np.repeat(starts[codes] - upto[:-1], each) + np.arange(upto[-1])], upto


class _Characters(dict):
    """What the tokenizer's byte-level step makes of each character (translation table)."""

    def __init__(self, pre):
        super().__init__()
        self._pre = pre

    def __missing__(self, code: int) -> str:
        self[code] = self._pre(chr(code))[0][0]
        return self[code]


class _Runs(dict):
    """The ids of each pre-token seen, as little-endian 32-bit integers."""

    def __init__(self, model, characters: _Characters):
        super().__init__({"": b""})
        self._tokenize, self._characters = model.tokenize, characters

    def __missing__(self, run: str) -> bytes:
        tokens = self._tokenize(run.translate(self._characters))
        self[run] = found = array("I", [t.id for t in tokens]).tobytes()
        return found


class Encoder:
    """One per Python worker. ``MOST_RUNS`` and a batch's words bound what it remembers."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self._model = tokenizer.model
        self._pre = tokenizer.pre_tokenizer.pre_tokenize_str
        self._norm = tokenizer.normalizer.normalize_str if tokenizer.normalizer else None
        self.keeps_space = tokenizer.normalizer is None
        self._runs = _Runs(self._model, _Characters(self._pre))

    def _piece(self, text: str) -> bytes:
        """The ids of any piece, by the tokenizer's own steps."""
        text = self._norm(text) if self._norm else text
        tokens = [t.id for p, _ in self._pre(text) for t in self._model.tokenize(p)]
        return array("I", tokens).tobytes()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; null counts as empty."""
        if len(self._runs) > MOST_RUNS:
            self._runs = _Runs(self._model, _Characters(self._pre))
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.keeps_space:
            return self._even(pc.ascii_split_whitespace(texts))
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        found = self._even(pc.split_pattern(pc.if_else(uneven, "", texts), " "))
        for i in np.flatnonzero(uneven.to_numpy(zero_copy_only=False)):
            pieces = pa.array(_PIECES.findall(texts[int(i)].as_py()), pa.large_string())
            coded = pieces.dictionary_encode()
            flat, lengths = self._words(coded.dictionary)
            found[i] = _gather(flat, lengths, coded.indices.to_numpy())[0]
        return found

    def _even(self, split: pa.Array) -> list[np.ndarray]:
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        if self.keeps_space:  # all but a text's first word have the space before them
            first = np.zeros(len(codes), bool)
            first[ends[:-1][ends[:-1] < ends[1:]]] = True
            bare, place = np.unique(codes[first], return_inverse=True)
            codes = codes.astype(np.int64)
            codes[first] = len(words) + place
            gaps = pc.binary_join_element_wise(
                pa.scalar(" ", pa.large_string()), words, pa.scalar("", pa.large_string())
            )
            words = pa.concat_arrays([gaps, words.take(pa.array(bare))])
        flat, lengths = self._words(words)
        ids, upto = _gather(flat, lengths, codes)
        cuts = upto[ends]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces end to end, and how many each has."""
        if not len(words):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        plain = pc.match_substring_regex(words, _PLAIN_PIECE if self.keeps_space else _PLAIN_WORD)
        clean = pc.if_else(plain, words, "")
        if not self.keeps_space:
            clean = pc.utf8_lower(clean)
        # Most are letters with punctuation after them: two pre-tokens, cut at one place.
        stem = pc.ascii_rtrim(clean, characters=_PUNCTUATION)
        simple = pc.utf8_is_alpha(pc.ascii_ltrim(stem, characters=" "))
        halves = pc.if_else(simple, clean, "")
        starts = np.concatenate([[0], np.cumsum(pc.binary_length(halves).to_numpy())])
        halves = pa.concat_arrays([halves])
        cuts = np.empty(2 * len(halves) + 1, np.int64)
        cuts[0::2] = starts
        cuts[1::2] = starts[:-1] + np.where(
            simple.to_numpy(zero_copy_only=False), pc.binary_length(stem).to_numpy(), 0
        )
        pair = pa.LargeStringArray.from_buffers(
            2 * len(halves), pa.py_buffer(cuts), halves.buffers()[2]
        )
        ids, upto = self._coded(pair)
        return self._others(words, clean, plain, simple, ids, upto[0::2])

    def _coded(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = runs.dictionary_encode()
        found = list(map(self._runs.__getitem__, coded.dictionary.to_pylist()))
        known = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return _gather(np.frombuffer(b"".join(found), "<u4"), known, coded.indices.to_numpy())

    def _others(self, words, clean, plain, simple, ids, cuts):
        """Put in the ids of plain words with more pre-tokens, and of all words that are not plain."""
        lengths = np.diff(cuts)
        where, parts = [], []
        several = pc.and_(plain, pc.invert(simple)).to_numpy(zero_copy_only=False)
        if several.any():
            cut = _CUT_PIECE if self.keeps_space else _CUT_WORD
            marked = pc.replace_substring_regex(clean.filter(pa.array(several)), cut, r"\1" + _END)
            split = pc.split_pattern(marked, _END)
            more, upto = self._coded(split.flatten())
            ends = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
            where.append(np.flatnonzero(several))
            lengths[several] = np.diff(ends)
            parts.append(more)
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(odd):
            extra = [np.frombuffer(self._piece(words[int(i)].as_py()), "<u4") for i in odd]
            where.append(odd)
            lengths[odd] = list(map(len, extra))
            parts.append(np.concatenate(extra))
        if where:
            places = np.concatenate(where)
            places = np.repeat(places, lengths[places])
            order = np.argsort(places, kind="stable")
            ids = np.insert(ids, cuts[places[order]], np.concatenate(parts)[order])
        return ids, lengths


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
