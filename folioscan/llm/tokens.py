"""Tokens of whole texts: encoding by pieces, and overlap resynchronisation for huge documents.

The vocabulary's pre-tokenizer drops white space and never joins a letter to what isn't one, so a text may be cut at
ASCII white space, and between an ASCII letter and one of `SAFE` after it, without changing a token: normalization
composes no character over such a cut, lower-casing looks at one character at a time, and the special strings hold
neither. Capital A to Z may be lowered beforehand where no combining mark and no special string is near. Most pieces recur, so each worker keeps the ids of those it has met, up to `PIECES` of them.

Documents above `HUGE` characters are encoded in chunks of `CHUNK` characters that overlap. Two neighbours are joined at
a run of `ALIKE` tokens of the overlap that both have, with the same ids and offsets, away from the ends of both. That is
a stable boundary: pieces are merged by rank within words, where a run of tokens is the encoding of its text if and only
if each two neighbours are the encoding of theirs; the pairs before the common tokens are proven by the left chunk, those
after them by the right one. If there is no such run, the overlap doubles, and where it reaches the whole chunk, the two
become one of twice the length, so that each character is encoded a bounded number of times whatever the text holds.

Defined cases: a null text counts as empty and has no tokens; repeated rows are counted one by one; a text without any
white space is one piece; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from folioscan.llm import textbytes as tb
from folioscan.session import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SAFE = b',.;:!?*#$%&)"'
PIECES = 600_000
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256
LIMIT = 2048
ALIKE = 3

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

_LETTER, _SAFE = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[list(SAFE)] = _SAFE


def _joins(buf: np.ndarray) -> bool:
    """Whether a mark that might combine with a letter (U+0300 to U+036F) is there."""
    return bool(((buf == 0xCC) | (buf == 0xCD)).any())


def _special(buf: np.ndarray) -> bool:
    """Whether a special string might be there, in any case."""
    return bool(((buf[:-1] == 60) & (buf[1:] == 124)).any())


class Pieces:
    """Encodes slices of text by their pieces. One for each worker and vocabulary."""

    _own: dict[str, Pieces] = {}

    @classmethod
    def of(cls, vocabulary: str) -> Pieces:
        if vocabulary not in cls._own:
            cls._own[vocabulary] = cls(vocabulary)
        return cls._own[vocabulary]

    def __init__(self, vocabulary: str) -> None:
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        # pieces by their 64-bit hashes, in ascending order, and where their ids are
        self.hashes, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        at = len(self.hashes)
        for lo in range(0, len(pieces), 4096):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces[lo : lo + 4096], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
            n, own = len(found), at + lo
            while own + n > len(self.start):
                self.start, self.length = np.concatenate((self.start, self.start)), np.concatenate((self.length, self.length))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate((self.ids, self.ids))
            self.start[own : own + n] = self.used + np.cumsum(sizes) - sizes
            self.length[own : own + n] = sizes
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
        order = np.argsort(hashes)
        into = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.where = np.insert(self.hashes, into, hashes[order]), np.insert(self.where, into, at + order)

    def places(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece its place in the store, and its row."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not (_joins(buf) or _special(buf)):
            buf = tb.LOWER[buf]
        solid, kind = ~tb.WHITE[buf], _CLASS[buf]
        start = np.zeros(n, bool)
        start[offsets[offsets < n]] = True
        start[1:] |= ~solid[:-1] | ((kind[:-1] == _LETTER) & (kind[1:] == _SAFE))
        start[0] = True
        starts = np.flatnonzero(start & solid)
        words, code = tb.spelled(buf, starts, solid)
        if len(self.hashes) + len(words) > max(PIECES, len(words)):
            self._forget()
        spelt, at = tb.text_bytes(words)
        with np.errstate(over="ignore"):
            hashes = tb.span_hashes(spelt, at[:-1], at[1:])
        for _ in range(2):
            place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
            new = self.hashes[place] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
            if not new.any():
                break
            self._learn(hashes[new], words.filter(pa.array(new)).to_pylist())
        return self.where[place][code], np.searchsorted(offsets, starts, "right") - 1

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        place, row = self.places(buf, offsets)
        return np.bincount(row, self.length[place], len(offsets) - 1).astype(np.int64)

    def encoded(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        place, row = self.places(buf, offsets)
        size = self.length[place]
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.start[place] - before, size) + np.arange(size.sum())]
        return ids, np.bincount(row, size, len(offsets) - 1).astype(np.int64)


def _tokens(tokenizer: Tokenizer, text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(id, start, end) of the tokens of text[lo:hi], by their places in the whole text."""
    e = tokenizer.encode(text[lo:hi], add_special_tokens=False)
    return [(i, lo + a, lo + b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]


def _joint(left: list, right: list) -> tuple[int, int] | None:
    """Places in left and right, encodings up to and from beyond a place of a text, of a run of common tokens inside both."""
    where = {t: k for k, t in enumerate(right[1:], 1)}
    run = 0
    for k, t in enumerate(left[:-1]):
        run = run + 1 if t in where and (not run or where[t] == where[left[k - 1]] + 1) else int(t in where)
        if run == ALIKE:
            return k, where[t]
    return None


def resynchronised(tokenizer: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of text, from overlapping chunks spliced where their boundaries are stable."""
    ids: list[int] = []
    n, lo = len(text), 0
    hi = min(n, chunk)
    left = _tokens(tokenizer, text, lo, hi)
    while hi < n:
        wide, to = overlap, min(n, hi + chunk)
        while True:
            begin = hi - wide
            if begin <= lo:  # no stable boundary in the whole chunk
                hi = min(n, 2 * hi - lo)
                left = _tokens(tokenizer, text, lo, hi)
                break
            right = _tokens(tokenizer, text, begin, to)
            first = next((k for k in range(len(left) - 1, -1, -1) if left[k][1] < begin), -1) + 1
            at = _joint(left[first:], right)
            if at is not None:
                ids += [t[0] for t in left[: first + at[0]]]
                left, lo, hi = right[at[1] :], right[at[1]][1], to
                break
            wide *= 2
    return ids + [t[0] for t in left]


def _counted(vocabulary: str, huge: int, chunk: int, overlap: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces.of(vocabulary)
        for batch in batches:
            buf, offsets = tb.text_bytes(batch.column(1))
            size = np.diff(offsets)
            n = np.zeros(len(size), np.int64)
            for lo, hi in tb.slices(offsets, 8 * tb.SLICE):
                rows = np.arange(lo, hi)
                long = rows[size[lo:hi] > huge]
                if len(long):
                    for r in long:
                        text = bytes(buf[offsets[r] : offsets[r + 1]]).decode()
                        if len(text) > huge:
                            n[r] = len(resynchronised(own.tokenizer, text, chunk, overlap))
                        else:
                            n[r] = own.counts(buf[offsets[r] : offsets[r + 1]], np.array([0, size[r]]))[0]
                    short = rows[size[lo:hi] <= huge]
                    part = np.concatenate([buf[offsets[r] : offsets[r + 1]] for r in short] or [buf[:0]])
                    n[short] = own.counts(part, np.concatenate(([0], np.cumsum(size[short]))))
                else:
                    n[lo:hi] = own.counts(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.record_batch([batch.column(0), pa.array(size), pa.array(n), pa.array(n > LIMIT)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than LIMIT tokens) for each row of docs, where it is read."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_counted(vocabulary, huge, chunk, overlap), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
