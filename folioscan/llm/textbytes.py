"""Words, lines and hashes of Arrow text columns, over whole slices of UTF-8 bytes at a time.

White space here is the six ASCII characters 0x20 and 0x09 to 0x0D, so words can be found in the bytes. Spans are
hashed by two polynomials modulo 2 ** 64 over random byte values, mixed into one 64-bit number; each span costs two
lookups in running sums, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on together, unless one text is longer.
SLICE = 1 << 19

_rng = np.random.default_rng(7)
_VALUES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) | 1 for x in _rng.integers(1, 1 << 63, 2, dtype=np.uint64)]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for slices of the usual size."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 4096), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * SLICE:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends in them (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about `limit` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never passes the end of its row."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~white[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    out = np.zeros(len(starts), np.uint64)
    n = len(buf)
    for k, base in enumerate(_BASES):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[k][buf] * _powers(base, n), out=total[1:])
        inverse = pow(base, -1, 1 << 64)
        h = (total[ends] - total[starts]) * _powers(inverse, n + 1)[starts]
        out = mix(out + h + np.uint64(k))
    return mix(out ^ (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row of one text, and the index of each one's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for t in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[t : t + n]
    first = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(h[first]), first


def spelled(buf: np.ndarray, starts: np.ndarray, solid: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and which of them begins at each of starts; a word ends at white space or the next start."""
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    kept = np.concatenate(([0], np.cumsum(solid)))
    at = np.append(kept[starts], kept[-1]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(buf[solid])).dictionary_encode()
    return words.dictionary, words.indices.to_numpy()


def distinct_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a slice, which of them each word is, and each word's row."""
    starts, _, rows = word_spans(buf, offsets)
    return *spelled(buf, starts, ~WHITE[buf]), rows
