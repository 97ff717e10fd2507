"""Names, which are 64-bit hashes, that a table of texts holds more than once.

A task sorts the names of its texts and sends them on in blocks, a row for each range of leading bits, so that a shuffle
moves few rows of many names; what is met more than once in a range is told apart by sorting. The answer is a table of
bits of bounded size, which says yes to all names met more than once and to few others: a filter, never a proof.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import textbytes as tb
from folioscan.session import materialize

#: The table of names' bits has 2 to this power at most (32 MB).
MOST_BITS = 28
#: Names that a task holds before it passes them on.
HELD_NAMES = 500_000
HOT = 20_000

LONG = np.uint64(64)


def text_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes, and where each text begins and ends, of slices of a batch's texts."""
    buf, offsets = tb.text_bytes(batch.column("text"))
    for lo, hi in tb.slices(offsets):
        yield lo, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _name(batches: Iterator[pa.RecordBatch], sample, bits: int) -> Iterator[pa.RecordBatch]:
    """The names of a task's samples, sorted, in a row for each 2 ** bits-th of them: those met once, and the others with their numbers."""
    held, n = [], 0

    def put_together() -> pa.RecordBatch:
        names, count = np.unique(np.concatenate(held), return_counts=True)
        out: dict[str, list] = {c: [] for c in ("bucket", "once", "more", "times")}
        edges = np.append(np.searchsorted(names, np.arange(1 << bits, dtype=np.uint64) << (LONG - np.uint64(bits))), len(names))
        for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if lo < hi:
                single = count[lo:hi] == 1
                for c, v in zip(out, (k, names[lo:hi][single].tobytes(), names[lo:hi][~single].tobytes(), count[lo:hi][~single].tobytes()), strict=True):
                    out[c].append(v)
        return pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=list(out))

    with np.errstate(over="ignore"):
        for batch in batches:
            for _, buf, offsets in text_slices(batch):
                held.append(sample(buf, offsets))
                n += len(held[-1])
                if n > HELD_NAMES:
                    yield put_together()
                    held, n = [], 0
    if held:
        yield put_together()


def _shared(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Of a partition's names, sorted, those met more than once, and those met more than `hot` times."""
    held: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for k, c in enumerate(("once", "more", "times")):
            held[k].append(tb.text_bytes(batch.column(c))[0].copy().view(np.int64 if c == "times" else np.uint64))
    if not held[0]:
        return
    once, more, times = map(np.concatenate, held)
    names = np.sort(np.concatenate((once, more)))
    begin = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
    names, count = names[begin], np.diff(np.append(begin, len(names)))
    np.add.at(count, np.searchsorted(names, more), times - 1)
    own = names[count > 1]
    yield pa.record_batch([pa.array([own.tobytes()], pa.binary()), pa.array([len(own)]), pa.array([names[count > hot].view(np.int64)], pa.list_(pa.int64()))], names=["names", "n", "hot"])


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of 2 ** 16 of 2 ** bits bits, where each name sets the bit of its leading ones."""
    for batch in batches:
        names = tb.text_bytes(batch.column("names"))[0].copy().view(np.uint64)
        at = np.unique(names >> (LONG - np.uint64(bits))).astype(np.int64)
        blocks, begin = np.unique(at >> 16, return_index=True)
        out = []
        for own in np.split(at & 0xFFFF, begin[1:]) if len(blocks) else []:
            on = np.zeros(1 << 16, bool)
            on[own] = True
            out.append(np.packbits(on, bitorder="little").tobytes())
        yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], names=["block", "on"])


def common_names(texts: DataFrame, sample, hot: int = HOT) -> tuple[np.ndarray, int, DataFrame]:
    """A table of bits that has those of all names met more than once, the power of two that is its size, and the names (name) met more than `hot` times.

    `sample` gives the names of a slice of texts (bytes, and where each text begins and ends).
    """
    spark = texts.sparkSession
    bits = max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    dealt = texts.mapInArrow(partial(_name, sample=sample, bits=bits), "bucket int, once binary, more binary, times binary").repartition("bucket")
    shared = materialize(dealt.mapInArrow(partial(_shared, hot=hot), "names binary, n long, hot array<long>"), "names")
    n = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    size = min(MOST_BITS, max(16, (32 * n).bit_length()))
    table_ = np.zeros(1 << (size - 3), np.uint8)
    for row in shared.select("names").mapInArrow(partial(_bits, bits=size), "block long, on binary").toLocalIterator():
        table_[row["block"] << 13 : (row["block"] + 1) << 13] |= np.frombuffer(row["on"], np.uint8)
    return table_, size, shared.select(F.explode("hot").alias("name"))


def known(names: np.ndarray, table_: np.ndarray, size: int) -> np.ndarray:
    at = (names >> (LONG - np.uint64(size))).astype(np.int64)
    return (table_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
