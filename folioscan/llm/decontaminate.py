"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, lower-cased. Every `SEED` consecutive tokens of a benchmark item are a seed;
documents are matched against the seeds where they are read, by rolling hashes, so no document is shuffled. For each
document and item that share a seed, runs of seeds on one diagonal are the maximal matches; the longest is marked
first, a match that runs into marked tokens is cut to what is still free, and matches below `SEED` tokens are left. The
tiles cover an item whatever the order of its parts. A document holds an item when at least `COVERED` of the item's
tokens are covered.

The benchmark is the query set. It goes to the tasks in blocks of at most `BLOCK` bytes of text, so what is broadcast
is bounded and a larger benchmark takes more passes; every block meets all documents.

Defined cases: null and empty texts of either side match nothing; an item of fewer than `SEED` tokens matches nothing;
repeated documents are judged one by one, and repeated items are items of their own; null ids are passed through;
matches of equal length are marked in order of the item's and then the document's place; empty tables give no matches;
other columns are not read, or pass through `clean`.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import textbytes as tb
from folioscan.session import table

SEED = 5
COVERED = 0.5
BLOCK = 8 << 20

_NO_TOKEN = np.ones(256, bool)
_NO_TOKEN[48:58] = _NO_TOKEN[65:91] = _NO_TOKEN[97:123] = _NO_TOKEN[128:] = False


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each token."""
    starts, ends, rows = tb.word_spans(buf, offsets, _NO_TOKEN)
    return tb.span_hashes(buf, starts, ends), rows, starts, ends


def tiles(pairs: list[tuple[int, int]], shortest: int = SEED) -> list[tuple[int, int, int]]:
    """(item place, document place, length) of the greedy tiles; pairs are the places of shared seeds."""
    diagonals: dict[int, list[int]] = defaultdict(list)
    for i, j in pairs:
        diagonals[j - i].append(i)
    heap: list[tuple[int, int, int]] = []
    for d, own in diagonals.items():
        own.sort()
        begin = last = own[0]
        for i in own[1:] + [None]:
            if i is None or i > last + 1:
                heap.append((-(last - begin + shortest), begin, begin + d))
                begin = i
            last = i
    heapq.heapify(heap)
    left: set[int] = set()
    right: set[int] = set()
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [i + t not in left and j + t not in right for t in range(-n)]
        if all(free):
            out.append((i, j, -n))
            left.update(range(i, i - n))
            right.update(range(j, j - n))
            continue
        begin = None
        for t, ok in enumerate([*free, False]):
            if ok and begin is None:
                begin = t
            elif not ok and begin is not None:
                if t - begin >= shortest:
                    heapq.heappush(heap, (begin - t, i + begin, j + begin))
                begin = None
    return sorted(out)


class Block:
    """The seeds of some benchmark items."""

    def __init__(self, ids: list[int | None], texts: list[str | None]) -> None:
        with np.errstate(over="ignore"):
            lowered = pc.utf8_lower(pa.array(texts, pa.large_string()))
            hashes, rows, _, _ = tokens(*tb.text_bytes(lowered))
            seeds, first = tb.shingle_hashes(hashes, rows, SEED)
        self.ids, self.size = ids, np.bincount(rows, minlength=len(ids))
        begin = np.concatenate(([0], np.cumsum(self.size)))
        order = np.argsort(seeds, kind="stable")
        self.item, self.place = rows[first][order], (first - begin[rows[first]])[order]
        self.seeds, self.at = np.unique(seeds[order], return_index=True)
        self.at = np.append(self.at, len(seeds))
        self.hit = np.zeros(1 << 22, bool)
        self.hit[(self.seeds & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]], list[tuple[int, int]]]]:
        """Row, item, covered tokens, tiles and the tiles' byte spans in the lower-cased text, for each row and item that share a seed."""
        if not len(self.seeds):
            return
        buf, offsets = tb.text_bytes(pc.utf8_lower(column))
        for lo, hi in tb.slices(offsets):
            own, at = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            with np.errstate(over="ignore"):
                hashes, rows, starts, ends = tokens(own, at)
                seeds, first = tb.shingle_hashes(hashes, rows, SEED)
            maybe = np.flatnonzero(self.hit[(seeds & np.uint64((1 << 22) - 1)).astype(np.int64)])
            where = np.minimum(np.searchsorted(self.seeds, seeds[maybe]), len(self.seeds) - 1)
            true = self.seeds[where] == seeds[maybe]
            found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for seed, word in zip(where[true].tolist(), first[maybe[true]].tolist(), strict=True):
                row = int(rows[word])
                for x in range(self.at[seed], self.at[seed + 1]):
                    found[row, int(self.item[x])].append((int(self.place[x]), word))
            for (row, item), pairs in found.items():
                own_tiles = tiles(pairs)
                spans = [(int(starts[j] - at[row]), int(ends[j + n - 1] - at[row])) for _, j, n in own_tiles]
                yield lo + row, item, sum(n for _, _, n in own_tiles), own_tiles, spans


def _blocks(benchmark: DataFrame) -> Iterator[Block]:
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len((row["text"] or "").encode())
        if size >= BLOCK:
            yield Block(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts)


OUT = "doc_id long, item_id long, n_item_tokens long, n_covered long, n_tiles long, longest long, coverage double, spans array<struct<begin: long, end: long>>"


def contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """A row for each document and item that the document holds; spans are the tiles' bytes in the lower-cased text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], OUT)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                rows = []
                for row, item, n, tiled, spans in own.matches(batch.column(1)):
                    if n >= covered * own.size[item]:
                        rows.append((batch.column(0)[row].as_py(), own.ids[item], int(own.size[item]), n, len(tiled), max(t[2] for t in tiled), n / int(own.size[item]), [{"begin": a, "end": b} for a, b in spans]))
                if rows:
                    names = [x.split(" ")[0] for x in OUT.split(", ")[:7]] + ["spans"]
                    kinds = [pa.int64()] * 6 + [pa.float64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        out = out.unionByName(texts.mapInArrow(match, OUT))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """The rows of docs that hold no item. Each row is judged where it is read; nothing is shuffled."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                kept = np.ones(batch.num_rows, bool)
                for row, item, n, _, _ in own.matches(batch.column(at)):
                    if n >= covered * own.size[item]:
                        kept[row] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item_tokens", "n_covered", "n_tiles", "longest", "coverage")
