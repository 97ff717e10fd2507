"""Exact substring dedup by a difference cover: removes each byte covered by a string of `LENGTH` bytes that also starts earlier.

Sample. Places of a text are sampled by a difference cover of period `PERIOD`: for any two places there is an offset
below the period at which both are sampled. Each sample is the string of `GRAM` = LENGTH - PERIOD + 1 bytes from there, so two
equal windows of LENGTH bytes have an equal sample at the same offset. Samples get names, which are dealt out by their
leading bits and sorted; a name met once belongs to no window that repeats.

Recurse. Samples whose names are met once go. The others are named again, by all `WIDTH` bytes that the windows with
the sample in their first PERIOD places reach over; where such a longer name, its bytes compared, was met before, all
these windows repeat, which settles the sample.

Merge. What is left of a name is sorted by the bytes from the sample on, which gives the order of the sampled suffixes,
and by the bytes before it. Byte by byte comparison of neighbours in both orders gives their common prefixes. A window
that begins d bytes before its sample is a remaining suffix: d bytes, and then the sampled suffix up to LENGTH - d
bytes; windows that agree in both classes are equal, and all but the first of them repeat. No window is ever found equal
by a hash alone here: names only bring together what is then compared. As no more than LENGTH bytes decide, one level of
recursion is enough, and no order beyond it is needed.

Names met more than once are known to the second pass over the texts as a table of bits of bounded size; where it says
yes to a name met once, the merge finds no partner. Names met more than `HOT` times are compared a window a row
instead, by 128-bit hashes with minima combined before the shuffle, so that no task gets them whole.

Whole texts that are copies of an earlier one repeat from end to end and take no part beyond that.

Defined cases: a null text counts as empty; texts below LENGTH bytes keep all bytes; "earlier" is a smaller doc_id, or
the same document and an earlier start, with null ids first; rows of one id with different texts are documents of their
own, in the order of a digest; rows that repeat both doc_id and text are one document and each get its result; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import textbytes as tb
from folioscan.llm.common import common_names, known, text_slices
from folioscan.session import bounded, materialize, table

LENGTH = 100
#: A perfect difference cover: every difference modulo PERIOD is one of two of COVER.
PERIOD, COVER = 57, (0, 1, 6, 15, 22, 26, 45, 55)
#: Bytes of a sample, bytes before it that its windows reach over, and all bytes that they reach over.
GRAM, BEFORE, WIDTH = LENGTH - PERIOD + 1, PERIOD - 1, LENGTH + PERIOD - 1
#: Names met more often are compared a window a row; others are whole groups of so many rows at most.
HOT = 20_000
#: Rows that are compared together, unless one name has more; rows that a task holds before it passes them on.
CHUNK, HELD_ROWS = 30_000, 60_000
#: Bytes that are broadcast to join them to texts; beyond it that join shuffles the texts.
BROADCAST_BYTES = 64 << 20


def _hashes_at(buf: np.ndarray, at: np.ndarray | slice, n: int, which: int = 0) -> np.ndarray:
    """A hash of the n bytes from each place."""
    base = tb._BASES[which]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(tb._VALUES[which][buf] * tb._powers(base, len(buf)), out=total[1:])
    return tb.mix((total[n:][at] - total[: len(total) - n][at]) * tb._powers(pow(base, -1, 1 << 64), len(buf) + 1)[: len(total) - n][at])


def samples(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, row and place in buf of each sample, in the order of places."""
    size = np.diff(offsets)
    every = np.arange(-(-int(size.max(initial=0)) // PERIOD) * PERIOD).reshape(-1, PERIOD)[:, COVER].reshape(-1)
    count = np.searchsorted(every, np.where(size >= LENGTH, size - GRAM + 1, 0))
    rows = np.repeat(np.arange(len(size)), count)
    q = offsets[:-1][rows] + every[np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)]
    return (_hashes_at(buf, q, GRAM) if len(q) else np.zeros(0, np.uint64)), rows, q


def sample_names(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return samples(buf, offsets)[0]


def reach(own: np.ndarray, rows: np.ndarray, q: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the samples `own` those with windows, and how far before the sample they begin, at least and at most."""
    begin, end = offsets[rows[own]], offsets[rows[own] + 1]
    nearest, farthest = np.maximum(q[own] + LENGTH - end, 0), np.minimum(q[own] - begin, BEFORE)
    some = nearest <= farthest
    return own[some], nearest[some], farthest[some]


def _content(buf: np.ndarray, offsets: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The WIDTH bytes around each sample; 0 beyond the ends of its text."""
    padded = np.concatenate((np.zeros(BEFORE, np.uint8), buf, np.zeros(LENGTH, np.uint8)))
    out = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[q]
    left, right = BEFORE - (q - offsets[rows]), BEFORE + offsets[rows + 1] - q
    cut = np.flatnonzero((left > 0) | (right < WIDTH))
    at = np.arange(WIDTH)
    out[cut] *= (at >= left[cut, None]) & (at < right[cut, None])
    return out


def _longer_names(content: np.ndarray) -> np.ndarray:
    h = np.zeros(len(content), np.uint64)
    words = np.zeros((len(content), -(-WIDTH // 8) * 8), np.uint8)
    words[:, :WIDTH] = content
    for w in words.view(np.uint64).T:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return tb.mix(h)


def _settled(content: np.ndarray, ranges: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first with their WIDTH bytes and range of windows, and rows that another one comes before. Places are told apart by rank."""
    key = tb.mix(_longer_names(content) + ranges.astype(np.uint64))
    order = np.lexsort((rank, key))
    begin = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    first = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
    same = (content[order] == content[first]).all(axis=1) & (ranges[order] == ranges[first])
    return order[~same | (order == first)], order[same & (rank[order] > rank[first])]


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, ascending, with those that meet or overlap as one. Documents are numbers from 0."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    step = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(doc * step + end) if len(doc) else end
    fresh = np.flatnonzero(np.concatenate(([True], (doc * step + begin)[1:] > reach[:-1]))) if len(doc) else doc
    return doc[fresh], begin[fresh], (reach - doc * step)[np.append(fresh[1:], len(doc)) - 1] if len(doc) else end


SPANS = "doc_id long, digest long, begins array<long>, ends array<long>"
ROWS = "name long, doc_id long, digest long, at long, nearest int, farthest int, content binary, begins array<long>, ends array<long>"


def _spans(ids: pa.Array, digests: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """doc_id, digest, begins and ends: a row for each document of spans given one by one."""
    _, at, doc = np.unique(_ranks(ids, digests, np.zeros(len(digests), np.int64)), return_index=True, return_inverse=True)
    doc, begin, end = _merged(doc, begin, end)
    cut = pa.array(np.searchsorted(doc, np.arange(len(at) + 1)).astype(np.int32))
    return [ids.take(pa.array(at)), pa.array(digests[at]), pa.ListArray.from_arrays(cut, pa.array(begin)), pa.ListArray.from_arrays(cut, pa.array(end))]


def _ranks(ids: pa.Array, digests: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of places: by doc_id with nulls first, digest, and place; equal for the same place of repeated rows."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    keys = (at, digests, ids.fill_null(0).to_numpy(zero_copy_only=False), ~null)
    order = np.lexsort(keys)
    fresh = np.zeros(len(at), bool)
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _windows(shared, hot):
    """Samples whose names are common, and the bytes around them; those settled in the task itself are spans already."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names_ = [x.split(" ")[0] for x in ROWS.split(", ")]
        lists = pa.list_(pa.int64())

        def put_together() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[1] for x in held])
            name, digest, at, nearest, farthest, content = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3, 4, 5, 6))
            first, later = _settled(content, nearest * 64 + farthest, _ranks(ids, digest, at))
            spans = _spans(ids.take(pa.array(later)), digest[later], at[later] - farthest[later], at[later] - nearest[later] + LENGTH)
            n, m = len(first), len(spans[0])
            offsets = pa.py_buffer((np.arange(n + 1) * WIDTH).astype(np.int32))
            left = [pa.array(name[first].view(np.int64)), ids.take(pa.array(first)), *(pa.array(x[first]) for x in (digest, at)), *(pa.array(x[first].astype(np.int32)) for x in (nearest, farthest))]
            left += [pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(content[first])]), pa.nulls(n, lists), pa.nulls(n, lists)]
            # spans are dealt out by their documents
            right = [pa.array(tb.mix(spans[1].to_numpy().view(np.uint64)).view(np.int64)), *spans[:2], pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.int32())] * 2, pa.nulls(m, pa.binary()), *spans[2:]]
            return pa.record_batch([pa.concat_arrays(x) for x in zip(left, right, strict=True)], names=names_)

        table_, size = shared.value
        skipped = hot.value
        with np.errstate(over="ignore"):
            for batch in batches:
                digests = batch.column("digest").to_numpy()
                for lo, buf, offsets in text_slices(batch):
                    name, rows, q = samples(buf, offsets)
                    own, nearest, farthest = reach(np.flatnonzero(known(name, table_, size)), rows, q, offsets)
                    if len(skipped):
                        usual = skipped[np.minimum(np.searchsorted(skipped, name[own]), len(skipped) - 1)] != name[own]
                        own, nearest, farthest = own[usual], nearest[usual], farthest[usual]
                    if len(own):
                        name, rows, q = name[own], rows[own], q[own]
                        held.append((name, batch.column("doc_id").take(pa.array(rows + lo)), digests[rows + lo], q - offsets[rows], nearest, farthest, _content(buf, offsets, rows, q)))
                    if sum(len(x[0]) for x in held) > HELD_ROWS:
                        yield put_together()
                        held = []
            if held:
                yield put_together()

    return find


def _hot_windows(shared, hot):
    """A row for each window of the samples whose names are hot: two hashes of it and its place."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, size = shared.value
        wanted = hot.value
        with np.errstate(over="ignore"):
            for batch in batches:
                digests = batch.column("digest").to_numpy()
                for lo, buf, offsets in text_slices(batch):
                    name, rows, q = samples(buf, offsets)
                    own, nearest, farthest = reach(np.flatnonzero(known(name, table_, size)), rows, q, offsets)
                    mine = wanted[np.minimum(np.searchsorted(wanted, name[own]), len(wanted) - 1)] == name[own]
                    own, n, first = own[mine], (farthest - nearest + 1)[mine], (q[own] - farthest)[mine]
                    place = np.unique(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                    if len(place):
                        row = np.searchsorted(offsets, place, "right") - 1
                        hashes = [pa.array(_hashes_at(buf, place, LENGTH, k).view(np.int64)) for k in (0, 1)]
                        yield pa.record_batch([*hashes, batch.column("doc_id").take(pa.array(row + lo)), pa.array(digests[row + lo]), pa.array(place - offsets[row])], names=["h", "i", "doc_id", "digest", "at"])

    return find


def _prefixes(x: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by name and bytes, and the bytes that each has in common with the one before it; -1 where the name differs."""
    width = x.shape[1]
    words = np.zeros((len(x), -(-width // 8) * 8), np.uint8)
    words[:, :width] = x
    order = np.lexsort((*words.view(">u8").astype(np.uint64).T[::-1], name))
    alike = x[order][1:] == x[order][:-1]
    common = np.where(alike.all(axis=1), width, alike.argmin(axis=1))
    common[name[order][1:] != name[order][:-1]] = -1
    return order, np.concatenate(([-1], common))


def repeats(name: np.ndarray, content: np.ndarray, rank: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> np.ndarray:
    """For each row and number of bytes before the sample: whether the window from there is equal to one of a lower rank."""
    n = len(name)
    forward, ahead = _prefixes(content[:, BEFORE:], name)
    backward, behind = _prefixes(np.ascontiguousarray(content[:, :BEFORE][:, ::-1]), name)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    out = np.zeros((n, PERIOD), bool)
    for d in range(PERIOD):
        right[forward] = np.cumsum(ahead < LENGTH - d)
        left[backward] = np.cumsum(behind < d)
        own = np.flatnonzero((nearest <= d) & (d <= farthest))
        if len(own) < 2:
            continue
        key = left[own] * (n + 1) + right[own]
        order = np.argsort(key)
        begin = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        lowest = np.minimum.reduceat(rank[own][order], begin)
        out[own[order], d] = rank[own][order] != np.repeat(lowest, np.diff(np.append(begin, len(order))))
    return out


def _compare(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows come by name; names are compared whole, many at a time."""
    held: list[pa.RecordBatch] = []
    names = [x.split(" ")[0] for x in SPANS.split(", ")]

    def done(whole: pa.Table) -> pa.RecordBatch:
        column = lambda c: whole.column(c).combine_chunks()
        ids = column("doc_id")
        name, digest, at, nearest, farthest = (column(c).to_numpy() for c in ("name", "digest", "at", "nearest", "farthest"))
        content = tb.text_bytes(column("content"))[0].reshape(len(name), WIDTH)
        rank = _ranks(ids, digest, at)
        first, later = _settled(content, nearest * 64 + farthest, rank)
        found = [(later, at[later] - farthest[later], at[later] - nearest[later] + LENGTH)]
        # what is left of names with more than one row
        _, which, count = np.unique(name[first], return_inverse=True, return_counts=True)
        own = first[count[which] > 1]
        if len(own):
            on = np.zeros((len(own), PERIOD + 2), bool)
            on[:, 1:-1] = repeats(name[own], content[own], rank[own], nearest[own], farthest[own])
            row, begin = np.nonzero(on[:, 1:] & ~on[:, :-1])
            end = np.nonzero(on[:, :-1] & ~on[:, 1:])[1]  # runs of d from begin to end - 1
            found.append((own[row], at[own[row]] - end + 1, at[own[row]] - begin + LENGTH))
        rows, begin, end = map(np.concatenate, zip(*found, strict=True))
        return pa.record_batch(_spans(ids.take(pa.array(rows)), digest[rows], begin, end), names=names)

    with np.errstate(over="ignore"):
        for batch in batches:
            sure = batch.filter(batch.column("content").is_null())
            if sure.num_rows:
                yield sure.select(names)
            batch = batch.filter(batch.column("content").is_valid())
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) >= chunk:
                whole = pa.Table.from_batches(held)
                last = whole.column("name").to_numpy()
                cut = int(np.searchsorted(last, last[-1]))
                if cut:
                    yield done(whole.slice(0, cut))
                    held = whole.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """doc_id, digest, begins and ends: bytes of each text (doc_id, digest, text) covered by a window that also starts earlier. Spans of several rows may overlap."""
    spark = texts.sparkSession
    table_, size, hot = common_names(texts, sample_names, HOT)
    hot = np.sort(hot.toArrow().column(0).to_numpy().view(np.uint64))
    shared, skipped = spark.sparkContext.broadcast((table_, size)), spark.sparkContext.broadcast(hot)
    rows = texts.mapInArrow(_windows(shared, skipped), ROWS).repartition("name").sortWithinPartitions("name")
    usual = rows.mapInArrow(partial(_compare, chunk=CHUNK), SPANS)
    if not len(hot):
        return usual
    single = materialize(texts.mapInArrow(_hot_windows(shared, skipped), "h long, i long, doc_id long, digest long, at long"), "hot-windows")
    place = F.struct("doc_id", "digest", "at")
    first = single.groupBy("h", "i").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("h", "i", "first")
    later = single.join(first, ["h", "i"]).where(place != F.col("first"))
    return usual.unionByName(later.select("doc_id", "digest", F.array("at").alias("begins"), F.array(F.col("at") + LENGTH).alias("ends")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each row's lists as one list of each."""
    for batch in batches:
        sides = []
        for c in ("begins", "ends"):
            outer = batch.column(c)
            inner = outer.flatten()
            at = np.concatenate(([0], np.cumsum(inner.value_lengths().fill_null(0).to_numpy())))
            sides.append((inner.flatten().to_numpy(), at[np.concatenate(([0], np.cumsum(outer.value_lengths().to_numpy())))]))
        (begin, at), (end, _) = sides
        doc, begin, end = _merged(np.repeat(np.arange(batch.num_rows), np.diff(at)), begin, end)
        cut = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
        yield pa.record_batch([batch.column("doc_id"), batch.column("digest"), pa.ListArray.from_arrays(cut, pa.array(begin)), pa.ListArray.from_arrays(cut, pa.array(end))], names=["doc_id", "digest", "begins", "ends"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = tb.text_bytes(batch.column("text"))
        found = {c: [] for c in ("n_removed", "n_spans", "kept_sha256", "begins", "ends")}
        for k, (begins, ends, copy) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("begins", "ends", "copy")), strict=True)):
            own = buf[offsets[k] : offsets[k + 1]]
            if copy and len(own) >= LENGTH:
                begins, ends = [0], [len(own)]
            begins, ends = begins or [], ends or []
            digest, at = hashlib.sha256(), 0
            for a, b in zip(begins, ends, strict=True):
                digest.update(own[at:a])
                at = b
            digest.update(own[at:])
            for c, v in zip(found, (sum(ends) - sum(begins), len(begins), digest.hexdigest(), begins, ends), strict=True):
                found[c].append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offsets)), *(pa.array(v, t) for v, t in zip(found.values(), kinds, strict=True))], names=["doc_id", "n_bytes", *found])


def _same_document(right: DataFrame) -> Column:
    return F.col("doc_id").eqNullSafe(right["_id"]) & (F.col("digest") == right["_digest"])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and begins and ends of the removed runs of bytes, for each row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    digests = texts.where(F.octet_length("text") >= LENGTH).select("doc_id", "digest", F.unhex(F.sha2("text", 256)).alias("whole"))
    firsts = digests.groupBy("whole").agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count("*").alias("n")).where("n > 1")
    # a row of the first document's own id is no copy, and neither is one without an id
    copies = digests.join(firsts, "whole").where(F.col("doc_id").isNotNull() & ((F.col("nulls") > 0) | (F.col("doc_id") > F.col("first"))))
    copies = materialize(copies.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.lit(True).alias("copy")).distinct(), "copies")
    copies = bounded(copies, copies.count() * 32, BROADCAST_BYTES)
    spans = repeated_spans(texts.join(copies, _same_document(copies), "left_anti"))
    listed = spans.groupBy("doc_id", "digest").agg(F.collect_list("begins").alias("begins"), F.collect_list("ends").alias("ends"))
    listed = materialize(listed.mapInArrow(_joined, SPANS).withColumnsRenamed({"doc_id": "_id", "digest": "_digest"}), "spans")
    size = listed.agg(F.coalesce(F.sum(F.size("begins") * 16 + 64), F.lit(0)).alias("n")).first()["n"]
    listed = bounded(listed, size, BROADCAST_BYTES)
    marked = texts.join(copies, _same_document(copies), "left").select("doc_id", "digest", "text", "copy")
    marked = marked.join(listed, _same_document(listed), "left").select("doc_id", "text", "copy", "begins", "ends")
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, begins array<long>, ends array<long>"
    return marked.mapInArrow(_kept, shape)


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents")).drop("begins", "ends")
