"""Token ids as Arrow stream files of fixed-size-list batches.

A file holds a run of documents, ids end to end, cut into sequences of one length; the last sequence is filled up with
0 and its mask is false there. Every batch but the last has the same number of sequences and so the same size in bytes:
batch k begins at `first + k * step`, sequence i lies in batch i // rows, and a reader maps or reads just that batch,
without a copy of its values.

`write` puts whole texts into such files in ascending doc_id order (ties by text, null ids first). Each task writes a
file under a name of its own attempt and returns its index rows, so a retried or doubled task leaves at most a file
that no index row names. Files are as large as shuffle partitions of the texts.

Defined cases: a null or empty text is the end id alone; repeated rows are documents of their own; an empty table
writes no file and has an empty index; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.llm import textbytes as tb
from folioscan.llm.tokens import VOCABULARY, Pieces
from folioscan.session import materialize, shared_dir, table

LENGTH = 2048
ROWS = 256
END_ID = 1
INDEX = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("k", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("n_tokens", pa.int64())])


class TokenFileWriter:
    def __init__(self, uri: str, length: int = LENGTH, rows: int = ROWS, kind: pa.DataType | None = None) -> None:
        self.length, self.rows, self.kind, self.n = length, rows, kind or pa.uint16(), 0
        self.schema = pa.schema(
            [pa.field("ids", pa.list_(pa.field("id", self.kind, False), length), False), pa.field("mask", pa.list_(pa.field("real", pa.bool_(), False), length), False)],
            {"length": str(length), "rows": str(rows)},
        )
        store, path = pafs.FileSystem.from_uri(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.sink = store.open_output_stream(path)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.rest = np.zeros(0, self.kind.to_pandas_dtype())

    def append(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.rest = np.concatenate((self.rest, ids.astype(self.rest.dtype)))
        step = self.length * self.rows
        full = len(self.rest) // step * step
        for lo in range(0, full, step):
            self._batch(self.rest[lo : lo + step], step)
        self.rest = self.rest[full:].copy()

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), type=self.schema.field(k).type) for k, (x, t) in enumerate(((ids, self.kind), (mask, pa.bool_())))]
        self.stream.write_batch(pa.record_batch(arrays, schema=self.schema))

    def close(self) -> None:
        if real := len(self.rest):
            padded = np.zeros(-(-real // self.length) * self.length, self.rest.dtype)
            padded[:real] = self.rest
            self._batch(padded, real)
        self.stream.close()
        self.sink.close()


class TokenFile:
    """Random access to the sequences of a file; local files are mapped."""

    def __init__(self, uri: str) -> None:
        store, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path)
        self.size = self.source.size()
        self.schema = pa.ipc.read_schema(self.source)
        self.first = self.source.tell()
        self.length, self.rows = (int(self.schema.metadata[k]) for k in (b"length", b"rows"))
        pa.ipc.read_message(self.source)
        self.step = self.source.tell() - self.first
        self._last: tuple[int, pa.RecordBatch] | None = None

    def batch(self, k: int) -> pa.RecordBatch:
        if self._last is None or self._last[0] != k:
            at = self.first + k * self.step
            data = self.source.read_at(min(self.step, self.size - at), at)
            self._last = k, pa.ipc.read_record_batch(pa.ipc.read_message(data), self.schema)
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids of sequence i and its mask, both without a copy: an array over the file's numbers, and one over its bits."""
        ids, mask = (c.slice(i % self.rows, 1).flatten() for c in self.batch(i // self.rows).columns)
        return ids.to_numpy(), mask

    def span(self, at: int, n: int) -> np.ndarray:
        """n ids from position at of the file."""
        step, out = self.length * self.rows, []
        while n > 0:
            ids = self.batch(at // step).column(0).flatten().to_numpy()[at % step : at % step + n]
            out.append(ids)
            at, n = at + len(ids), n - len(ids)
            if not len(ids):
                raise ValueError("the span passes the end of the file")
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def _written(folder: str, vocabulary: str, length: int, rows: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own, out, uri, k = Pieces.of(vocabulary), None, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrows", 0
        kind = pa.uint16() if own.tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or TokenFileWriter(uri, length, rows, kind)
            buf, offsets = tb.text_bytes(batch.column(1))
            for lo, hi in tb.slices(offsets, 8 * tb.SLICE):
                ids, n = own.encoded(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ends = np.cumsum(n)
                at, n = out.n + ends - n + np.arange(hi - lo), n + 1
                out.append(np.insert(ids, ends, END_ID))
                same = hi - lo
                yield pa.record_batch([batch.column(0).slice(lo, same), pa.array(np.full(same, part, np.int32)), pa.array(np.arange(k, k + same)), pa.array([uri] * same, pa.string()), pa.array(at), pa.array(n)], schema=INDEX)
                k += same
        if out:
            out.close()

    return write


def write(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Write the ids of docs, and return the index: doc_id, start (ids of all documents before it), n_tokens, file, at (ids before it in its file)."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/folioscan/tokens-{uuid.uuid4().hex}"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = materialize(texts.mapInArrow(_written(folder, vocabulary, length, rows), "doc_id long, part int, k long, file string, at long, n_tokens long"), "token-index")
    # one row for each file
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = files.select(F.col("file").alias("_file"), before.alias("_base"))
    return index.join(base, F.col("file") == F.col("_file")).select("doc_id", (F.col("_base") + F.col("at")).alias("start"), "n_tokens", "file", "at")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, file = None, None
    for batch in batches:
        sums = []
        for uri, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens")), strict=True):
            if uri != name:
                name, file = uri, TokenFile(uri)
            sums.append(zlib.crc32(file.span(at, n).astype("<u4").tobytes()))
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64()), *(batch.column(c) for c in ("file", "at"))], names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "at"])


def checksums(index: DataFrame) -> DataFrame:
    """The index with ids_crc32, the unsigned CRC-32 of the ids as they are read back from the files."""
    ordered = index.repartition("file").sortWithinPartitions("file", "at")
    return ordered.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, at long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksums(write(table(spark, sf_dir, "documents"))).select("doc_id", "start", "n_tokens", "ids_crc32")
