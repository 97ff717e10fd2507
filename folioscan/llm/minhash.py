"""MinHash near-duplicates by tensored banding.

A text's set holds its distinct shingles of `SHINGLE` words. Two collections of `HALVES` half keys, each of `ROWS`
minhashes, give HALVES * HALVES table keys by pairing every half key of the first with every one of the second: 2 *
HALVES * ROWS minhashes do the work of HALVES ** 2 * 2 * ROWS. At a similarity of 0.75, two sets share a table but for
10 cases in 10,000, at 0.8 but for 6 in 100,000; of sets with a similarity of 0.3 one pair in ten shares one, of 0.2 one
in a hundred. Texts with equal sets are one class from the start, so copies are never paired.

Links are confirmed on whole sets. In each table the class with most company in all its tables is paired with each of
the others, which finds most links at a cost in proportion to the tables. Classes that share tables, directly or by
others, form a cluster. Where a cluster holds more than one component, every class outside its largest component is
compared with all classes of the cluster of a fitting size, block of sets against block of sets, and only links come
out: so no pair that shares a table is lost, and no pair becomes a row before it is known to be a link.

Defined cases: a null, empty or wordless text has an empty set and is a component of its own; a text of fewer words
than `SHINGLE` has its whole sequence as its one shingle; ties go to the smaller doc_id; rows that repeat a doc_id and
text share a class and are all returned; a null doc_id takes part, and never names a component unless all of its
component's ids are null; rows of one id with different texts are documents of their own, told apart by a digest; an
empty table gives an empty result; other columns are not read, or pass through `first_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import textbytes as tb
from folioscan.llm.components import connected, joined
from folioscan.session import bounded, materialize, small_batches, table

SHINGLE = 5
SIMILAR = (75, 100)
HALVES, ROWS = 14, 3
#: Bytes of ids that are broadcast to pick out texts; beyond it that join shuffles.
BROADCAST_BYTES = 32 << 20
#: Shingles in a block of sets.
BLOCK = 400_000

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(1, 1 << 63, 2 * HALVES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(1, 1 << 63, 2 * HALVES * ROWS, dtype=np.uint64)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending within it, and where each text's begin."""
    starts, ends, rows = tb.word_spans(buf, offsets)
    n = len(offsets) - 1
    words = tb.span_hashes(buf, starts, ends)
    h, first = tb.shingle_hashes(words, rows, k)
    owner = rows[first]
    count = np.bincount(rows, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = np.concatenate(([0], np.cumsum(count)))
        extra = []
        for r in short:
            x = np.uint64(len(words[at[r] : at[r + 1]]))
            for w in words[at[r] : at[r + 1]]:
                x = tb.mix(np.array([x * np.uint64(0x9E3779B97F4A7C15) + w]))[0]
            extra.append(x)
        h, owner = np.concatenate((h, np.array(extra, np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
        h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(n + 1))


def half_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """2 * HALVES half keys for each text with a set that isn't empty."""
    minima = np.stack([np.minimum.reduceat(h * f + a, at) for f, a in zip(_FACTORS, _ADDENDS, strict=True)], axis=1)
    keys = np.zeros((len(at), 2 * HALVES), np.uint64)
    for r in range(ROWS):
        keys = tb.mix(keys * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
    return keys


SIGNATURE = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("halves", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            buf, offsets = tb.text_bytes(batch.column("text"))
            for lo, hi in tb.slices(offsets):
                own = offsets[lo : hi + 1]
                h, at = shingle_sets(tb.LOWER[buf[own[0] : own[-1]]], own - own[0], SHINGLE)
                size = np.diff(at)
                full = np.flatnonzero(size)
                a, b = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                keys = np.zeros((0, 2 * HALVES), np.uint64)
                if len(full):
                    a[full] = np.add.reduceat(tb.mix(h ^ np.uint64(0xA5A5)), at[full])
                    b[full] = np.add.reduceat(tb.mix(h + np.uint64(0x5A5A5A)), at[full])
                    keys = half_keys(h, at[full])
                ends = np.concatenate(([0], np.cumsum((size > 0) * 2 * HALVES))).astype(np.int32)
                halves = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), halves], schema=SIGNATURE)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            buf, offsets = tb.text_bytes(batch.column("text"))
            for lo, hi in tb.slices(offsets):
                own = offsets[lo : hi + 1]
                h, at = shingle_sets(tb.LOWER[buf[own[0] : own[-1]]], own - own[0], SHINGLE)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], names=["node", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    of, among = SIMILAR
    return pairs.join(right, "b").join(left, "a").where(among * both >= of * (F.size("_x") + F.size("_y") - both)).select("a", "b")


def _fitting(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sizes allow enough similarity."""
    of, among = SIMILAR
    size = [classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"_{x}")) for x in "ab"]
    return pairs.join(size[0], "a").join(size[1], "b").where(among * F.least("_a", "_b") >= of * F.greatest("_a", "_b")).select("a", "b")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links between two blocks of sets."""
    of, among = SIMILAR
    for batch in batches:
        names = {c: batch.column(c) for c in ("un", "us", "vn", "vs")}
        for k in range(batch.num_rows):
            un, vn = (names[c][k].values.to_numpy() for c in ("un", "vn"))
            us, vs = (_parts(names[c][k].values) for c in ("us", "vs"))
            size = np.array([len(x) for x in vs])
            owner = np.repeat(np.arange(len(vs)), size)
            flat = np.concatenate(vs)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            a, b = [], []
            for node, x in zip(un, us, strict=True):
                lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                n = hi - lo
                both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(vs))
                alike = np.flatnonzero(among * both >= of * (len(x) + size - both))
                alike = alike[vn[alike] != node]
                a.append(np.full(len(alike), node))
                b.append(vn[alike])
            yield pa.record_batch([pa.array(np.concatenate(a).astype(np.int64)), pa.array(np.concatenate(b).astype(np.int64))], names=["a", "b"])


def _parts(lists: pa.ListArray) -> list[np.ndarray]:
    values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[at[k] : at[k + 1]] for k in range(len(lists))]


def _across(stars: DataFrame, components: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components of each cluster that holds more than one; at least one of each such pair of components that has any."""
    clusters = joined(components, stars).withColumnRenamed("label", "cluster")
    own = clusters.join(components, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = own.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("cluster", F.col("most.label").alias("main"))
    # bands of sizes: sets of enough similarity are in the same band or in the next
    of, among = SIMILAR
    band = F.floor(F.log(F.size("shingles").cast("double")) / F.lit(float(np.log(among / of)))).cast("int")
    rows = materialize(own.join(open_, "cluster").join(sets, "node").select("cluster", "node", "shingles", (F.col("label") != F.col("main")).alias("outside"), band.alias("band")), "open-clusters")

    def blocks(of_rows: DataFrame, node: str, shingles: str, number: str) -> DataFrame:
        count = of_rows.groupBy("cluster", "band").agg(F.ceil(F.sum(F.size("shingles")) / BLOCK).alias("_of"))
        dealt = of_rows.join(count, ["cluster", "band"]).withColumn(number, F.pmod(F.xxhash64("node"), F.col("_of")))
        return dealt.groupBy("cluster", "band", number).agg(F.collect_list("node").alias(node), F.collect_list("shingles").alias(shingles))

    asking = blocks(rows.where("outside"), "un", "us", "u").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    pairs = asking.join(blocks(rows, "vn", "vs", "v"), ["cluster", "band"]).select("un", "us", "vn", "vs")
    return materialize(pairs.mapInArrow(_compare, "a long, b long"), "links-across")


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, digest and text: what tells documents apart, also where ids are null or repeated."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_shingles, component_id, kept and first for each row of docs; first: the component's first document, by doc_id (nulls last) and digest."""
    texts = _identified(docs)
    with small_batches(docs.sparkSession):
        signed = materialize(texts.mapInArrow(_sign, "doc_id long, digest long, n_shingles long, set_a long, set_b long, halves array<long>"), "signatures")
    full = signed.where("n_shingles > 0")
    identity = ["set_a", "set_b", "n_shingles"]
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    classes = full.groupBy(*identity).agg(F.min(own).alias("low"), F.first("halves").alias("halves"))
    # dealt out again, as every class becomes many rows
    classes = classes.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "set_a")
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keys = classes.select(
        "node",
        F.explode(F.expr(f"transform(sequence(0, {HALVES * HALVES - 1}), t -> xxhash64(t, halves[t DIV {HALVES}], halves[{HALVES} + t % {HALVES}]))")).alias("key"),
    )
    shared = keys.groupBy("key").agg(F.min("node").alias("_first"), F.max("node").alias("_last"), F.count("*").alias("n")).where("_first < _last").select("key", "n")
    members = materialize(keys.join(shared, "key"), "tables")
    # of classes with equal company the same one is the hub everywhere
    tie = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20)
    company = materialize(members.groupBy("node").agg(F.sum("n").alias("w")).withColumn("w", F.col("w") + tie), "company")
    hubs = members.join(company, "node").groupBy("key").agg(F.max_by("node", "w").alias("hub"))
    stars = materialize(members.join(hubs, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    picked = classes.join(company.select("node"), "node", "left_semi").select("node", F.col("low.doc_id").alias("_id"), F.col("low.digest").alias("_digest"))
    picked = bounded(picked, company.count() * 24, BROADCAST_BYTES)
    chosen = texts.join(picked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("node", "text")
    with small_batches(docs.sparkSession):
        sets = materialize(chosen.mapInArrow(_sets, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    links = materialize(_confirmed(_fitting(stars, classes), sets), "links")
    components = connected(links)
    labels = joined(components, _across(stars, components, sets))
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("low").alias("lowest"))
    known = named.join(lowest, "label").select(*[F.col(c).alias(f"_{c}") for c in identity], "lowest")
    first = F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("digest") == F.col("lowest.digest"))
    out = full.join(known, [F.col(c) == F.col(f"_{c}") for c in identity]).select("doc_id", "digest", "n_shingles", F.col("lowest.doc_id").alias("component_id"), first.alias("first"))
    alone = signed.where("n_shingles = 0").select("doc_id", "digest", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those of near-duplicates of an earlier document: one row of each component stays, of rows that repeat doc_id and text as well."""
    judged = materialize(near_duplicates(docs), "judged")
    gone = judged.where("NOT first").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    again = judged.where("first AND n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).count().where("count > 1").drop("count")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def of(side: DataFrame, label: str):
        side = materialize(side, label)
        n = side.count()
        same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("_digest"))
        return bounded(side, 16 * n, BROADCAST_BYTES), same, n

    gone, same, _ = of(gone, "gone")
    rows = rows.join(gone, same, "left_anti")
    again, same, n = of(again, "repeated-rows")
    if n:
        once = rows.join(again, same, "left_semi").withColumns({"_id": F.col("row.doc_id"), "_text": F.col("row.text")}).dropDuplicates(["_id", "_text"]).select("row")
        rows = rows.join(again, same, "left_anti").unionByName(once)
    return rows.select("row.*")


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
