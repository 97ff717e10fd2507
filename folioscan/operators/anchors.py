"""Where quoted passages stand in the items of documents.

Quotes are the query set. They go to the tasks in blocks of bounded size, and an Aho-Corasick automaton finds all quotes
of a block in one pass over each compact text; items and offsets then follow by joins on the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.sources.pages import text_items

#: Bytes of quotes in a block.
BLOCK = 4 << 20


def _blocks(quotes: DataFrame) -> Iterator[list[tuple[int, str]]]:
    own, size = [], 0
    for row in quotes.toLocalIterator():
        own.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK:
            yield own
            own, size = [], 0
    if own:
        yield own


def first_places(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id, at): the first place of each quote (item_id, quote) in each text (doc_id, haystack) that holds it. Empty quotes are nowhere."""
    spark = texts.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id long, at int")
    for block in _blocks(quotes.where("quote <> ''").select("item_id", "quote")):
        shared = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_quote: dict[str, list[int]] = {}
            for item, quote in shared.value:
                by_quote.setdefault(quote, []).append(item)
            automaton = ahocorasick.Automaton()
            for quote, items in by_quote.items():
                automaton.add_word(quote, (len(quote), items))
            automaton.make_automaton()
            for batch in batches:
                docs, items, places = [], [], []
                for doc, hay in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    first: dict[int, int] = {}
                    for end, (size, own) in automaton.iter(hay or ""):
                        for item in own:
                            first.setdefault(item, end - size + 1)
                    docs += [doc] * len(first)
                    items += first.keys()
                    places += first.values()
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(places, pa.int32())], names=["doc_id", "item_id", "at"])

        out = out.unionByName(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "haystack").mapInArrow(find, "doc_id long, item_id long, at int"))
    return out


def _of_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")


def exact(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, item_id, start_item, start_offset, end_item, end_offset (exclusive) of the first compact occurrence of each quote (item_id, text)."""
    wanted = quotes.select("item_id", T.compact(F.col("text")).alias("quote"))
    found = first_places(docs.select("doc_id", T.compact_chars(F.col("text")).alias("haystack")), wanted).join(wanted, "item_id")
    items = text_items(_of_found(docs, found)).select("doc_id", "item_index", "text", T.compact_chars(F.col("text")).alias("_c"))
    to = F.sum(F.length("_c")).over(Window.partitionBy("doc_id").orderBy("item_index").rowsBetween(Window.unboundedPreceding, 0))
    spans = items.withColumn("_to", to).withColumn("_from", F.col("_to") - F.length("_c")).where("_to > _from")
    last = F.col("at") + F.length("quote") - 1
    ends = found.select("doc_id", "item_id", F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("at").alias("place")), F.struct(F.lit("end").alias("side"), last.alias("place")))).alias("e")).select("doc_id", "item_id", "e.*")
    placed = ends.join(spans, "doc_id").where("place >= _from AND place < _to").withColumn("offset", T.offset_of(F.col("text"), F.col("place") - F.col("_from")))
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return placed.groupBy("doc_id", "item_id").agg(
        side("start", "item_index").alias("start_item"), side("start", "offset").alias("start_offset"), side("end", "item_index").alias("end_item"), (side("end", "offset") + 1).alias("end_offset")
    )


def normalized(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Anchors of whole items, from the items' normalized texts joined by spaces."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: T.normalize(x)), lambda x: x != "")
    wanted = quotes.select("item_id", T.normalize(F.col("text")).alias("quote"))
    found = first_places(docs.select("doc_id", F.array_join(lines, " ").alias("haystack")), wanted).join(wanted, "item_id")
    items = text_items(_of_found(docs, found)).select("doc_id", "item_index", "text", T.normalize(F.col("text")).alias("_n")).where("_n <> ''")
    to = F.sum(F.length("_n") + 1).over(Window.partitionBy("doc_id").orderBy("item_index").rowsBetween(Window.unboundedPreceding, 0)) - 1
    spans = items.withColumn("_to", to).withColumn("_from", F.col("_to") - F.length("_n"))
    hit = found.join(spans, "doc_id").where((F.col("_to") > F.col("at")) & (F.col("_from") < F.col("at") + F.length("quote")))
    return hit.groupBy("doc_id", "item_id").agg(
        F.min("item_index").alias("start_item"), F.lit(0).alias("start_offset"), F.max("item_index").alias("end_item"), F.max_by(F.length("text"), "item_index").alias("end_offset")
    )


def range_text(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, item_id, text of each anchor range; a line feed follows items that end a line, but for the last."""
    items = text_items(_of_found(docs, anchors)).select("doc_id", "item_index", "text", "has_eol")
    inside = anchors.join(items, "doc_id").where("item_index BETWEEN start_item AND end_item")
    a = F.when(F.col("item_index") == F.col("start_item"), F.col("start_offset")).otherwise(0)
    b = F.when(F.col("item_index") == F.col("end_item"), F.col("end_offset")).otherwise(F.length("text"))
    part = F.concat(F.substring("text", a + 1, F.greatest(b - a, F.lit(0))), F.when(F.col("has_eol") & (F.col("item_index") < F.col("end_item")), "\n").otherwise(""))
    parts = inside.groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("item_index", part.alias("part")))).alias("_p"))
    return parts.select("doc_id", "item_id", F.array_join(F.transform("_p", lambda x: x["part"]), "").alias("text"))


def scores(docs: DataFrame, anchors: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, item_id, score of each anchor's text against its quote."""
    wanted = quotes.select("item_id", T.compact(F.col("text")).alias("_quote"))
    actual = range_text(docs, anchors).select("doc_id", "item_id", T.compact(F.col("text")).alias("_actual"))
    return actual.join(wanted, "item_id").select("doc_id", "item_id", T.match_score(F.col("_actual"), F.col("_quote")).alias("score"))


SPAN, LEAST, ACCEPT = 180, 12, 0.72
KEEP, MARGIN = 0.92, 0.03


#: Cells of a matrix in a task, at most; single quotes or windows may take more.
CELLS = 4 << 20


def _grams(compact: str) -> np.ndarray:
    """The bigrams of a text of a-z and 0-9 as numbers."""
    codes = np.frombuffer(compact.encode("ascii"), np.uint8).astype(np.int64)
    codes = np.where(codes < 97, codes - 48, codes - 87)
    return codes[:-1] * 36 + codes[1:]


class _Quotes:
    """A few quotes as rows of zeros and ones, a column for the first, second, ... time a bigram occurs: the bigrams that two texts share, with repeats, are the product of their rows."""

    def __init__(self, own: list[tuple[int, str]]):
        self.items = [item for item, _ in own]
        self.sizes = np.array([len(quote) for _, quote in own])
        counted = [np.unique(_grams(quote), return_counts=True) for _, quote in own]
        levels = np.zeros(36 * 36, np.int64)
        for grams, counts in counted:
            levels[grams] = np.maximum(levels[grams], counts)
        first = np.cumsum(levels) - levels
        self.gram = np.repeat(np.arange(36 * 36), levels)
        self.level = np.arange(len(self.gram)) - first[self.gram] + 1
        self.rows = np.zeros((len(own), len(self.gram)), np.float32)
        for row, (grams, counts) in zip(self.rows, counted, strict=True):
            row[np.repeat(first[grams], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = 1

    def best(self, items: list[str]) -> list[tuple[int, int, int, float]]:
        """(item_id, first, last, score) of the window of items most like each quote, where that is like enough."""
        top, where = np.zeros(len(self.items)), np.zeros((len(self.items), 2), np.int64)
        longest, step = self.sizes.max() * 1.65 + 24, max(1, CELLS // max(len(self.gram), len(self.items)))
        for begin in range(0, len(items), SPAN):
            own = items[begin : begin + 2 * SPAN]
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            grams = _grams("".join(own))
            held = np.bincount(np.repeat(np.arange(len(own)), np.diff(at))[:-1] * 1296 + grams, minlength=len(own) * 1296).reshape(-1, 1296)
            upto = np.concatenate([np.zeros((1, 1296), np.int64), np.cumsum(held, axis=0)])
            # windows by their first and last item, in this order
            firsts = np.arange(min(SPAN, len(own)))
            ends = np.minimum(np.minimum(np.searchsorted(at, at[firsts] + longest, "right"), firsts + SPAN), len(own))
            first = np.repeat(firsts, ends - firsts)
            last = np.arange(len(first)) - np.repeat(np.cumsum(ends - firsts) - (ends - firsts), ends - firsts) + first
            for k in range(0, len(first), step):
                a, z = first[k : k + step], last[k : k + step]
                counts = upto[z + 1] - upto[a]
                cut = np.flatnonzero(z + 1 < len(own))  # the bigram that leads out of the window
                counts[cut, grams[at[z[cut] + 1] - 1]] -= 1
                common = (counts[:, self.gram] >= self.level).astype(np.float32) @ self.rows.T
                total, before = (at[z + 1] - at[a])[:, None], (at[z] - at[a])[:, None]
                score = 2.0 * common.astype(np.float64) / np.maximum(total + self.sizes - 2, 1)
                score[(before > self.sizes * 1.65 + 24) | (total < np.maximum(LEAST, self.sizes * 0.45))] = 0.0
                at_best = score.argmax(axis=0)
                value = score[at_best, np.arange(len(self.items))]
                better = value > top
                top[better], where[better] = value[better], np.stack([a[at_best], z[at_best]], axis=1)[better] + begin
        return [(self.items[i], int(where[i, 0]), int(where[i, 1]), float(top[i])) for i in np.flatnonzero(top >= ACCEPT)]


def _grouped(block: list[tuple[int, str]]) -> Iterator[_Quotes]:
    """The quotes of a block by length, in groups whose matrix stays within CELLS."""
    own, size = [], 0
    for item, quote in sorted(block, key=lambda x: len(x[1])):
        if own and (len(own) + 1) * (size + len(quote)) > 4 * CELLS:
            yield _Quotes(own)
            own, size = [], 0
        own.append((item, quote))
        size += len(quote)
    if own:
        yield _Quotes(own)


FUZZY = "doc_id long, item_id long, start_item int, start_offset int, end_item int, end_offset int, score double"


def fuzzy(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """For each document and quote: the window of items most like the quote, if its Dice score is at least ACCEPT.

    Windows from each item grow while they are no longer than 1.65 quotes and 24 characters, by SPAN items at most, and
    count from LEAST characters and 0.45 quotes on; of equal scores the earliest and then the shortest window wins. All
    windows of all documents meet all quotes; nothing is shuffled. Quotes below two compact characters are nowhere.
    """
    spark = docs.sparkSession
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(lines, lambda x: T.compact(x)).alias("compacts"), F.transform(lines, lambda x: F.length(x)).alias("sizes"))
    wanted = quotes.select(F.col("item_id").cast("long").alias("item_id"), T.compact(T.normalize(F.col("text"))).alias("quote")).where("length(quote) > 1")
    out = spark.createDataFrame([], FUZZY)
    for block in _blocks(wanted):
        shared = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            groups = list(_grouped(shared.value))
            for batch in batches:
                rows = []
                for doc, compacts, sizes in zip(*(batch.column(i) for i in range(3)), strict=True):
                    compacts, sizes = compacts.as_py(), sizes.as_py()
                    kept = [i for i, x in enumerate(compacts) if x]
                    own = [compacts[i] for i in kept]
                    if sum(map(len, own)) >= LEAST:
                        rows += [(doc.as_py(), item, kept[a], 0, kept[z], sizes[kept[z]], score) for group in groups for item, a, z, score in group.best(own)]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FUZZY.split(", ")])

        out = out.unionByName(texts.mapInArrow(find, FUZZY))
    return out.withColumn("score", F.round("score", 9))


def resolve(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """The anchor of each quote in each document: exact, else normalized, else fuzzy; `how` says which."""
    columns = ["doc_id", "item_id", "start_item", "start_offset", "end_item", "end_offset"]
    first = exact(docs, quotes).select(*columns, F.lit("exact").alias("how"))
    second = normalized(docs, quotes).join(first, ["doc_id", "item_id"], "left_anti").select(*columns, F.lit("normalized").alias("how"))
    found = first.unionByName(second)
    third = fuzzy(docs, quotes).join(found, ["doc_id", "item_id"], "left_anti")
    return found.unionByName(third.select(*columns, F.lit("fuzzy").alias("how")))


def reanchor(current: DataFrame, recovered: DataFrame) -> DataFrame:
    """For (doc_id, item_id, score, has_rects) and recovered scores: which anchor is to stand, 'current' or 'recovered'."""
    both = current.join(recovered.select("doc_id", "item_id", F.col("score").alias("_new")), ["doc_id", "item_id"], "full")
    keep = F.col("_new").isNull() | (F.coalesce("score", F.lit(0.0)) >= KEEP) | (F.col("has_rects") & (F.col("_new") <= F.col("score") + MARGIN))
    return both.select("doc_id", "item_id", F.when(F.col("score").isNotNull() & keep, "current").otherwise("recovered").alias("stands"))
