"""Subword lattice likelihood: the probability of a text over all its segmentations into an existing vocabulary.

A text is a run of words and one end. A word's lattice has an edge for each vocabulary piece at each place; the word
begins with the vocabulary's word mark, which no later piece holds, so a text's lattice is a chain of its words'
lattices and its log probability their sum. A character that no piece spells takes its UTF-8 bytes' pieces. The
forward recursion runs in log space and sums over all paths. The end is one more piece, so that the probabilities of all
runs of pieces that close with an end sum to 1.

The pieces' weights start from the vocabulary's own scores, ranks taken as a Zipf law, and `ROUNDS` rounds of
expectation maximisation over all training tokens fit them to the corpus: each distinct word counts as often as it
stands in training texts. A round sums expected counts by piece, so the driver gets one number for each piece of the
fixed vocabulary and nothing that grows with the corpus.

Every distinct word of the corpus is scored once. The most frequent words, `HOT` at most, are broadcast; the other
words of each document are joined with the table of scores, in which no key is frequent.

Defined cases: a null or empty text is the end alone; a null doc_id counts as an empty text for the hold-out rule, so
it trains; repeated rows train and are scored one by one; without training documents every count is 0; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import textbytes as tb
from folioscan.session import materialize, table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
FOLDS, HELD_OUT = 5, 1
ROUNDS = 2
HOT = 400_000
#: Counts that each piece has beside those expected in the corpus.
PRIOR = 0.01
MARK = "▁"
LOG10 = math.log(10)


def vocabulary(path: str) -> dict[str, int]:
    """The pieces that can stand in a word's lattice, and the bytes, by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)}
    return {p: i for p, i in pieces.items() if MARK not in p[1:]}


def first_weights(path: str, pieces: dict[str, int]) -> np.ndarray:
    """Log probabilities by id from the vocabulary's scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = np.full(model.get_piece_size(), -np.inf)
    for i in pieces.values():
        out[i] = -math.log(10.0 - model.get_score(i))
    return out - np.logaddexp.reduce(out)


class Lattice:
    """Forward and backward recursions over many words at a time; words of one length share their steps.

    Substrings are looked up by rolling hashes in a sorted table of the pieces' hashes.
    """

    CELLS = 1 << 19

    def __init__(self, pieces: dict[str, int], weights: np.ndarray) -> None:
        spelt = {p: i for p, i in pieces.items() if not (len(p) == 6 and p.startswith("<0x"))}
        self.longest = max(map(len, spelt))
        self.weights = np.append(weights, -np.inf)  # by id; the last stands for no piece
        self.bytes = [pieces[f"<0x{b:02X}>"] for b in range(256)]
        with np.errstate(over="ignore"):
            hashes = np.concatenate([self._hashes(self._codes([p]))[0][0, :1] for p in spelt])
        order = np.argsort(hashes)
        self.table, self.ids = hashes[order], np.fromiter(spelt.values(), np.int64, len(spelt))[order]
        self.single = {ord(p) for p in spelt if len(p) == 1}

    @staticmethod
    def _codes(texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), -1)

    @staticmethod
    def _hashes(codes: np.ndarray, end: int | None = None, most: int = 1 << 30) -> list[np.ndarray]:
        """Hashes of the substrings that end at `end` (of the whole, if it is None), from the longest."""
        base = tb._BASES[0]
        total = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        np.cumsum(tb.mix(codes.astype(np.uint64) + np.uint64(1)) * tb._powers(base, codes.shape[1]), axis=1, out=total[:, 1:])
        inverse = tb._powers(pow(base, -1, 1 << 64), codes.shape[1] + 1)
        return [tb.mix((total[:, e : e + 1] - total[:, max(0, e - most) : e]) * inverse[max(0, e - most) : e]) for e in ([codes.shape[1]] if end is None else range(1, end + 1))]

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words of one length, and their characters after the word mark."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        cut = np.flatnonzero(np.diff(size[order])) + 1
        for own in np.split(order, cut):
            if len(own):
                step = max(1, self.CELLS // ((int(size[own[0]]) + 1) * self.longest))
                for lo in range(0, len(own), step):
                    part = own[lo : lo + step]
                    yield part, self._codes([MARK + words[k] for k in part])

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
        """alpha by place, and ids and log weights of the edges to each place; the last is where bytes spell a character."""
        n = codes.shape[1]
        alpha = np.full((len(codes), n + 1), -np.inf)
        alpha[:, 0] = 0.0
        spell = np.zeros((len(codes), n))
        strange = ~np.isin(codes, np.fromiter(self.single, np.uint32, len(self.single)))
        if strange.any():
            cost = {c: float(sum(self.weights[self.bytes[b]] for b in chr(c).encode("utf-8", "surrogatepass"))) for c in np.unique(codes[strange]).tolist()}
            spell[strange] = [cost[c] for c in codes[strange].tolist()]
        ids, weights = [], []
        for e, hashes in enumerate(self._hashes(codes, n, self.longest), 1):
            at = np.minimum(np.searchsorted(self.table, hashes), len(self.table) - 1)
            own = np.where(self.table[at] == hashes, self.ids[at], -1)
            w = self.weights[own]
            w[:, -1] = np.where(strange[:, e - 1], spell[:, e - 1], w[:, -1])
            terms = alpha[:, max(0, e - self.longest) : e] + w
            top = terms.max(axis=1)
            alpha[:, e] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
            ids.append(own)
            weights.append(w)
        return alpha, ids, weights, strange

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        with np.errstate(over="ignore"):
            for own, codes in self.groups(words):
                out[own] = self.forward(codes)[0][:, -1]
        return out

    def expect(self, words: list[str], times: np.ndarray, into: np.ndarray) -> None:
        """Add each piece's expected number in the words, each as often as it comes."""
        with np.errstate(over="ignore"):
            for own, codes in self.groups(words):
                alpha, ids, weights, strange = self.forward(codes)
                n = codes.shape[1]
                share = np.zeros_like(alpha)  # expected passes through each place
                share[:, n] = times[own]
                for e in range(n, 0, -1):
                    lo = max(0, e - self.longest)
                    part = share[:, e : e + 1] * np.exp(alpha[:, lo:e] + weights[e - 1] - alpha[:, e : e + 1])
                    share[:, lo:e] += part
                    found = ids[e - 1] >= 0
                    into += np.bincount(ids[e - 1][found], part[found], len(into))
                    for k in np.flatnonzero(strange[:, e - 1]).tolist():
                        for b in chr(codes[k, e - 1]).encode("utf-8", "surrogatepass"):
                            into[self.bytes[b]] += part[k, -1]


def _lower_slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = tb.text_bytes(batch.column(column))
    for lo, hi in tb.slices(offsets, 4 * tb.SLICE):
        yield lo, hi, tb.LOWER[buf[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a task with their counts in training texts, put together before they are shuffled."""
    held: list[pa.RecordBatch] = []

    def put_together() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        code = pa.concat_arrays([*whole.column(0).chunks, pa.array([], pa.large_string())]).dictionary_encode()
        counts = np.bincount(code.indices.to_numpy(), whole.column(1).to_numpy(), len(code.dictionary)).astype(np.int64)
        return pa.record_batch([code.dictionary, pa.array(counts)], names=["word", "c"])

    for batch in batches:
        trains = ~batch.column(1).to_numpy(zero_copy_only=False)
        for lo, _, buf, offsets in _lower_slices(batch, 2):
            words, code, rows = tb.distinct_words(buf, offsets)
            counts = np.bincount(code, trains[rows + lo], len(words)).astype(np.int64)
            held.append(pa.record_batch([words, pa.array(counts)], names=["word", "c"]))
            if sum(x.num_rows for x in held) > 1_000_000:
                held = [put_together()]
                if held[0].num_rows > 500_000:
                    yield held.pop()
    if held:
        yield put_together()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) for each distinct word of texts (doc_id, held_out, text), lower-cased: c counts the texts that aren't held out."""
    return texts.mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fitted(counts: DataFrame, n_texts: int, path: str = VOCABULARY, rounds: int = ROUNDS) -> tuple[dict[str, int], np.ndarray, float]:
    """The vocabulary's pieces, their log probabilities after `rounds` rounds over the words of counts, and that of the end."""
    pieces = vocabulary(path)
    weights, end = first_weights(path, pieces), 0.0
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast((pieces, weights))

        def expected(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, into = Lattice(*shared.value), np.zeros(len(shared.value[1]))
            for batch in batches:
                lattice.expect(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float), into)
            found = np.flatnonzero(into)
            yield pa.record_batch([pa.array(found), pa.array(into[found])], names=["piece", "n"])

        sums = counts.where("c > 0").select("word", "c").mapInArrow(expected, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        total = np.zeros(len(weights))
        total[list(pieces.values())] = PRIOR
        for row in sums:
            total[row["piece"]] += row["n"]
        with np.errstate(divide="ignore"):
            weights = np.log(total / (total.sum() + n_texts + PRIOR))
        end = math.log((n_texts + PRIOR) / (total.sum() + n_texts + PRIOR))
    return pieces, weights, end


def with_paths(counts: DataFrame, pieces: dict[str, int], weights: np.ndarray) -> DataFrame:
    """(word, c) with `path`, the natural log probability of all paths through pieces."""
    shared = counts.sparkSession.sparkContext.broadcast((pieces, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(lattice.log_probabilities(batch.column(0).to_pylist()))], names=["word", "c", "path"])

    return counts.mapInArrow(score, "word string, c long, path double")


SUMMED = "doc_id long, held_out boolean, n_tokens long, n_hot long, hot_base double, hot_score double, words array<string>, times array<long>"


def _summed(shared):
    """Sums over the frequent words of each text, and its other words."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_base, hot_score = shared.value
        for batch in batches:
            for lo, hi, buf, offsets in _lower_slices(batch, 2):
                n = hi - lo
                words, code, rows = tb.distinct_words(buf, offsets)
                place = pc.index_in(words, hot).fill_null(-1).to_numpy().astype(np.int64)
                known = place >= 0
                base, score = np.zeros(len(words)), np.zeros(len(words))
                base[known], score[known] = hot_base[place[known]], hot_score[place[known]]
                cold = ~known[code]
                pairs, times = np.unique(rows[cold] * max(1, len(words)) + code[cold], return_counts=True)
                owner, which = pairs // max(1, len(words)), pairs % max(1, len(words))
                at = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, n),
                        batch.column(1).slice(lo, n),
                        pa.array(np.bincount(rows, minlength=n) + 1),
                        pa.array(np.bincount(rows, known[code], n).astype(np.int64)),
                        pa.array(np.bincount(rows, base[code], n).astype(float)),
                        pa.array(np.bincount(rows, score[code], n).astype(float)),
                        pa.ListArray.from_arrays(at, words.take(pa.array(which)).cast(pa.string())),
                        pa.ListArray.from_arrays(at, pa.array(times.astype(np.int64))),
                    ],
                    names=[x.split(" ")[0] for x in SUMMED.split(", ")],
                )

    return add


def lattice_scores(docs: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS, hot_words: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    counts = materialize(word_counts(texts), "word-counts")
    n_texts = texts.where(~F.col("held_out")).count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = sums["n"] + n_texts, sums["v"] + (n_texts > 0)
    norm = total + 0.5 * (distinct + 1)
    pieces, weights, end = fitted(counts, n_texts, path, rounds)
    c = F.col("c")
    scored = with_paths(counts, pieces, weights).select("word", "c", F.log10((c + 0.5) / F.lit(norm)).alias("base"), (F.col("path") / LOG10).alias("score"))
    scored = materialize(scored, "word-scores")

    # the lowest count, in eighths of an octave, that at most hot_words words reach
    level = F.floor(F.log2(F.greatest(c, F.lit(1))) * 8)
    steps, low, seen = sorted(((r["level"], r["count"]) for r in scored.groupBy(level.alias("level")).count().collect()), reverse=True), math.inf, 0
    for step, n in steps:
        seen += n
        if seen > hot_words:
            break
        low = step
    frequent = (level >= F.lit(float(low))) & (c > 0)
    most = scored.where(frequent).select("word", "base", "score").toArrow()
    hot = pa.concat_arrays([*most.column("word").cast(pa.large_string()).chunks, pa.array([], pa.large_string())])
    shared = spark.sparkContext.broadcast((hot, most.column("base").to_numpy(), most.column("score").to_numpy()))
    summed = materialize(texts.mapInArrow(_summed(shared), SUMMED).withColumn("row", F.monotonically_increasing_id()), "summed")

    rare = summed.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), "x.times")
    rest = rare.join(scored.where(~frequent), "word").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_cold"), F.sum(F.col("times") * F.col("base")).alias("cold_base"), F.sum(F.col("times") * F.col("score")).alias("cold_score")
    )
    out = summed.drop("words", "times").join(rest, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_cold", F.lit(0)) + F.lit(int(n_texts > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("cold_base", F.lit(0.0)) + F.lit(math.log10((n_texts + 0.5) / norm))).alias("base_score"),
        (F.col("hot_score") + F.coalesce("cold_score", F.lit(0.0)) + F.lit(end / LOG10)).alias("score"),
    )


def op10_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"))
