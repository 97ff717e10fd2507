"""Fill-in-middle transformation: a text is cut at two of its units' ends, and its parts change places around markers.

A slice of texts is laid out in blocks of a fixed number of bytes, a text's last block being shorter. Each text has two
Fenwick trees over its blocks: how many units begin in a block, and how many code points. A cut after k units is where
unit k + 1 begins: a descent by binary lifting finds its block without a look at any other, the place in the block is
found among that block's bytes alone, and the second tree has the code points before the block. All trees of a slice lie
in one array, and all cuts of it descend at once.

Only the texts go to Python, and three numbers for each come back; the parts are put together from code points where the
rows are, so nothing is shuffled. `restored` rebuilds a text from its output and form alone: the markers are such that
none can begin inside another, so the first of each kind is the one that was put in.

Defined cases: a null text is an empty one; an empty text, or one that contains a marker, stays as it is (form plain); a
null doc_id is drawn as if its digits were none; rows that share a doc_id share their draws; an empty table gives an
empty result; other columns pass through whatever their names, but for the five that `transformed` adds or replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import textbytes as tb
from folioscan.session import table

#: Bytes of a block.
BLOCK = 1024
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        own = (self.prefix, self.suffix, self.middle)
        within = any(b in a for i, a in enumerate(own) for j, b in enumerate(own) if i != j)
        if within or any(a.startswith(b[k:]) for a in own for b in own for k in range(1, len(b))):
            raise ValueError("no marker may hold another, be empty or begin with another's end")


def line_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte, where units are lines with their line feeds."""
    begins = np.empty(len(buf), bool)
    begins[1:] = buf[:-1] == 10
    begins[offsets[:-1][offsets[:-1] < len(buf)]] = True
    return begins


def point_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The same where units are code points."""
    return buf & 0xC0 != 0x80


UNITS = {"line": line_starts, "code point": point_starts}


class Forest:
    """A Fenwick tree for each text over the numbers of what begins in its blocks."""

    def __init__(self, marks: np.ndarray, starts: np.ndarray, first: np.ndarray) -> None:
        """marks: whether it begins at a byte; starts: of the blocks, and the end; first: each text's first block, and the end."""
        self.first, self.size = first[:-1], np.diff(first)
        sums = np.concatenate(([0], np.cumsum(marks)))
        self.tree = np.diff(sums[starts]).astype(np.int64)
        self.place = np.arange(1, len(self.tree) + 1) - np.repeat(self.first, self.size)
        step = 1
        while step < self.size.max(initial=0):
            up = np.flatnonzero(self.place % (2 * step) == 0)
            self.tree[up] += self.tree[up - step]
            step *= 2

    def before(self, text: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """How many begin in the first `blocks` blocks of each text."""
        total, at = np.zeros(len(text), np.int64), blocks.copy()
        while at.any():
            on = np.flatnonzero(at)
            total[on] += self.tree[self.first[text[on]] + at[on] - 1]
            at[on] &= at[on] - 1
        return total

    def descend(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block in which number k (from 0) of each text begins, or the number of blocks, and how many begin before it."""
        at, passed = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        step = 1 << int(self.size.max(initial=0)).bit_length()
        while step:
            on = np.flatnonzero(at + step <= self.size[text])
            here = self.tree[self.first[text[on]] + at[on] + step - 1]
            go = passed[on] + here <= k[on]
            at[on[go]] += step
            passed[on[go]] += here[go]
            step >>= 1
        return at, passed


def cut_points(buf: np.ndarray, offsets: np.ndarray, draws: np.ndarray, starts_of) -> tuple[np.ndarray, np.ndarray]:
    """The number of units of each text, and the code points before each text's cuts; `draws` (texts x cuts) modulo one more than its units says after how many units a cut is."""
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    own = np.repeat(np.arange(len(lengths)), blocks)
    starts = np.append(offsets[own] + BLOCK * (np.arange(first[-1]) - first[own]), len(buf))
    unit, point = starts_of(buf, offsets), point_starts(buf, offsets)
    units, points = Forest(unit, starts, first), Forest(point, starts, first)
    every = np.arange(len(lengths))
    n = units.before(every, blocks)
    text = np.repeat(every, draws.shape[1])
    k = (draws % (n + 1)[:, None]).ravel()
    block, passed = units.descend(text, k)
    chars = points.before(text, block)
    for i in np.flatnonzero(block < blocks[text]):
        lo, hi = starts[first[text[i]] + block[i]], starts[first[text[i]] + block[i] + 1]
        at = np.flatnonzero(unit[lo:hi])[k[i] - passed[i]]
        chars[i] += np.count_nonzero(point[lo : lo + at])
    return n, chars.reshape(draws.shape)


def _cuts(unit: str):
    kind = pa.struct([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    @F.arrow_udf("struct<n: bigint, a: bigint, b: bigint>")
    def cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        buf, offsets = tb.text_bytes(text)
        draws = np.stack((h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)), 1)
        out = []
        for lo, hi in tb.slices(offsets):
            n, chars = cut_points(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], draws[lo:hi], UNITS[unit])
            out.append(np.column_stack((n, np.sort(chars, 1))))
        whole = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        return pa.StructArray.from_arrays([pa.array(c) for c in whole.T], fields=list(kind))

    return cuts


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32, from the hexadecimal SHA-256 of the seed and the decimal id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", markers: Markers | None = None, text: str = "text") -> DataFrame:
    """docs with n (units), form, prefix_chars and middle_chars (code points; null if plain) and output.

    `rate` of 100 texts are cut, `spm` of 100 of them in the order suffix, prefix, middle and the others in the order prefix,
    suffix, middle.
    """
    m = markers or Markers()
    names = [c for c in docs.columns if c not in ADDED]
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    others = [F.col(f"`{c}`") for c in names if c != text]
    filler = "_" * (1 + max(map(len, names)))  # a struct needs a field, of a name that no column has
    rows = docs.select(F.struct(F.lit(0).alias(filler), *others).alias("row"), F.col(f"`{text}`").alias("t"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    whole = F.coalesce("t", F.lit("")) == ""
    for x in (m.prefix, m.suffix, m.middle):
        whole |= F.col("t").contains(x)  # never of a null, which is whole already
    form = F.when(whole | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    # a generated row, so that what follows does not repeat the expressions of the draws
    cut = rows.select("row", "t", form.alias("form"), _cuts(unit)("t", "h1", "h2").alias("c"))
    cut = cut.select("row", F.inline(F.array(F.struct("t", "form", F.col("c.n").alias("n"), F.col("c.a").alias("a"), (F.col("c.b") - F.col("c.a")).alias("m")))))
    part = lambda at, n: F.substring("t", at.cast("int"), n.cast("int"))
    prefix, middle = part(F.lit(1), F.col("a")), part(F.col("a") + 1, F.col("m"))
    suffix = F.substring(F.col("t"), (F.col("a") + F.col("m") + 1).cast("int"), F.lit(2**31 - 1))
    psm = F.concat(F.lit(m.prefix), prefix, F.lit(m.suffix), suffix, F.lit(m.middle), middle)
    spm_ = F.concat(F.lit(m.suffix), suffix, F.lit(m.prefix), prefix, F.lit(m.middle), middle)
    output = F.when(F.col("form") == "plain", F.coalesce("t", F.lit(""))).when(F.col("form") == "psm", psm).otherwise(spm_)
    cut_ = F.col("form") != "plain"
    own = [F.col("t").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names]
    return cut.select(*own, "n", "form", F.when(cut_, F.col("a")).alias("prefix_chars"), F.when(cut_, F.col("m")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, markers: Markers | None = None) -> Column:
    """The text that the output was made from."""
    m = markers or Markers()

    def between(before: str, after: str | None) -> Column:
        rest = F.substring(output, F.locate(before, output) + len(before), F.lit(2**31 - 1))
        return F.substring_index(rest, after, 1) if after else rest

    psm = F.concat(between(m.prefix, m.suffix), between(m.middle, None), between(m.suffix, m.middle))
    spm = F.concat(between(m.prefix, m.middle), between(m.middle, None), between(m.suffix, m.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    made = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.inline(F.array(F.struct("output"))))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256 FROM p
"""
