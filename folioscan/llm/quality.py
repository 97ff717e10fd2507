"""Quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` evaluates every rule once for each document and keeps the measurements beside one integer whose bit r says
that rule r failed. Policies are versioned sets of rules, so a changed policy needs no further pass over the texts:
`apply_policy` is one bitwise AND, and `ablations` counts from a histogram of the masks, which has at most
2 ** len(RULES) rows whatever the corpus holds.

Defined cases: a null text has no words and fails `few_words`; an empty text does the same; a null doc_id is passed
through; repeated rows are judged one by one; an empty table gives an empty ledger; other columns of the input are not
read, or pass through `passing`, whatever their names. Nothing is shuffled for the ledger: each row is measured where it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.session import table

WHITE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The runs of anything but the six ASCII white space characters."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # over the columns of `measured`


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(5, "exclamations", "10 * n_exclamations > 3 * n_words"),
    Rule(6, "capitals", "2 * n_capitals > word_chars"),
)
BASE_RULES = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


POLICIES = {
    1: Policy(1, BASE_RULES),
    2: Policy(2, BASE_RULES + ("symbols", "duplicate_lines", "word_length")),
    3: Policy(3, tuple(r.name for r in RULES)),
}
CURRENT = 3


def _measured(rows: DataFrame) -> DataFrame:
    """`row`, whatever it is, and the measurements of `text` beside it.

    Windows of three words are compared by their 64-bit hashes. Most texts repeat none, which one pass over the hashes
    shows; only the others sort (hash, position) pairs, so that a text of n words costs n log n at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = rows.select(
        "row",
        words_of(text).alias("_w"),
        lines.alias("_l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^!]+", "")).cast("long").alias("n_exclamations"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    hashed = first.select(
        "row",
        "n_symbols",
        "n_exclamations",
        "n_capitals",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(_w) < 3 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END").alias("_h"),
    )
    repeats = hashed.withColumn(
        "_s",
        F.expr("CASE WHEN size(array_distinct(_h)) = size(_h) THEN NULL ELSE sort_array(transform(_h, (h, i) -> struct(h, i))) END"),
    ).withColumn(
        "_p",
        F.expr("sort_array(transform(filter(_s, (x, k) -> (k > 0 AND _s[greatest(k - 1, 0)].h = x.h) OR (k + 1 < size(_s) AND _s[least(k + 1, size(_s) - 1)].h = x.h)), x -> x.i))"),
    )
    covered = "CASE WHEN _p IS NULL OR size(_p) = 0 THEN 0L ELSE aggregate(transform(_p, (x, k) -> CASE WHEN k + 1 < size(_p) THEN least(3, _p[least(k + 1, size(_p) - 1)] - x) ELSE 3 END), 0L, (a, x) -> a + x) END"
    found = repeats.withColumn("n_repeat_words", F.expr(covered)).drop("_h", "_s", "_p")
    # as a generated row, so that a filter on a measurement isn't rewritten into the expressions that it comes from
    rest = [c for c in found.columns if c != "row"]
    return found.select("row", F.inline(F.array(F.struct(*rest))))


def _judged(rows: DataFrame) -> DataFrame:
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return _measured(rows).withColumn("failed", mask.cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements of each document and `failed`, the bits of the rules that it fails."""
    return _judged(docs.select(F.col("doc_id").alias("row"), "text")).withColumnRenamed("row", "doc_id")


def passing(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of docs that pass the policy, each judged by its own text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", "row.text")
    return apply_policy(_judged(rows), version).where("kept").select("row.*")


def apply_policy(entries: DataFrame, version: int = CURRENT, into: str = "kept") -> DataFrame:
    """`into`: whether the document passes every rule of the policy."""
    return entries.withColumn(into, F.col("failed").bitwiseAND(F.lit(POLICIES[version].mask)) == 0)


def ablations(entries: DataFrame) -> DataFrame:
    """For each policy and rule of it: how many documents the policy rejects, how many fail the rule, and how many only that rule rejects."""
    spark = entries.sparkSession
    plan = [(p.version, r.name, p.mask, 1 << r.bit) for p in POLICIES.values() for r in RULES if r.name in p.rules]
    policies = spark.createDataFrame(plan, "policy int, rule string, mask long, bit long")
    seen = entries.groupBy("failed").agg(F.count("*").alias("n"))
    within = F.col("failed").bitwiseAND(F.col("mask"))
    return (
        seen.join(F.broadcast(policies), F.lit(True))
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            F.sum(F.when(within != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
            F.sum(F.when(within.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(within == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        )
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(POLICIES[1].mask)) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
t AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM t),
p AS (SELECT DISTINCT r, i + k AS i FROM n, (VALUES (0), (1), (2)) v(k) WHERE n > 1),
s AS (SELECT r, count(*) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
  length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(s.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN s USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
  + CASE WHEN 10 * n_exclamations > 3 * n_words THEN 32 ELSE 0 END + CASE WHEN 2 * n_capitals > word_chars THEN 64 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects of the documents, from the ledger's histogram."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


_PLAN = ", ".join(f"({p.version}, '{r.name}', {p.mask}, {1 << r.bit})" for p in POLICIES.values() for r in RULES if r.name in p.rules)
ABLATIONS_SQL = f"""WITH l AS (SELECT failed FROM ({OP3_SQL.strip()})), p(policy, rule, mask, bit) AS (VALUES {_PLAN})
SELECT policy, rule, count(*) AS n_docs, count(*) FILTER (failed & mask <> 0) AS n_rejected, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only_this FROM l, p GROUP BY policy, rule"""
