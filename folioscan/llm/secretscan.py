"""Secret scans of all versions of all texts by a ledger of blobs, in DataFrame functions only.

A text is addressed by its content, SHA-256 of its UTF-8 bytes, so each text is a blob however many paths and versions
hold it. The ledger has two tables: the pairs of blob and rule version that were scanned, one integer of bits for each
blob, and the findings, by blob. `Ledger.record` addresses all versions, scans the pairs that the ledger does not have,
each blob once, and adds them; `Ledger.findings_of` joins findings back to all paths. A rule is never changed: its next
version is a rule with another bit, and only that is scanned over what is known. Findings are written before the pairs
they come from, and are a set: a scan that breaks off is done again and adds nothing twice.

What travels: addresses, and of the texts only those of unscanned blobs in which some rule's hint, a necessary condition,
is met where they are read; copies of them are put together before the shuffle. Places are sums of the code points of
matches and of the gaps between them, so they take one pass for a rule, whatever the number of matches in a text.

Rules find leftmost matches that don't overlap and drop those of fewer than `least` code points in `group`; a dropped match
is still passed over. No pattern can run back over more than a bounded number of characters, and none recurs.

Defined cases: a null text is the empty blob, which has no findings; null, equal or clashing keys of paths are kept as they
are, row by row, but a column `blob` is replaced; an empty table adds nothing; rows that repeat are joined each.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.session import discard, materialize, shared_dir, table


@dataclass(frozen=True)
class Rule:
    bit: int  # of the pair of kind and version; never given again
    kind: str
    version: int
    pattern: str
    hint: str  # met in every text with a finding
    least: int = 1
    group: int = 0


VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BLANK = r"\x20\x09-\x0D"
RULES = (
    Rule(0, "assign", 1, f"{ASSIGN}({VALUE}+)", f"{ASSIGN}{VALUE}{{8}}", 8, 1),
    # runs below the least length can't hold a longer one, so patterns may ask for it
    Rule(1, "access", 1, "AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]{12}", 16),
    Rule(2, "hex", 1, "[0-9a-f]{32,}", "[0-9a-f]{32}", 32),
    Rule(3, "private_key", 1, "-----BEGIN (?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule(4, "forge_token", 1, "gh[opsru]_[A-Za-z0-9]{36,}", "gh[opsru]_[A-Za-z0-9]{36}"),
    Rule(5, "chat_token", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-"),
    Rule(6, "web_token", 1, r"eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?", r"\.eyJ"),
    Rule(7, "url_password", 1, rf"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^{BLANK}:/@]{{1,64}}:[^{BLANK}/@]{{3,128}}@", "://[^:/@]{1,64}:"),
)
#: In the order in which kinds are listed.
KINDS = tuple(dict.fromkeys(r.kind for r in RULES))
BASE = KINDS[:3]


def latest(rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The highest version of each kind."""
    return tuple({r.kind: r for r in sorted(rules, key=lambda r: r.version)}.values())


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _matches(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, kind, version, start and end (code points, end exclusive) of what rules find in texts (blob, text, todo), each for the blobs that lack it."""
    lengths = lambda x: F.transform(x, lambda y: F.length(y))

    def places(r: Rule) -> Column:
        pattern, text = F.lit(r.pattern), F.col("text")
        parts = F.arrays_zip(
            lengths(F.split(text, r.pattern, -1)).alias("gap"), lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("hit"), lengths(F.regexp_extract_all(text, pattern, F.lit(r.group))).alias("value")
        )
        wanted = (F.col("todo").bitwiseAND(F.lit(1 << r.bit)) != 0) & text.rlike(r.hint)
        return F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.when(wanted, parts).alias("parts"))

    each = texts.select("blob", F.explode(F.array(*[places(r) for r in rules])).alias("r")).where("r.parts IS NOT NULL")
    parts = each.select("blob", "r.kind", "r.version", "r.least", F.posexplode("r.parts").alias("i", "p"))
    upto = F.sum(F.col("p.gap") + F.coalesce("p.hit", F.lit(0))).over(Window.partitionBy("blob", "kind", "version").orderBy("i"))
    found = parts.select("blob", "kind", "version", "least", "p.hit", "p.value", upto.alias("end")).where("hit IS NOT NULL AND value >= least")
    return found.select("blob", "kind", "version", (F.col("end") - F.col("hit")).alias("start"), "end")


class Ledger:
    """The ledger in a folder that driver and executors share; an absent one is begun."""

    PAIRS = "blob binary, pairs long"
    FINDINGS = "blob binary, kind string, version int, start long, end long"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        for name, shape in (("pairs", self.PAIRS), ("findings", self.FINDINGS)):
            spark.createDataFrame([], shape).write.mode("ignore").parquet(f"{folder}/{name}")

    def scanned(self) -> DataFrame:
        """blob, and the bits of the rules that were applied to it."""
        return self.spark.read.schema(self.PAIRS).parquet(f"{self.folder}/pairs").groupBy("blob").agg(F.bit_or("pairs").alias("pairs"))

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The findings of the rules; a row may stand twice."""
        own = F.lit(False)
        for r in rules:
            own |= (F.col("kind") == r.kind) & (F.col("version") == r.version)
        return self.spark.read.schema(self.FINDINGS).parquet(f"{self.folder}/findings").where(own)

    def record(self, versions: DataFrame, rules: tuple[Rule, ...] | None = None, text: str = "text") -> DataFrame:
        """The paths of versions: `path`, a row of all columns but the text, and `blob`; what no rule has seen of them is scanned first."""
        rules = rules or latest()
        keys = [F.col(f"`{c}`") for c in versions.columns if c not in (text, "blob")]
        if not keys:
            keys = [F.lit(None).cast("string").alias("path")]  # a row of the table has to have a column
        own = versions.select(F.col(f"`{text}`").alias("text"), F.struct(*keys).alias("path"))
        paths = materialize(own.select("path", address(F.col("text")).alias("blob")), "paths")
        every = F.lit(sum(1 << r.bit for r in rules))
        todo = every.bitwiseAND(F.bitwise_not(F.coalesce("pairs", F.lit(0))))
        lacking = materialize(paths.select("blob").distinct().join(self.scanned(), "blob", "left").select("blob", todo.alias("todo")).where("todo <> 0"), "unscanned")
        needed = lacking.agg(F.bit_or("todo").alias("bits")).first()["bits"] or 0
        if needed:
            due = tuple(r for r in rules if needed >> r.bit & 1)
            hinted = own.where(F.col("text").rlike("|".join(f"(?:{r.hint})" for r in due))).select("text", address(F.col("text")).alias("blob"))
            texts = hinted.join(lacking, "blob").dropDuplicates(["blob"])
            _matches(texts, due).write.mode("append").parquet(f"{self.folder}/findings")
            lacking.withColumnRenamed("todo", "pairs").write.mode("append").parquet(f"{self.folder}/pairs")
        discard(lacking)
        return paths

    def findings_of(self, paths: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
        """paths (path, blob) with `found`: kind, start and end of each finding of its blob, by start and kind as listed; null where there is none."""
        by_start = F.struct("start", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("k"), "kind", "end")
        own = self.findings(rules or latest()).groupBy("blob").agg(F.array_sort(F.collect_set(by_start)).alias("found"))
        return paths.join(own, "blob", "left")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, f"{shared_dir(spark)}/folioscan/secrets-{uuid.uuid4().hex}")
    paths = ledger.record(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = ledger.findings_of(paths).withColumn("found", F.coalesce("found", F.expr("CAST(array() AS array<struct<start: bigint, k: bigint, kind: string, end: bigint>>)")))
    counted = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.filter("found", lambda x: x["kind"].isin(*BASE)))
    return found.select("path.doc_id", *map(counted, BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _sql() -> str:
    any_case = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    each = []
    for r in RULES:
        p = r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{any_case})").replace("'", "''")
        cut = f"regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}') AS g"
        each.append(f"SELECT r, {KINDS.index(r.kind)} AS k, '{r.kind}' AS kind, {r.least} AS least, unnest(range(len(h))) AS i, unnest(g[1:len(h)]) AS gap, unnest(h) AS hit, unnest(v) AS value FROM (SELECT r, {cut} FROM d WHERE regexp_matches(t, '{p}'))")
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({' UNION ALL '.join(each)}),
e AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, k ORDER BY i) AS upto FROM p),
f AS (SELECT r, k, kind, kind || ':' || (upto - length(hit))::BIGINT || ':' || upto::BIGINT AS span, upto - length(hit) AS place FROM e WHERE length(value) >= least),
a AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(span, ',' ORDER BY place, k) FILTER (k < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY place, k) AS spans FROM f GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


OP12_SQL = _sql()
