"""Mixing sources to target weights, in DataFrame functions only.

Sizes are words. Sources share the corpus by weight, no target passes `MAX_REPEATS` times its source's size, and what
is cut off goes to the other sources by weight until none is above. Each document then comes floor(rate) times, plus
one more copy when a number drawn from a keyed hash of the document, its id and its text, falls below the rate's
fraction; the draw depends on nothing but the document and the seed, so reruns and retried tasks agree.

Defined cases: a null text has size 0 and so has an empty one; null sources form one source of their own, last in
order; a source of size 0 has target 0 and rate 0; a null doc_id draws from the text, and so do documents that
share an id; rows that repeat both id and text are documents of their own and draw alike; an empty table gives an empty result; other columns, whatever their names, pass
through `mix` unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.llm.quality import words_of
from folioscan.session import materialize, table

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20_031
#: So many sources, at some 100 bytes each, are broadcast at most; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """Each row of docs as `row`, with its source, its `size` (words) and `draw`, a number from 0 to 1 exclusive."""
    own = F.md5(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.lit(SEED).cast("string"), F.col("row.doc_id").cast("string"), own).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.select("row", F.col("row.source").alias("source"), F.size(words_of(F.col("row.text"))).cast("long").alias("size"), draw.alias("draw"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """A row for each source: source, source_size, weight, target, rate. `sizes` has source and size.

    Water filling in closed form: in ascending order of cap / weight the sources are full up to a point, after which
    the rest shares what is left by weight. The windows run over one row for each source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    named = per.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_k") % len(WEIGHTS) + 1).cast("int"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = named.withColumns({"weight": weight, "_cap": (F.col("source_size") * MAX_REPEATS).cast("double")}).withColumn("_total", F.sum("source_size").over(whole.partitionBy()).cast("double"))
    order = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("_k").asc())
    level = capped.withColumns(
        {
            "_full": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_left": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    ).withColumn("_share", F.greatest(F.col("_total") - F.col("_full"), F.lit(0.0)) / F.col("_left"))
    # the first source that is not full fixes the level of all after it
    fits = F.col("_share") * F.col("weight") <= F.col("_cap")
    settled = level.withColumn("_level", F.min(F.when(fits, F.struct(F.col("_cap") / F.col("weight"), F.col("_k"), F.col("_share"))).otherwise(F.lit(None))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_level._share") * F.col("weight"), F.col("_cap")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_REPEATS)))).otherwise(F.lit(0.0))
    return settled.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def rated(docs: DataFrame) -> DataFrame:
    """Each row of docs as `row`, with size, source_size, target, rate and copies."""
    work = sized(docs)
    targets = materialize(source_targets(work.select("source", "size")), "targets").withColumnRenamed("source", "of")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    copies = F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return work.join(targets, F.col("source").eqNullSafe(F.col("of")), "inner").select("row", "size", "source_size", "target", "rate", copies.cast("int").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; documents that it takes no copy of are left out."""
    return rated(docs).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rated(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  ('0x' || substr(md5(concat_ws(':', '20031', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k, (source_size * 3)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM p),
w AS (SELECT *, (k % 3 + 1)::DOUBLE AS weight FROM k),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
s AS (SELECT *, greatest(total - filled, 0) / weights AS share FROM l),
f AS (SELECT *, first_value(CASE WHEN share * weight <= cap THEN share END IGNORE NULLS) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM s),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(level * weight, cap) END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t),
c AS (SELECT d.*, r.source_size, r.target, r.rate, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, rate, copies FROM c
"""
