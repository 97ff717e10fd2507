"""Connected components of a table of links, by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.session import bounded, discard, materialize

#: Neighbours of a node that are told its label by one row of it; a node with more has as many more rows.
NEIGHBOURS = 2_000
BROADCAST_BYTES = 32 << 20


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b): label is the lowest node of its component.

    Each round takes the lowest label among a node and its neighbours, then the label's own label, so that long paths
    shrink by half; rounds end when no label changes, and their number grows with the logarithm of the longest path.
    Minima are combined before they are shuffled. A node with very many links is dealt out with shares of its
    neighbours, and labels are only looked up where they moved, one row for each label and not for each node.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both, "links-both-ways")
    heavy = materialize(both.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > NEIGHBOURS).select("b", F.ceil(F.col("n") / NEIGHBOURS).cast("int").alias("shares")), "hubs")
    heavy = bounded(heavy, heavy.count() * 12, BROADCAST_BYTES)
    edges = materialize(both.join(heavy, "b", "left").select("a", "b", F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.col("shares"))).cast("int").alias("share")), "edges")
    labels, _ = _jumped(materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels"))
    discard(both)
    while True:
        told = labels.withColumnRenamed("node", "b").join(heavy, "b", "left").select("b", "label", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
        lowest = edges.join(told, ["b", "share"]).select(F.col("a").alias("node"), "label").unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        fresh, moved = _jumped(materialize(lowest, "lowest"))
        same = not moved and fresh.join(labels.withColumnRenamed("label", "_was"), "node").where("label <> _was").isEmpty()
        discard(labels)
        if same:
            discard(edges)
            return fresh
        labels = fresh


def _jumped(labels: DataFrame) -> tuple[DataFrame, int]:
    """labels, where each label that has a lower one itself is replaced by that one, and how many such labels there were."""
    moved = labels.select("label").distinct().join(labels.select(F.col("node").alias("label"), F.col("label").alias("_up")), "label").where("_up <> label")
    moved = materialize(moved, "moved-labels")
    n = moved.count()
    if not n:
        return labels, 0
    fresh = materialize(labels.join(bounded(moved, 16 * n, BROADCAST_BYTES), "label", "left").select("node", F.coalesce("_up", "label").alias("label")), "labels")
    discard(labels)
    return fresh, n


def joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """components (node, label) after further links (a, b) of nodes, which need not be in components; only what lies between components is gone through."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        own = components.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        ends = ends.join(own, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    between = materialize(ends.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "links-between")
    merged = connected(between).select(F.col("node").alias("label"), F.col("label").alias("_merged"))
    # nodes that are in no component are their own label in between
    alone = between.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(components.select("node"), "node", "left_anti")
    known = components.select("node", "label").unionByName(alone.select("node", F.col("node").alias("label")))
    return materialize(known.join(merged, "label", "left").select("node", F.coalesce("_merged", "label").alias("label")), "components")
