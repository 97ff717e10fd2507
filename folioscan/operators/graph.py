"""Object graphs: sections of references merged, references resolved, trees flattened with inherited attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from folioscan.session import discard, materialize


def first_wins(entries: DataFrame, key: list[str], rank: str) -> DataFrame:
    """The entry of the lowest rank of each key, by an aggregate that is combined before the shuffle."""
    rest = [c for c in entries.columns if c not in key]
    return entries.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("_e")).select(*key, "_e.*")


def resolve(refs: DataFrame, objects: DataFrame, on: str) -> DataFrame:
    """Each reference with its object in use; null where there is none."""
    return refs.join(objects.where("in_use").drop("in_use"), on, "left")


def flatten(nodes: DataFrame) -> DataFrame:
    """Nodes (id, parent, ord, kind, attr) below the roots (parent null) with `path`, the ordinals from the root, and `inherited`, the nearest attr.

    An array as attr is several attributes, each inherited by itself. Ordered by path, the rows are the tree in pre-order;
    a node that has several parents has a row for each way to it.

    What a node has from above is put together by pointer jumping: each round doubles the stretch of ancestors that a row
    knows, so a tree of any depth takes as many rounds as the depth has bits. A way that comes by a node twice is left out,
    so cycles end; so are nodes that no root leads to.
    """
    several = isinstance(nodes.schema["attr"].dataType, ArrayType)
    nearest = F.zip_with("inherited", "_inherited", lambda a, b: F.coalesce(a, b)) if several else F.coalesce("inherited", "_inherited")
    rows = materialize(nodes.select("id", "kind", F.col("parent").alias("jump"), F.array("ord").alias("path"), F.col("attr").alias("inherited"), F.array("id").alias("seen")), "tree")
    open_, placed = rows.where("jump IS NOT NULL"), F.count_if(F.col("jump").isNull()).alias("placed")
    before = -1
    while not open_.isEmpty() and (now := rows.agg(placed).first()["placed"]) != before:
        before = now
        up = rows.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("path").alias("_path"), F.col("inherited").alias("_inherited"), F.col("seen").alias("_seen"))
        longer = open_.join(up, "jump").where(~F.arrays_overlap("seen", "_seen"))
        longer = longer.select("id", "kind", F.col("_jump").alias("jump"), F.concat("_path", "path").alias("path"), nearest.alias("inherited"), F.concat("_seen", "seen").alias("seen"))
        last, rows = rows, materialize(rows.where("jump IS NULL").unionByName(longer), "tree")
        discard(last)
        open_ = rows.where("jump IS NOT NULL")
    return rows.where("jump IS NULL").drop("seen", "jump")


def inherited(nodes: DataFrame, depth: int = 50) -> DataFrame:
    """Nodes (id, parent, attr, an array) with `inherited`: the nearest of each attribute at the node or above it, within `depth` parents at least; a cycle ends there."""
    rows = materialize(nodes.select("id", F.col("parent").alias("jump"), F.col("attr").alias("inherited")), "ancestors")
    for _ in range(depth.bit_length()):
        if rows.where("jump IS NOT NULL").isEmpty():
            break
        up = rows.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("inherited").alias("_inherited"))
        longer = rows.withColumn("_id", F.coalesce("jump", "id")).join(up, "_id", "left")
        nearest = F.when(F.col("jump").isNull() | F.col("_inherited").isNull(), F.col("inherited")).otherwise(F.zip_with("inherited", "_inherited", lambda a, b: F.coalesce(a, b)))
        last, rows = rows, materialize(longer.select("id", F.when(F.col("jump").isNotNull(), F.col("_jump")).alias("jump"), nearest.alias("inherited")), "ancestors")
        discard(last)
    return rows.drop("jump")


def reachable(edges: DataFrame, roots: DataFrame, depth: int = 100) -> DataFrame:
    """root, trail (the labels of edges from it), node, again: every way down from the roots (root, node) along edges (src, label, dst).

    A node that is on its own way from the root ends the way there (`again`), as the depth does; one recursive query does
    it, whatever the depth, and no level is a table.
    """
    spark = edges.sparkSession
    limits = {"spark.sql.cteRecursionLevelLimit": str(depth + 2), "spark.sql.cteRecursionRowLimit": "-1"}
    for name, value in limits.items():
        spark.conf.set(name, value)
    return spark.sql(
        f"""WITH RECURSIVE way(root, node, trail, seen, again) AS (
              SELECT root, node, CAST(array() AS array<string>), array(node), false FROM {{roots}}
              UNION ALL
              SELECT w.root, e.dst, concat(w.trail, array(e.label)), concat(w.seen, array(e.dst)), array_contains(w.seen, e.dst)
              FROM way w JOIN {{edges}} e ON e.src = w.node WHERE NOT w.again AND size(w.trail) < {depth})
            SELECT root, trail, node, again FROM way""",
        roots=roots,
        edges=edges,
    )


def page_window(pages: DataFrame, current: DataFrame, by: list[str], reach: int = 2, keep: int = 6) -> DataFrame:
    """Pages within `keep` of each group's current page, and whether each is to be rendered (within `reach`)."""
    away = F.abs(F.col("page_index") - F.col("current_page"))
    return pages.join(current, by).where(away <= keep).select(*by, "page_index", "current_page", (away <= reach).alias("render"))


def dense_index(items: DataFrame, by: list[str], order: str) -> DataFrame:
    """items with `span_index`, their place among the group's items."""
    return items.withColumn("span_index", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
