"""Anchors that follow their documents: a stream of text models, of which only the newer ones are anchored again.

Anchors are kept in a folder, a part for each micro-batch, with the version of the text that they were found in; those of
the highest version count. A micro-batch takes the newest model of each document in it and leaves out those that are no
newer than the document's anchors, so texts that did not move are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import anchors, geometry
from folioscan.session import materialize
from folioscan.sources.pages import text_items

RANGE = ("start_item", "start_offset", "end_item", "end_offset")
SHAPE = "doc_id long, item_id long, version int, start_item int, start_offset int, end_item int, end_offset int"


def latest(rows: DataFrame) -> DataFrame:
    """Of anchors of several versions those of each document's highest."""
    return rows.join(rows.groupBy("doc_id").agg(F.max("version").alias("version")), ["doc_id", "version"], "left_semi")


def newer(models: DataFrame, current: DataFrame) -> DataFrame:
    """The newest of models (doc_id, version, text) of each document, if it is newer than the document's anchors; one of equals."""
    top = models.groupBy("doc_id").agg(F.max("version").alias("version"))
    known = current.groupBy("doc_id").agg(F.max("version").alias("_known"))
    due = top.join(known, "doc_id", "left").where("_known IS NULL OR version > _known").drop("_known")
    return models.join(due, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id"])


def refreshed(models: DataFrame, current: DataFrame, quotes: DataFrame, recover: Callable[[DataFrame, DataFrame], DataFrame] = anchors.resolve) -> DataFrame:
    """The anchors (SHAPE) of models (doc_id, version, text) from those that their documents had: an anchor stands while its text is like its quote, and else gives way to the one that is found now, if that is better."""
    old = materialize(current.join(models.select("doc_id"), "doc_id", "left_semi").select("doc_id", "item_id", *RANGE), "old-anchors")
    new = materialize(recover(models, quotes).select("doc_id", "item_id", *RANGE), "new-anchors")
    keys = ["doc_id", "item_id"]
    shown = geometry.anchor_rects(text_items(models), old).select(*keys).distinct().withColumn("has_rects", F.lit(True))
    scored = old.select(*keys).join(anchors.scores(models, old, quotes), keys, "left").join(shown, keys, "left")
    stands = anchors.reanchor(scored.select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("has_rects", F.lit(False)).alias("has_rects")), anchors.scores(models, new, quotes))
    rows = old.join(stands.where("stands = 'current'"), keys, "left_semi").unionByName(new.join(stands.where("stands = 'recovered'"), keys, "left_semi"))
    return rows.join(models.select("doc_id", F.col("version").cast("int").alias("version")), "doc_id").select(*[c.split()[0] for c in SHAPE.split(", ")])


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The anchors in a folder that `follow` keeps."""
    spark.createDataFrame([], SHAPE).write.mode("ignore").parquet(f"{folder}/anchors/batch=-1")
    return latest(spark.read.schema(SHAPE).parquet(f"{folder}/anchors").select(*[c.split()[0] for c in SHAPE.split(", ")]))


def follow(models: DataFrame, quotes: DataFrame, folder: str, recover: Callable[[DataFrame, DataFrame], DataFrame] = anchors.resolve) -> None:
    """Anchor what a stream of models has that is new. A batch that is done again replaces its part."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        current = stored(spark, folder)
        due = materialize(newer(batch, current), "models")
        refreshed(due, materialize(current, "anchors"), quotes, recover).write.mode("overwrite").parquet(f"{folder}/anchors/batch={number}")

    models.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
