"""Files of documents and of annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANCHOR = "STRUCT<itemIndex: DOUBLE, offset: DOUBLE>"
RECT = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"
ANNOTATION = (
    f"id STRING, type STRING, color STRING, pageIndex INT, text STRING, anchorRange STRUCT<start: {ANCHOR}, end: {ANCHOR}>, textAnchor {ANCHOR},"
    f" x DOUBLE, y DOUBLE, rect {RECT}, rects ARRAY<{RECT}>, path ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, createdAt STRING"
)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, content, version and is_valid (the content begins with %PDF-) of the .pdf files below path; an empty file has no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    head = F.substring("content", 1, 8)
    valid = F.coalesce(F.substring("content", 1, 5) == F.lit(b"%PDF-"), F.lit(False))
    return files.select("path", "content", F.when(valid, F.decode(F.substring(head, 6, 3), "ISO-8859-1")).alias("version"), valid.alias("is_valid"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of JSON files, each an array of objects, in the stored form of `hydrate`."""
    rows = spark.read.schema(T.StructType.fromDDL(ANNOTATION)).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return hydrate(rows)


def _whole(value: str) -> F.Column:
    return F.col(value).isNotNull() & (F.col(value) == F.floor(value))


def hydrate(rows: DataFrame) -> DataFrame:
    """Drops highlights' anchors and notes' anchors that aren't whole item indexes, and notes' x."""
    bad = (F.col("type") == "highlight") & F.col("anchorRange.start").isNotNull() & ~_whole("anchorRange.start.itemIndex")
    note = F.col("type") == "note"
    stray = note & F.col("textAnchor").isNotNull() & ~_whole("textAnchor.itemIndex")
    return rows.withColumns({"anchorRange": F.when(~bad, F.col("anchorRange")), "x": F.when(~note, F.col("x")), "textAnchor": F.when(~stray, F.col("textAnchor"))})


def serializable(rows: DataFrame) -> DataFrame:
    """What is stored: notes without x, and without y where they have an anchor; highlights without rects where they have one."""
    note, anchored = F.col("type") == "note", (F.col("type") == "highlight") & F.col("anchorRange").isNotNull()
    drop = {"x": note, "y": note & F.col("textAnchor").isNotNull(), "rect": anchored, "rects": anchored}
    return rows.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c, when in drop.items()})


def write_annotations(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in files as Spark deals them; null fields are left out."""
    serializable(rows).write.mode("overwrite").json(path)


def annotation_arrays(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """by and `json`, what a file of each group's annotations holds: an array of objects in their order, without null fields."""
    kept = serializable(rows)
    fields = [c for c in kept.columns if c not in by and c != order]
    each = F.to_json(F.struct(*fields))
    listed = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), each.alias("j")))).alias("_a"))
    return listed.select(*by, F.concat(F.lit("["), F.array_join(F.transform("_a", lambda x: x["j"]), ","), F.lit("]")).alias("json"))
