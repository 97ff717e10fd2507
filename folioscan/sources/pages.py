"""Positioned text items of documents.

A document's lines are its items. Their geometry is synthetic: 14 units of height and 6 of width for each character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE, GLYPH, HEIGHT = 14.0, 6.0, 12.0


def text_items(docs: DataFrame) -> DataFrame:
    """doc_id, item_index, text, x, y, width, height, has_eol. Empty lines are dropped but keep their index."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    items = docs.select("doc_id", F.size(lines).alias("_n"), F.posexplode(lines).alias("item_index", "text")).where("text <> ''")
    return items.select(
        "doc_id",
        "item_index",
        "text",
        F.lit(0.0).alias("x"),
        (F.col("item_index") * LINE).alias("y"),
        (F.length("text") * GLYPH).alias("width"),
        F.lit(HEIGHT).alias("height"),
        (F.col("item_index") < F.col("_n") - 1).alias("has_eol"),
    )
