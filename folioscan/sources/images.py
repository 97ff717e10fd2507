"""Images of page files: their colour spaces, resolved by joins, and their pixels as RGBA, whole arrays at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.sources import content, values, xref

#: Encodings that are left to a reader of pictures, by the first filter.
ENCODED = {"DCTDecode": "image/jpeg", "JPXDecode": "image/jp2"}
COMPONENTS = {"gray": 1, "rgb": 3, "cmyk": 4, "indexed": 1}


def _mode(space: str, profile: str) -> F.Column:
    """gray, rgb or cmyk of a device's space, or of as many components as a profile says; rgb for any other."""
    named = F.coalesce(values.name(F.col(space), "$", None), values.name(F.col(space), "$[0]", None))
    n = values.number(F.col(profile), "$.N", 3.0)
    based = named == "ICCBased"
    return F.when((named == "DeviceGray") | (based & (n == 1)), "gray").when((named == "DeviceCMYK") | (based & (n == 4)), "cmyk").otherwise("rgb")


def described(found: DataFrame) -> DataFrame:
    """path, obj, width, height, bits, filters, encoded (a media type; null if it is no encoding of its own), mode, base (the mode of an indexed image's palette), palette, value, data of the images among found objects."""
    v = F.col("value")
    own = found.where(F.col("stream").isNotNull() & (values.name(v, "$.Subtype") == "Image")).select("path", "obj", "value", F.col("stream").alias("data"), values.at(v, "$.ColorSpace").alias("space"))
    own = content.followed(own, found, "space")
    own = content.followed(own.withColumn("second", values.at(F.col("space"), "$[1]")).withColumn("profile", F.col("second")), found, "profile")
    # of an indexed space the second item is another space, whose second item may be a profile
    own = content.followed(own.withColumn("inner", values.at(F.col("profile"), "$[1]")), found, "inner")
    own = own.withColumn("lookup_to", values.ref(F.col("space"), "$[3]")).withColumn("lookup", values.at(F.col("space"), "$[3]"))
    own = content.followed(own, found, "lookup")
    tables = found.where("stream IS NOT NULL").join(own.select("path", F.col("lookup_to").alias("obj")).where("obj IS NOT NULL").distinct(), ["path", "obj"], "left_semi")
    told = xref.decoded(tables.select("path", F.col("obj").alias("lookup_to"), "value", F.col("stream").alias("data"))).select("path", "lookup_to", F.col("data").alias("table"))
    own = own.join(told, ["path", "lookup_to"], "left")
    text = values.string(F.col("lookup"), "$", None)
    palette = F.coalesce("table", F.encode(text, "ISO-8859-1"))
    indexed = (values.name(F.col("space"), "$[0]") == "Indexed") & palette.isNotNull()
    nested = values.name(F.col("profile"), "$[0]") == "Indexed"
    filters = F.transform(F.when(values.name(v, "$.Filter", None).isNotNull(), F.array(values.at(v, "$.Filter"))).otherwise(values.array(v, "$.Filter")), lambda x: values.name(x, "$"))
    whole = lambda k, default=0.0: values.number(v, f"$.{k}", default).cast("int")
    return own.select(
        "path", "obj", whole("Width").alias("width"), whole("Height").alias("height"), whole("BitsPerComponent", 8.0).alias("bits"), filters.alias("filters"),
        F.create_map(*[F.lit(x) for pair in ENCODED.items() for x in pair])[F.get(filters, F.lit(0))].alias("encoded"), F.when(indexed, "indexed").otherwise(_mode("space", "profile")).alias("mode"),
        F.when(indexed, F.when(nested, "gray").otherwise(_mode("profile", "inner"))).alias("base"), F.when(indexed, palette).alias("palette"), "value", "data",
    )


def rgba(data: bytes, width: int, height: int, mode: str, base: str | None = None, palette: bytes | None = None) -> bytes | None:
    """Pixels as red, green, blue and alpha; null where the data is too short. A palette's missing entries are 0; one of four components gives its first three."""
    n, k = width * height, COMPONENTS[mode]
    if width <= 0 or height <= 0 or len(data) < n * k:
        return None
    pixels = np.frombuffer(data, np.uint8, n * k).reshape(n, k)
    if mode == "indexed":
        of = COMPONENTS[base or "rgb"]
        table = np.zeros(256 * of, np.uint8)
        known = np.frombuffer(palette or b"", np.uint8)[: len(table)]
        table[: len(known)] = known
        pixels = table.reshape(256, of)[pixels[:, 0]]
    out = np.full((n, 4), 255, np.uint8)
    if mode == "cmyk":
        ink = 1 - pixels.astype(np.float64) / 255
        out[:, :3] = np.floor(255 * ink[:, :3] * ink[:, 3:] + 0.5)
    else:
        out[:, :3] = pixels[:, :3]
    return out.tobytes()


def pixels(described_: DataFrame) -> DataFrame:
    """path, obj, rgba, problem of described images of 8 bits; the problem says why there is no rgba, or which filter failed, after which the data counts as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, why = [], []
            for tree, data, width, height, bits, encoded, mode, base, palette in zip(*(batch.column(k).to_pylist() for k in range(2, 11)), strict=True):
                plain, problem = (None, f"encoded as {encoded}") if encoded else xref.filtered(json.loads(tree), data)
                if plain is not None and bits != 8:
                    plain, problem = None, f"{bits} bits"
                own = None if plain is None else rgba(plain, width, height, mode, base, palette)
                out.append(own)
                why.append(problem or ("too short" if own is None else None))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(why, pa.string())], names=["path", "obj", "rgba", "problem"])

    rows = described_.select("path", "obj", F.to_json("value").alias("tree"), "data", "width", "height", "bits", "encoded", "mode", "base", "palette")
    return rows.mapInArrow(run, "path string, obj long, rgba binary, problem string")


def placed(rows: DataFrame, of: DataFrame, found: DataFrame) -> DataFrame:
    """path, page_index, seq, obj, x, y, width, height, matrix of the images that the pages `of` found objects place themselves, of page rows; an image is the unit square of its place."""
    names = content.named_resources(of.select("path", "page_index", "resources"), found, "XObject")
    own = names.where(values.name(F.col("value"), "$.Subtype") == "Image").select("path", "page_index", F.col("name").alias("text"), "obj")
    return rows.where("kind = 'placed'").join(own, ["path", "page_index", "text"]).select("path", "page_index", "seq", "obj", "x", "y", "width", "height", "matrix")
