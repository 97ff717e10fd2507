"""The library's queries over the given tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions import codecs, colors
from folioscan.functions import text as T
from folioscan.operators import anchors, annotations, geometry, graph
from folioscan.session import materialize, table
from folioscan.sources import files, pdf, xref
from folioscan.sources.pages import text_items
from folioscan.streaming import changes


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return text_items(table(spark, sf, "documents"))


def text_items_(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf)


def text_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("doc_id", "item_index", T.normalize(F.col("text")).alias("normalized"))


def text_compact(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("doc_id", "item_index", T.compact(F.col("text")).alias("compact"), T.compact_chars(F.col("text")).alias("compact_chars"))


def span_index(spark: SparkSession, sf: str) -> DataFrame:
    shown = _items(spark, sf).where(T.normalize(F.col("text")) != "")
    return graph.dense_index(shown.select("doc_id", "item_index"), ["doc_id"], "item_index")


def _anchors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, quotes = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return docs, quotes, materialize(anchors.exact(docs, quotes), "anchors")


def anchor_exact(spark: SparkSession, sf: str) -> DataFrame:
    return anchors.exact(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def anchor_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return anchors.normalized(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def anchor_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return anchors.fuzzy(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def anchor_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return anchors.resolve(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def anchor_text(spark: SparkSession, sf: str) -> DataFrame:
    docs, _, found = _anchors(spark, sf)
    return anchors.range_text(docs, found)


def anchor_score(spark: SparkSession, sf: str) -> DataFrame:
    docs, quotes, found = _anchors(spark, sf)
    return anchors.scores(docs, found, quotes)


def anchor_rects(spark: SparkSession, sf: str) -> DataFrame:
    docs, _, found = _anchors(spark, sf)
    rects = geometry.anchor_rects(text_items(docs), found)
    return rects.select("doc_id", "item_id", "item_index", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


def anchor_from_rects(spark: SparkSession, sf: str) -> DataFrame:
    docs, _, found = _anchors(spark, sf)
    items = text_items(docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi"))
    return geometry.anchors_of_rects(items, geometry.anchor_rects(items, found))


def _rects(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles of a page for each order; the geometry is synthetic."""
    line = F.col("l_linenumber").cast("long")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", line.alias("seq"), (F.col("l_quantity") * 10).alias("x"), (line % 3 * 14).cast("double").alias("y"), (F.col("l_partkey") % 40 + 1).cast("double").alias("width"), F.lit(12.0).alias("height")
    )


def rect_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.bounds(_rects(spark, sf), "l_orderkey")


def rect_intersections(spark: SparkSession, sf: str) -> DataFrame:
    rects = _rects(spark, sf)
    return geometry.intersecting(rects, rects, ["l_orderkey"], ("seq", "seq")).where("a_id < b_id")


def rect_merge(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.merge(_rects(spark, sf), ["l_orderkey"]).select("l_orderkey", F.col("line").cast("long").alias("line"), "x", "y", "width", "height")


def nearest_item(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("point_id"), (F.col("o_custkey") % 50).cast("double").alias("y"))
    return geometry.nearest(_rects(spark, sf).withColumnRenamed("seq", "item_index"), points, ["l_orderkey"])


def hit_test(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    points = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("point_id"), (F.col("o_custkey") % 500).cast("double").alias("px"), (F.col("o_custkey") % 40).cast("double").alias("py"))
    return geometry.hit(_rects(spark, sf), points, ["l_orderkey"])


def path_smooth(spark: SparkSession, sf: str) -> DataFrame:
    points = _rects(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("seq", "x", "width")).cast("long"))
    return geometry.smooth(points.select("l_orderkey", "k", "x", "y"), ["l_orderkey"], "k").withColumn("step", F.col("step").cast("long"))


def _annotations(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "highlight").when(F.col("event_type") == "purchase", "note").otherwise("drawing")
    text = F.when(F.col("event_id") % 5 > 0, F.concat_ws(" ", "event_type", "props"))
    return table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), kind.alias("type"), (F.col("user_id") % 10).alias("page_index"), text.alias("text"), F.col("event_id").alias("seq"))


def ann_titles(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.titled(_annotations(spark, sf)).select("id", "title", "preview")


def ann_list(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.listed(_annotations(spark, sf)).select("place", "id", "page_index", "type")


def ann_by_page(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.by_page(_annotations(spark, sf))


def ann_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh annotation is edited, every eleventh removed, and every thirteenth copied, in this order."""
    rows = _annotations(spark, sf)
    edited = annotations.update(rows, rows.where("seq % 7 = 0").withColumn("text", F.lit("edited")))
    left = annotations.remove(edited, rows.where("seq % 11 = 0"))
    return annotations.add(left, rows.where("seq % 13 = 0").withColumn("id", F.concat("id", F.lit("-copy"))))


def ann_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations as they are stored and read again: which fields are left."""
    anchor = lambda i: F.struct(i.cast("double").alias("itemIndex"), F.lit(0.0).alias("offset"))
    place = F.when(F.col("seq") % 3 == 0, F.lit(0.5)).otherwise(F.lit(4.0))
    rows = _annotations(spark, sf).withColumns(
        {
            "anchorRange": F.when(F.col("seq") % 2 == 0, F.struct(anchor(place).alias("start"), anchor(F.lit(5)).alias("end"))),
            "textAnchor": F.when(F.col("seq") % 2 == 0, anchor(place)),
            "x": F.lit(1.0),
            "y": F.lit(2.0),
            "rect": F.struct(F.lit(1.0).alias("x")),
            "rects": F.array(F.struct(F.lit(1.0).alias("x"))),
        }
    )
    back = files.hydrate(files.serializable(rows))
    return back.select("id", "x", "y", *[F.col(c).isNotNull().alias(f"has_{c}") for c in ("anchorRange", "textAnchor", "rect", "rects")])


def ann_colors(spark: SparkSession, sf: str) -> DataFrame:
    color = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("event_id") * 7919 % 16777216), 6, "0")))
    rows = table(spark, sf, "events").select("event_id", color.alias("color"))
    parts = F.when(F.col("event_id") % 3 == 0, F.array(F.col("event_id") % 5 / 4)).otherwise(F.array(*[(F.col("event_id") % k) / k for k in (3, 5, 7)]))
    return rows.select("event_id", colors.rgba(F.col("color"), 0.35).alias("rgba"), colors.brightened(F.col("color"), 24).alias("bright"), colors.css(parts).alias("css"))


def page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.col("p_retailprice"))
    size = geometry.page_size(box, (F.col("p_partkey") % 5 - 1) * 90)
    return table(spark, sf, "part").select("p_partkey", *[c.alias(k) for k, c in size.items()])


def _replayed(log: DataFrame) -> DataFrame:
    return annotations.replay(log).select("id", F.col("born_seq.event_id").alias("born"), F.col("seq.event_id").alias("last"), "state", "n_updates")


def history_replay(spark: SparkSession, sf: str) -> DataFrame:
    return _replayed(changes.change_log(table(spark, sf, "events")))


def history_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _replayed(changes.ingest(spark, sf))


def xref_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("d"), (-F.col("o_orderkey")).alias("k"))
    entries = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", rank.alias("rank"))
    return graph.first_wins(entries, ["o_custkey"], "rank").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != "F").alias("in_use"))


def ref_resolve(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return graph.resolve(refs, xref_first_wins(spark, sf), "o_custkey")


def tree_flatten(spark: SparkSession, sf: str) -> DataFrame:
    node = lambda t, kind, key, parent, attr: t.select(
        F.concat(F.lit(kind[0]), F.col(key)).alias("id"), parent.cast("string").alias("parent"), F.col(key).cast("long").alias("ord"), F.lit(kind).alias("kind"), attr.cast("string").alias("attr")
    )
    regions = node(table(spark, sf, "region"), "region", "r_regionkey", F.lit(None), F.col("r_name"))
    nations = node(table(spark, sf, "nation"), "nation", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    customers = node(table(spark, sf, "customer"), "customer", "c_custkey", F.concat(F.lit("n"), "c_nationkey"), F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")))
    flat = graph.flatten(regions.unionByName(nations).unionByName(customers))
    return flat.select("id", "kind", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "inherited")


def page_window(spark: SparkSession, sf: str) -> DataFrame:
    pages = _items(spark, sf).select("doc_id", F.col("item_index").cast("long").alias("page_index"))
    current = pages.groupBy("doc_id").agg(F.floor(F.max("page_index") / 2).alias("current_page"))
    return graph.page_window(pages, current, ["doc_id"])


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' lines, written as page files and read back from them."""
    back = pdf.read_text(pdf.write_pages(table(spark, sf, "documents")))
    return back.select(F.col("path").cast("long").alias("doc_id"), "seq", "text", "x", "y")


def page_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The objects of the documents' page files."""
    found = pdf.objects(pdf.write_pages(table(spark, sf, "documents")), streams=False)
    return found.select(F.col("path").cast("long").alias("doc_id"), "obj", "gen", F.col("stream").isNotNull().alias("has_stream"))


def page_operators(spark: SparkSession, sf: str) -> DataFrame:
    """The content operators of the documents' page files."""
    found, named = xref.tables(pdf.write_pages(table(spark, sf, "documents")))
    ops = pdf.content_ops(pdf.page_contents(found, pdf.pages(found, named)))
    return ops.select(F.col("path").cast("long").alias("doc_id"), "seq", "op", F.size("args").alias("n_args"))


def page_text_mapped(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' lines, written in codes of two bytes and read back through the fonts' maps to Unicode."""
    return pdf.read_text(pdf.write_pages(table(spark, sf, "documents"), mapped=True)).select(F.col("path").cast("long").alias("doc_id"), "seq", "text")


def _payload(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


def codec_hex(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(_payload(spark, sf).withColumn("data", codecs.hex_decode(codecs.hex_encode(F.col("data")))))


def _round_trip(encode, decode):
    return lambda spark, sf: _digest(codecs.apply(_payload(spark, sf), "data", [encode, decode]))


def codec_png(spark: SparkSession, sf: str) -> DataFrame:
    sized = _payload(spark, sf).withColumn("n", F.octet_length("data"))
    back = codecs.apply(sized, "data", [lambda x: codecs.png_encode(x, 64), lambda x: codecs.png_decode(x, 64)])
    return _digest(back.select("doc_id", F.expr("substring(data, 1, n)").alias("data")))

def _uneven(spark: SparkSession, sf: str) -> DataFrame:
    """The same rectangles, with y off by 1.5 for half of them."""
    return _rects(spark, sf).withColumn("y", F.col("y") + (F.col("width") - 1) % 2 * 1.5)


def rect_merge_uneven(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.merge(_uneven(spark, sf), ["l_orderkey"]).select("l_orderkey", F.col("line").cast("long").alias("line"), "x", "y", "width", "height")


def rect_merge_selection(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.merge(_uneven(spark, sf), ["l_orderkey"], 4.0, 6.0, 6.0).select("l_orderkey", F.col("line").cast("long").alias("line"), "x", "y", "width", "height")


def rect_selected(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.selected(_rects(spark, sf), F.lit(250.0), F.lit(14.0)).select("l_orderkey", "seq", "x", "y", "width", "height")


def rect_rescaled(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.rescale(_rects(spark, sf), 1.5)


def path_rescaled(spark: SparkSession, sf: str) -> DataFrame:
    paths = _rects(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "width"))).alias("p"))
    paths = paths.select("l_orderkey", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path"))
    return geometry.rescale_path(paths, 0.25).select("l_orderkey", F.posexplode("path").alias("k", "p")).select("l_orderkey", F.col("k").cast("long").alias("k"), "p.x", "p.y")


def text_spans(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.spans(_items(spark, sf), 1.5).select("doc_id", "item_index", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


def highlight_rects(spark: SparkSession, sf: str) -> DataFrame:
    rects = _rects(spark, sf)
    return geometry.highlight_rects(rects.where("l_orderkey % 3 = 0 AND width > 20"), rects.where("width <= 20"), ["l_orderkey"])


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_custkey")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), key.alias("note_id"), (key % 60).cast("double").alias("y"), F.when(key % 4 > 0, key % 9).alias("item_index"))


def note_y(spark: SparkSession, sf: str) -> DataFrame:
    items = _rects(spark, sf).withColumnRenamed("seq", "item_index")
    return geometry.note_y(_notes(spark, sf), items, ["l_orderkey"]).select("l_orderkey", "note_id", "at")


def note_placed(spark: SparkSession, sf: str) -> DataFrame:
    items = _rects(spark, sf).withColumnRenamed("seq", "item_index")
    return geometry.place_notes(_notes(spark, sf), items, ["l_orderkey"], 50.0).select("l_orderkey", "note_id", "y", "item_index")


def hit_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Highlights, notes and drawings by the line's number modulo 3."""
    rects = _rects(spark, sf)
    probes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("point_id"), (F.col("o_custkey") % 500).cast("double").alias("px"), (F.col("o_custkey") % 40).cast("double").alias("py"))
    return geometry.hit_shapes(rects.where("seq % 3 = 0"), rects.where("seq % 3 = 1"), rects.where("seq % 3 = 2"), probes, ["l_orderkey"])


def box_selection(spark: SparkSession, sf: str) -> DataFrame:
    items = _rects(spark, sf).withColumn("text", F.concat(F.lit("w"), F.col("seq"))).withColumnRenamed("seq", "item_index")
    key = F.col("o_custkey")
    boxes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), key.alias("box_id"), (key % 500).cast("double").alias("x1"), F.lit(30.0).alias("y1"), (key % 300).cast("double").alias("x2"), (key % 20).cast("double").alias("y2"))
    return geometry.box_selection(items, boxes, ["l_orderkey"])


def drawing_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.drawing_bounds(_rects(spark, sf), "l_orderkey")


def image_bounds(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda k, n: (F.col("p_partkey") * k % n) / n
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), *[(part(k + 3 * i, 16) - 0.125).alias(f"{c}{k}") for i, c in enumerate("xy") for k in (1, 2, 3)])
    return geometry.image_bounds(images, 640.0, 480.0)


def current_page(spark: SparkSession, sf: str) -> DataFrame:
    views = table(spark, sf, "orders").select(F.col("o_orderkey").alias("view_id"), (F.col("o_custkey") % 900).cast("double").alias("scroll"))
    pages = views.withColumn("page_index", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("view_id", "page_index", (F.col("page_index") * 300 - F.col("scroll")).alias("top"), (F.col("page_index") * 300 + 290 - F.col("scroll")).alias("bottom"))
    return geometry.current_page(pages, F.lit(200.0))


def selection_anchor(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    key = F.coalesce("doc_id", F.lit(0))
    ranges = docs.select("doc_id", F.lit(0).alias("item_id"), (key % 3).cast("int").alias("from_item"), (key % 7).cast("int").alias("from_offset"), (key % 3 + key % 5).cast("int").alias("to_item"), (key % 11).cast("int").alias("to_offset"))
    return geometry.selection_anchor(text_items(docs), ranges)


def ann_page_replaced(spark: SparkSession, sf: str) -> DataFrame:
    rows = _annotations(spark, sf)
    return annotations.replace_page(rows, 3, rows.where("seq % 2 = 0").withColumn("text", F.lit("new")))


def ann_page_lists(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.page_lists(_annotations(spark, sf)).select("page_index", F.array_join("ids", ",").alias("ids"))


def ann_preview(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.preview(_annotations(spark, sf).withColumn("n_points", F.col("seq") % 40))


def ann_notes_made(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "events").select((F.col("user_id") % 10).alias("page_index"), (F.col("event_id") % 600).alias("x"), (F.col("event_id") % 800).alias("y"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("created_at"))
    return annotations.new_notes(places, "#FFEB3B").select("id", "type", "color", "page_index", "x", "y", "text")


def ann_catalog(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Red", "Green", "Pink", "Thick")])
    rows = _annotations(spark, sf).select("id", F.when(F.col("seq") % 10 == 0, "width").otherwise(F.col("type")).alias("type"), names[(F.col("seq") % 4).cast("int")].alias("color_name"))
    return annotations.with_catalog_color(rows)


def history_entries(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.history_entries(changes.change_log(table(spark, sf, "events"))).select("id", F.col("seq.event_id").alias("event_id"), "before", "after")


def history_undone(spark: SparkSession, sf: str) -> DataFrame:
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("change")
    return annotations.undone(table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.struct("ts", "event_id").alias("seq"), action.alias("action"), F.col("event_id").alias("change")))


def session_latest(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.latest_epoch(table(spark, sf, "events").select("user_id", (F.col("event_id") % 4).alias("epoch"), "event_id"), ["user_id"])


def render_changed(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.changed_renders(table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("render_key")), ["user_id"], "event_id")


def anchor_stands(spark: SparkSession, sf: str) -> DataFrame:
    """Which anchor is to stand, where the current one is from quotes that miss their end and the recovered one is exact."""
    docs, quotes, found = _anchors(spark, sf)
    current = anchors.scores(docs, found.withColumn("end_item", F.greatest("start_item", F.col("end_item") - F.col("item_id") % 3)), quotes).withColumn("has_rects", F.col("item_id") % 5 > 0)
    return anchors.reanchor(current, anchors.scores(docs, found, quotes))



QUERIES = {
    "text_items": text_items_,
    "text_normalized": text_normalized,
    "text_compact": text_compact,
    "span_index": span_index,
    "anchor_exact": anchor_exact,
    "anchor_normalized": anchor_normalized,
    "anchor_fuzzy": anchor_fuzzy,
    "anchor_resolved": anchor_resolved,
    "anchor_text": anchor_text,
    "anchor_score": anchor_score,
    "anchor_rects": anchor_rects,
    "anchor_from_rects": anchor_from_rects,
    "page_sizes": page_sizes,
    "ann_colors": ann_colors,
    "rect_bounds": rect_bounds,
    "rect_intersections": rect_intersections,
    "rect_merge": rect_merge,
    "nearest_item": nearest_item,
    "hit_test": hit_test,
    "path_smooth": path_smooth,
    "ann_titles": ann_titles,
    "ann_list": ann_list,
    "ann_by_page": ann_by_page,
    "ann_edited": ann_edited,
    "ann_stored": ann_stored,
    "history_replay": history_replay,
    "history_stream": history_stream,
    "xref_first_wins": xref_first_wins,
    "ref_resolve": ref_resolve,
    "tree_flatten": tree_flatten,
    "page_window": page_window,
    "page_objects": page_objects,
    "page_operators": page_operators,
    "page_text": page_text,
    "page_text_mapped": page_text_mapped,
    "codec_hex": codec_hex,
    "codec_ascii85": _round_trip(codecs.a85_encode, codecs.a85_decode),
    "codec_run_length": _round_trip(codecs.rle_encode, codecs.rle_decode),
    "codec_lzw": _round_trip(codecs.lzw_encode, codecs.lzw_decode),
    "codec_flate": _round_trip(zlib.compress, codecs.flate_decode),
    "codec_png": codec_png,
    "rect_merge_uneven": rect_merge_uneven,
    "rect_merge_selection": rect_merge_selection,
    "rect_selected": rect_selected,
    "rect_rescaled": rect_rescaled,
    "path_rescaled": path_rescaled,
    "text_spans": text_spans,
    "highlight_rects": highlight_rects,
    "note_y": note_y,
    "note_placed": note_placed,
    "hit_shapes": hit_shapes,
    "box_selection": box_selection,
    "drawing_bounds": drawing_bounds,
    "image_bounds": image_bounds,
    "current_page": current_page,
    "selection_anchor": selection_anchor,
    "ann_page_replaced": ann_page_replaced,
    "ann_page_lists": ann_page_lists,
    "ann_preview": ann_preview,
    "ann_notes_made": ann_notes_made,
    "ann_catalog": ann_catalog,
    "history_entries": history_entries,
    "history_undone": history_undone,
    "session_latest": session_latest,
    "render_changed": render_changed,
    "anchor_stands": anchor_stands,
}
