"""Rectangles of page items and highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tolerances of an intersection, in units of the page.
NEAR_X, NEAR_Y = 8.0, 4.0
#: Rectangles whose y differ by less are on one line.
LINE = 4.0


def clip(start: Column, end: Column) -> dict[str, Column]:
    """Columns of the part of an item (text, x, y, width, height) between two character offsets; null where nothing is left."""
    n = F.length("text")
    a = F.greatest(F.lit(0), F.least(n, start))
    b = F.greatest(a, F.least(n, end))
    there = (n > 0) & (F.col("width") > 0) & (F.col("height") > 0) & (b > a)
    glyph = F.col("width") / F.greatest(n, F.lit(1))
    return {
        "x": F.when(there, F.col("x") + glyph * a),
        "y": F.when(there, F.col("y")),
        "width": F.when(there, F.greatest(F.lit(1.0), glyph * (b - a))),
        "height": F.when(there, F.col("height")),
    }


def anchor_rects(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, item_id, item_index, x, y, width, height of each item in each anchor range, cut at its ends."""
    inside = anchors.join(items, "doc_id").where("item_index BETWEEN start_item AND end_item")
    a = F.when(F.col("item_index") == F.col("start_item"), F.col("start_offset")).otherwise(0)
    b = F.when(F.col("item_index") == F.col("end_item"), F.coalesce("end_offset", F.length("text"))).otherwise(F.length("text"))
    cut = clip(a, b)
    return inside.select("doc_id", "item_id", "item_index", *[c.alias(k) for k, c in cut.items()]).where("x IS NOT NULL")


def bounds(rects: DataFrame, *by: str) -> DataFrame:
    """The bounding rectangle of each group."""
    right, low = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    box = rects.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), right.alias("_r"), low.alias("_b"))
    return box.select(*by, "x", "y", (F.col("_r") - F.col("x")).alias("width"), (F.col("_b") - F.col("y")).alias("height"))


def _meeting(a: DataFrame, b: DataFrame, by: list[str], cell: float = 64.0) -> DataFrame:
    """Rows of a (*by, ax1, ay1, ax2, ay2 and others) with those of b (*by, bx1, ... and others) whose boxes overlap, edges excluded.

    Both sides are dealt to the grid cells that they touch, so a group of many boxes is joined cell by cell; each pair
    counts in the cell of its common lower corner alone.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    dealt = lambda df, p: df.withColumn("_cx", cells(f"{p}x1", f"{p}x2")).withColumn("_cy", cells(f"{p}y1", f"{p}y2"))
    both = dealt(a, "a").join(dealt(b, "b"), [*by, "_cx", "_cy"])
    hit = (F.col("ax1") < F.col("bx2")) & (F.col("ax2") > F.col("bx1")) & (F.col("ay1") < F.col("by2")) & (F.col("ay2") > F.col("by1"))
    own = (F.floor(F.greatest("ax1", "bx1") / cell) == F.col("_cx")) & (F.floor(F.greatest("ay1", "by1") / cell) == F.col("_cy"))
    return both.where(hit & own).drop("_cx", "_cy")


def _box(p: str, wide: float = 0.0, high: float = 0.0) -> list[Column]:
    """The corners of a rectangle (x, y, width, height), widened, as _meeting names them."""
    x2, y2 = F.col("x") + F.col("width") + wide, F.col("y") + F.col("height") + high
    return [(F.col("x") - wide).alias(f"{p}x1"), (F.col("y") - high).alias(f"{p}y1"), x2.alias(f"{p}x2"), y2.alias(f"{p}y2")]


def intersecting(a: DataFrame, b: DataFrame, by: list[str], ids: tuple[str, str], cell: float = 64.0) -> DataFrame:
    """Pairs of ids of rectangles of one group that intersect, b widened by the tolerances."""
    return _meeting(a.select(*by, F.col(ids[0]).alias("a_id"), *_box("a")), b.select(*by, F.col(ids[1]).alias("b_id"), *_box("b", NEAR_X, NEAR_Y)), by, cell).select(*by, "a_id", "b_id")


def merge(rects: DataFrame, by: list[str], same_y: float = 6.0, same_height: float = 8.0, gap: float = 20.0) -> DataFrame:
    """Rectangles of each group with neighbours on a line merged, in reading order: lines, which are runs of y less than LINE apart, and x.

    Each rectangle is compared with the last merged one, whose edges move: an ordered fold over a page's rectangles.
    """
    rect = "named_struct('x', r.x, 'y', r.y, 'width', r.width, 'height', r.height)"
    last = "element_at(a, -1)"
    meets = f"size(a) > 0 AND abs({last}.y - r.y) < {same_y} AND abs({last}.height - r.height) < {same_height} AND r.x <= {last}.x + {last}.width + {gap}"
    joined = (
        f"named_struct('x', least({last}.x, r.x), 'y', least({last}.y, r.y), 'width', greatest({last}.x + {last}.width, r.x + r.width) - least({last}.x, r.x),"
        f" 'height', greatest({last}.height, r.height))"
    )
    fold = f"aggregate(_r, CAST(array() AS array<struct<x: double, y: double, width: double, height: double>>), (a, r) -> CASE WHEN {meets} THEN concat(slice(a, 1, size(a) - 1), array({joined})) ELSE concat(a, array({rect})) END)"
    above = F.lag("y").over(Window.partitionBy(*by).orderBy("y"))
    lined = rects.withColumn("_new", F.coalesce((F.col("y") - above >= LINE).cast("int"), F.lit(0)))
    lined = lined.withColumn("_line", F.sum("_new").over(Window.partitionBy(*by).orderBy("y")))
    page = lined.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_line", "x", "width", "y", "height"))).alias("_r"))
    return page.select(*by, F.posexplode(F.expr(fold)).alias("line", "m")).select(*by, "line", "m.*")


def _nearest(items: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """For each point (*by, point_id, y) the item_index, distance and middle of the item whose middle is nearest in height; the first of equals.

    Items and points of a group are put in the order of height together, where the nearest is the last item before a point
    or the first one after it.
    """
    middle = F.col("y") + F.col("height") / 2
    rows = items.select(*by, F.lit(None).alias("point_id"), middle.alias("_at"), "item_index").unionByName(points.select(*by, "point_id", F.col("y").alias("_at"), F.lit(None).alias("item_index")))
    low, high = Window.partitionBy(*by).orderBy("_at"), Window.partitionBy(*by).orderBy(F.col("_at").desc())
    own = F.col("item_index").isNotNull()
    # of items at one height the one with the lowest index
    below = F.max(F.when(own, F.struct("_at", (-F.col("item_index")).alias("k")))).over(low)
    above = F.min(F.when(own, F.struct("_at", F.col("item_index").alias("k")))).over(high)
    near = rows.withColumns({"_below": below, "_above": above}).where("item_index IS NULL")
    far = lambda c, k: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._at") - F.col("_at")).alias("distance"), k.alias("item_index"), F.col(f"{c}._at").alias("middle")))
    best = F.least(far("_below", -F.col("_below.k")), far("_above", F.col("_above.k")))
    found = near.select(*by, "point_id", best.alias("_best")).where("_best IS NOT NULL").groupBy(*by, "point_id").agg(F.min("_best").alias("_best"))
    return found.select(*by, "point_id", "_best.item_index", "_best.distance", "_best.middle")


def nearest(items: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """For each point (*by, point_id, y) the item whose middle is nearest in height; the first of equals."""
    return _nearest(items, points, by).drop("middle")


def hit(rects: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """For each point (*by, point_id, px, py) the last rectangle (by seq) that holds it, edges included."""
    none = rects.where("false").select(*by, "seq", "x", "y")
    return hit_shapes(rects, none, none, points, by)


def rescale(rects: DataFrame, factor: float) -> DataFrame:
    return rects.withColumns({c: F.col(c) * factor for c in ("x", "y", "width", "height")})


def smooth(points: DataFrame, by: list[str], order: str, tension: float = 0.5) -> DataFrame:
    """Paths (x, y) with four points of a cardinal spline after each but the last; paths below three points as they are. step is 0 at the points themselves."""
    w = Window.partitionBy(*by).orderBy(order)
    n = F.count("*").over(Window.partitionBy(*by))
    near = {f"_{c}{k}": F.coalesce(F.lag(c, 1).over(w) if k == 0 else F.lead(c, k - 1).over(w), *([F.lead(c, 1).over(w)] if k == 3 else []), F.col(c)) for c in "xy" for k in (0, 2, 3)}
    full = points.withColumns({**near, "_n": n, "_last": F.lead(order, 1).over(w).isNull()})
    steps = F.when(F.col("_last") | (F.col("_n") < 3), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(4)))
    stepped = full.withColumn("step", F.explode(steps)).withColumn("_t", F.col("step") * 0.2)
    t, t2, t3 = F.col("_t"), F.col("_t") * F.col("_t"), F.col("_t") * F.col("_t") * F.col("_t")

    def at(c: str) -> Column:
        m0, m1 = tension * (F.col(f"_{c}2") - F.col(f"_{c}0")), tension * (F.col(f"_{c}3") - F.col(c))
        return (2 * t3 - 3 * t2 + 1) * F.col(c) + (t3 - 2 * t2 + t) * m0 + (3 * t2 - 2 * t3) * F.col(f"_{c}2") + (t3 - t2) * m1

    return stepped.select(*by, order, "step", F.round(at("x"), 6).alias("x"), F.round(at("y"), 6).alias("y"))


def page_size(box: Column, rotate: Column) -> dict[str, Column]:
    """width and height of a page from its box (x1, y1, x2, y2), swapped when it is turned by a quarter or three; negative turns count from the other side."""
    w, h = F.element_at(box, 3) - F.element_at(box, 1), F.element_at(box, 4) - F.element_at(box, 2)
    turned = F.pmod(F.coalesce(rotate, F.lit(0)), F.lit(360)).isin(90, 270)
    return {"width": F.when(turned, h).otherwise(w), "height": F.when(turned, w).otherwise(h)}


def offset_at(x: Column, start: bool) -> Column:
    """The character offset of an item (text, x, width) at a place: the first character that reaches it, or the first that begins beyond it. An item without a width is taken whole."""
    n, wide = F.length("text"), F.col("width") > 0
    glyph = F.when(wide, F.col("width") / F.greatest(n, F.lit(1)))
    if start:
        return F.when(wide, F.greatest(F.lit(0), F.least(n - 1, F.ceil((x - 1 - F.col("x")) / glyph) - 1))).otherwise(0).cast("int")
    return F.when(wide, F.greatest(F.lit(0), F.least(n, F.floor((x + 1 - F.col("x")) / glyph) + 1))).otherwise(n).cast("int")


def anchors_of_rects(items: DataFrame, rects: DataFrame) -> DataFrame:
    """doc_id, item_id, start_item, start_offset, end_item, end_offset of the items that rects (doc_id, item_id, x, y, width, height) touch.

    The first and the last rectangle in reading order give the offsets in the first and the last item touched.
    """
    whole = Window.partitionBy("doc_id", "item_id")
    ranked = rects.withColumns({"_top": F.col("y") < F.min("y").over(whole) + LINE, "_low": F.col("y") > F.max("y").over(whole) - LINE})
    ends = ranked.groupBy("doc_id", "item_id").agg(F.min(F.when(F.col("_top"), F.col("x"))).alias("_x1"), F.max_by(F.col("x") + F.col("width"), F.when(F.col("_low"), F.struct("x", "width"))).alias("_x2"))
    boxes = rects.select("doc_id", "item_id", *_box("a", NEAR_X, NEAR_Y))
    shown = F.struct("item_index", "text", "x", "width").alias("_item")
    touched = _meeting(boxes, items.select("doc_id", shown, *_box("b")), ["doc_id"], 512.0).groupBy("doc_id", "item_id").agg(F.min("_item").alias("s"), F.max("_item").alias("e"))
    both = touched.join(ends, ["doc_id", "item_id"])
    first = both.select("doc_id", "item_id", "_x1", "_x2", "e", "s.*").withColumnRenamed("item_index", "start_item").withColumn("start_offset", offset_at(F.col("_x1"), True))
    last = first.select("doc_id", "item_id", "start_item", "start_offset", "_x2", "e.*")
    return last.select("doc_id", "item_id", "start_item", "start_offset", F.col("item_index").alias("end_item"), offset_at(F.col("_x2"), False).alias("end_offset"))


def spans(items: DataFrame, scale: float) -> DataFrame:
    """The items that show something and have a size, at scale 1."""
    shown = (F.trim("text") != "") & (F.col("width") != 0) & (F.col("height") != 0)
    return rescale(items.where(shown), 1 / scale)


def rescale_path(paths: DataFrame, factor: float) -> DataFrame:
    """Paths (path: array of x, y) by a factor."""
    return paths.withColumn("path", F.transform("path", lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y"))))


def selected(rects: DataFrame, width: Column, height: Column) -> DataFrame:
    """Rectangles of more than one unit each way that overlap a layer of that size, edges included."""
    inside = (F.col("x") + F.col("width") >= 0) & (F.col("x") <= width) & (F.col("y") + F.col("height") >= 0) & (F.col("y") <= height)
    return rects.where((F.col("width") > 1) & (F.col("height") > 1) & inside)


def highlight_rects(anchored: DataFrame, legacy: DataFrame, by: list[str]) -> DataFrame:
    """The anchored rectangles of each highlight, or its legacy ones where it has none of those, with neighbours on a line merged."""
    names = [*by, "x", "y", "width", "height"]
    both = anchored.select(names).unionByName(legacy.join(anchored.select(by).distinct(), by, "left_anti").select(names))
    return merge(both, by).select(names)


def nearest_y(points: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """points (*by, point_id, y) with `at`: the middle of the item that is nearest in height, or their own y where there is none."""
    near = _nearest(items, points, by).select(*by, "point_id", "middle")
    return points.join(near, [*by, "point_id"], "left").withColumn("at", F.coalesce("middle", "y")).drop("middle")


def note_x(page_width: Column, canvas_width: Column) -> Column:
    """Where notes stand: in the middle of the margin right of the page, 12 off it at least; 0 without a page or canvas."""
    there = (F.coalesce(page_width, F.lit(0.0)) != 0) & (F.coalesce(canvas_width, F.lit(0.0)) != 0)
    return F.when(there, page_width + F.greatest(F.lit(12.0), (canvas_width - page_width) / 2)).otherwise(0.0)


def note_y(notes: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """notes (*by, note_id, y, item_index) with `at`: the middle of the item that a note is anchored to, else its own y, else 16."""
    middle = items.select(*by, "item_index", (F.col("y") + F.col("height") / 2).alias("_middle"))
    return notes.join(middle, [*by, "item_index"], "left").withColumn("at", F.coalesce("_middle", "y", F.lit(16.0))).drop("_middle")


def place_notes(notes: DataFrame, items: DataFrame, by: list[str], height: float) -> DataFrame:
    """Notes without an anchor get that of the nearest item, and their y is kept 16 off the page's edges."""
    free = notes.where("item_index IS NULL")
    found = nearest(items, free.select(*by, F.col("note_id").alias("point_id"), "y"), by).select(*by, F.col("point_id").alias("note_id"), F.col("item_index").alias("_near"))
    clamped = F.greatest(F.lit(16.0), F.least(F.lit(height - 16), F.col("y")))
    placed = free.drop("item_index").join(found, [*by, "note_id"], "left").withColumn("y", clamped).withColumnRenamed("_near", "item_index")
    return notes.where("item_index IS NOT NULL").unionByName(placed.select(notes.columns))


#: How far a hit may be from a note's middle and from a drawing's points, on either axis.
NOTE_HALF, POINT_NEAR = 12.0, 8.0


def hit_shapes(rects: DataFrame, notes: DataFrame, points: DataFrame, probes: DataFrame, by: list[str], cell: float = 64.0) -> DataFrame:
    """For each probe (*by, point_id, px, py) the last annotation (by seq) that it hits.

    Highlights (seq, x, y, width, height) are hit inside, edges included; notes (seq, x, y) within a box around their
    middle; drawings (seq, x, y: a row a point) near a point. All become boxes, which are dealt to grid cells.
    """
    around = lambda df, d: df.select(*by, "seq", (F.col("x") - d).alias("x1"), (F.col("y") - d).alias("y1"), (F.col("x") + d).alias("x2"), (F.col("y") + d).alias("y2"))
    boxes = rects.select(*by, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"))
    boxes = boxes.unionByName(around(notes, NOTE_HALF)).unionByName(around(points, POINT_NEAR))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    dealt = boxes.withColumn("_cx", cells("x1", "x2")).withColumn("_cy", cells("y1", "y2"))
    asked = probes.withColumns({"_cx": F.floor(F.col("px") / cell), "_cy": F.floor(F.col("py") / cell)})
    inside = F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2"))
    return asked.join(dealt, [*by, "_cx", "_cy"]).where(inside).groupBy(*by, "point_id").agg(F.max("seq").alias("seq"))


def box_selection(items: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """For each box (*by, box_id, x1, y1, x2, y2: any two corners) the bounds of the items that it overlaps and their text, or the box itself and no text."""
    low = {f"_{c}": F.least(f"{c}1", f"{c}2") for c in "xy"}
    high = {f"_{c}{c}": F.greatest(f"{c}1", f"{c}2") for c in "xy"}
    asked = boxes.select(*by, "box_id", *[v.alias(k) for k, v in (low | high).items()])
    mine = asked.select(*by, "box_id", F.col("_x").alias("ax1"), F.col("_y").alias("ay1"), F.col("_xx").alias("ax2"), F.col("_yy").alias("ay2"))
    found = _meeting(mine, items.select(*by, "item_index", "text", *_box("b")), by).groupBy(*by, "box_id").agg(
        F.min("bx1").alias("fx"), F.min("by1").alias("fy"), F.max("bx2").alias("fr"), F.max("by2").alias("fb"), F.array_sort(F.collect_list(F.struct("item_index", "text"))).alias("t")
    )
    text = F.array_join(F.transform("t", lambda t: t["text"]), " ")
    x, y = F.coalesce("fx", "_x"), F.coalesce("fy", "_y")
    return asked.join(found, [*by, "box_id"], "left").select(*by, "box_id", x.alias("x"), y.alias("y"), (F.coalesce("fr", "_xx") - x).alias("width"), (F.coalesce("fb", "_yy") - y).alias("height"), text.alias("text"))


def drawing_bounds(points: DataFrame, *by: str) -> DataFrame:
    """The bounding rectangle and the number of points of each drawing of two points at least."""
    boxes = points.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"), F.count("*").alias("n_points"))
    return boxes.where("n_points >= 2")


def image_bounds(images: DataFrame, width: float, height: float) -> DataFrame:
    """image_id, x, y, width, height in whole pixels of images given by three corners (x1, y1 .. x3, y3) as shares of a canvas; empty ones go."""
    side = lambda c, size: (F.greatest(F.lit(0), F.floor(F.least(*[F.col(f"{c}{k}") * size for k in (1, 2, 3)]))), F.least(F.lit(size).cast("long"), F.ceil(F.greatest(*[F.col(f"{c}{k}") * size for k in (1, 2, 3)]))))
    (x1, x2), (y1, y2) = side("x", width), side("y", height)
    return images.select("image_id", x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height")).where("width > 0 AND height > 0")


def current_page(pages: DataFrame, middle: Column) -> DataFrame:
    """view_id and the first page (view_id, page_index, top, bottom) that spans the middle of the view."""
    return pages.where((F.col("top") < middle) & (F.col("bottom") > middle)).groupBy("view_id").agg(F.min("page_index").alias("page_index"))


def selection_anchor(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """The anchor of each selection (doc_id, item_id, from_item, from_offset, to_item, to_offset) from the items with text that it touches: offsets within the first and the last of them."""
    inside = ranges.join(items.where("text <> ''"), "doc_id").where("item_index BETWEEN from_item AND to_item")
    a = F.when(F.col("item_index") == F.col("from_item"), F.least("from_offset", F.length("text"))).otherwise(0)
    b = F.when(F.col("item_index") == F.col("to_item"), F.least("to_offset", F.length("text"))).otherwise(F.length("text"))
    segments = inside.select("doc_id", "item_id", "item_index", a.alias("a"), b.alias("b")).where("b > a")
    return segments.groupBy("doc_id", "item_id").agg(
        F.min("item_index").alias("start_item"), F.min_by("a", "item_index").alias("start_offset"), F.max("item_index").alias("end_item"), F.max_by("b", "item_index").alias("end_offset")
    )
