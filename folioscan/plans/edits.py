"""Queries of edits that meet several rows of an id, history, notes, and anchors that follow their documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import anchors, annotations, geometry
from folioscan.plans import oracles
from folioscan.plans.queries import _annotations, _rects
from folioscan.session import shared_dir, table
from folioscan.sources import files
from folioscan.streaming import refresh


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of web pages, whose ends are made carriage returns, line feeds and both by turns."""
    ended = F.regexp_replace(F.regexp_replace("html", "></", ">\r\n</"), "<p>", "\r<p>")
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(T.lines(ended)).alias("k", "line"))
    return rows.select("page_id", "k", F.length("line").alias("n_chars"), F.md5(F.col("line").cast("binary")).alias("digest"))


def _twins(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations whose ids are of two or three rows each."""
    return _annotations(spark, sf).withColumn("id", F.concat(F.lit("i"), F.floor(F.col("seq") / 3)))


def ann_first_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal ids the first is edited, in its place, and then the first removed."""
    rows = _twins(spark, sf)
    ids = rows.select("id", F.substring("id", 2, 20).cast("long").alias("n")).distinct()
    changed = rows.join(ids.where("n % 4 = 1").select("id"), "id", "left_semi").dropDuplicates(["id"]).withColumns({"text": F.lit("edited"), "seq": F.lit(-1).cast("long"), "page_index": F.lit(0).cast("long"), "type": F.lit("note")})
    gone = ids.where("n % 6 = 1").select("id").unionByName(spark.createDataFrame([("none",)], "id string"))
    return annotations.remove(annotations.update(rows, changed), gone).select("id", "seq", "type", "page_index", "text")


def history_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's annotations after additions, updates, removals, undos and redos."""
    kinds = {"signup": "add", "click": "update", "purchase": "remove", "error": "undo", "view": "redo"}
    action = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    log = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.struct("ts", "event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 5).alias("id"), F.col("value").alias("state"))
    return annotations.restored(log.where("action IS NOT NULL"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_custkey")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), key.alias("point_id"), (key % 60).cast("double").alias("y"), key)


def note_nearest_y(spark: SparkSession, sf: str) -> DataFrame:
    items = _rects(spark, sf).where("width > 10").withColumnRenamed("seq", "item_index")
    return geometry.nearest_y(_points(spark, sf).drop("o_custkey"), items, ["l_orderkey"]).select("l_orderkey", "point_id", "at")


def hit_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Probes of notes that stand in the margin, at the height of the item that they are anchored to."""
    items = _rects(spark, sf).withColumnRenamed("seq", "item_index")
    notes = items.where("item_index % 2 = 0").select("l_orderkey", F.col("item_index").alias("seq"), F.col("item_index").alias("note_id"), F.lit(5.0).alias("y"), (F.col("item_index") - 1).cast("long").alias("item_index"))
    placed = geometry.note_y(notes, items, ["l_orderkey"]).select("l_orderkey", "seq", geometry.note_x(F.lit(300.0), F.lit(380.0)).alias("x"), F.col("at").alias("y"))
    none = placed.where("false")
    probes = _points(spark, sf).select("l_orderkey", "point_id", (F.col("o_custkey") % 40 + 320).cast("double").alias("px"), F.col("y").alias("py"))
    return geometry.hit_shapes(none.select("l_orderkey", "seq", "x", "y", F.lit(0.0).alias("width"), F.lit(0.0).alias("height")), placed, none, probes, ["l_orderkey"])


def anchor_refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors after a stream of texts in which every third document comes a second time, with two lines before it."""
    folder = f"{shared_dir(spark)}/folioscan/refresh-{uuid.uuid4().hex}"
    docs, quotes = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("version"), "text")
    second = docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(2).alias("version"), F.concat(F.lit("***\n---\n"), F.coalesce("text", F.lit(""))).alias("text"))
    for models in (first, second):
        models.write.mode("append").parquet(f"{folder}/models")
        refresh.follow(spark.readStream.schema(first.schema).parquet(f"{folder}/models"), quotes, folder, anchors.exact)
    return refresh.stored(spark, folder)


def ann_added(spark: SparkSession, sf: str) -> DataFrame:
    """Notes and highlights as they are added to pages."""
    items = _rects(spark, sf).withColumnRenamed("seq", "item_index")
    key = F.col("o_custkey")
    new = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), key.cast("string").alias("id"), F.when(key % 2 == 0, "note").otherwise("highlight").alias("type"), (key % 60).cast("double").alias("y"), F.when(key % 3 == 0, key % 5).alias("item_index"), F.array(F.struct(F.lit(1.0).alias("x"))).alias("rects")
    )
    return annotations.anchored(new, items, ["l_orderkey"]).select("l_orderkey", "id", "type", "item_index", F.col("rects").isNotNull().alias("has_rects"))


def ann_json(spark: SparkSession, sf: str) -> DataFrame:
    """The annotations of each page as a stored array."""
    rows = _annotations(spark, sf).select("id", "type", "page_index", F.regexp_replace("text", r'[^a-z0-9 ]', "").alias("text"), "seq")
    whole = rows.withColumns({"textAnchor": F.lit(None).cast("struct<itemIndex: double>"), "anchorRange": F.lit(None).cast("struct<start: double>"), **{c: F.lit(None).cast("double") for c in ("x", "y", "rect", "rects")}})
    stored = files.annotation_arrays(whole, ["page_index"], "seq")
    return stored.select("page_index", F.length("json").cast("long").alias("n_chars"), F.md5(F.col("json").cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (ann_added, ann_json, text_lines, ann_first_edited, history_restored, note_nearest_y, hit_notes, anchor_refreshed)}

_NEW = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '***' || chr(10) || '---' || chr(10) || coalesce(text, '') ELSE text END AS text FROM documents)"
_SHIFTED = oracles._EXACT.replace("FROM documents", f"FROM {_NEW}").replace("x AS MATERIALIZED", "w AS MATERIALIZED")
ORACLES = {
    "ann_added": f"""WITH {oracles._RECTS}, n AS (SELECT o_orderkey AS l_orderkey, o_custkey::VARCHAR AS id, o_custkey % 2 = 0 AS note, o_custkey % 60 AS y, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 5 END AS item FROM orders),
k AS (SELECT l_orderkey, id, min_by(seq, (abs(r.y + r.height / 2 - n.y), seq)) AS near FROM n JOIN r USING (l_orderkey) WHERE note AND item IS NULL GROUP BY ALL)
SELECT n.l_orderkey, n.id, CASE WHEN note THEN 'note' ELSE 'highlight' END AS type, coalesce(item, near) AS item_index, note OR item IS NULL AS has_rects FROM n LEFT JOIN k USING (l_orderkey, id)""",
    "ann_json": f"""WITH {oracles._ANN}, j AS (SELECT page_index, seq, '{{"id":"' || id || '","type":"' || type || '"' || coalesce(',"text":"' || regexp_replace(text, '[^a-z0-9 ]', '', 'g') || '"', '') || '}}' AS j FROM a),
t AS (SELECT page_index, '[' || string_agg(j, ',' ORDER BY seq) || ']' AS j FROM j GROUP BY page_index) SELECT page_index, length(j) AS n_chars, md5(j) AS digest FROM t""",
    "text_lines": r"""WITH t AS (SELECT page_id, string_split(replace(replace(replace(replace(coalesce(html, ''), '></', '>' || chr(13) || chr(10) || '</'), '<p>', chr(13) || '<p>'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM pages),
k AS (SELECT page_id, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM t)
SELECT page_id, unnest(range(len(l)))::INTEGER AS k, length(unnest(l))::INTEGER AS n_chars, md5(unnest(l)) AS digest FROM k""",
    "ann_first_edited": f"""WITH {oracles._ANN}, t AS (SELECT * REPLACE ('i' || (seq // 3) AS id), seq // 3 AS n, row_number() OVER (PARTITION BY seq // 3 ORDER BY seq) AS k FROM a)
SELECT id, seq, CASE WHEN k = 1 AND n % 4 = 1 THEN 'note' ELSE type END AS type, CASE WHEN k = 1 AND n % 4 = 1 THEN 0 ELSE page_index END AS page_index, CASE WHEN k = 1 AND n % 4 = 1 THEN 'edited' ELSE text END AS text FROM t WHERE NOT (k = 1 AND n % 6 = 1)""",
    "history_restored": """WITH RECURSIVE e AS (SELECT user_id AS doc, event_id % 5 AS id, value AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
  CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'remove' WHEN 'error' THEN 'undo' WHEN 'view' THEN 'redo' END AS action FROM events),
s AS (SELECT DISTINCT doc, 0::BIGINT AS k, []::STRUCT(id BIGINT, st DOUBLE)[] AS s, []::STRUCT(a VARCHAR, id BIGINT, b DOUBLE, n DOUBLE)[] AS u, []::STRUCT(a VARCHAR, id BIGINT, b DOUBLE, n DOUBLE)[] AS r FROM e UNION ALL
  SELECT doc, k, CASE WHEN op = 'add' THEN list_append(s, {'id': oid, 'st': ost}) WHEN op IS NULL OR i IS NULL OR i = 0 THEN s WHEN op = 'remove' THEN list_concat(s[:i - 1], s[i + 1:]) ELSE list_concat(s[:i - 1], [{'id': oid, 'st': ost}], s[i + 1:]) END,
    CASE action WHEN 'undo' THEN u[:len(u) - 1] WHEN 'redo' THEN CASE WHEN len(r) > 0 THEN list_append(u, r[len(r)]) ELSE u END ELSE CASE WHEN op = 'add' THEN list_append(u, {'a': 'add', 'id': oid, 'b': NULL, 'n': ost}) WHEN i > 0 THEN list_append(u, {'a': op, 'id': oid, 'b': s[i].st, 'n': ost}) ELSE u END END,
    CASE action WHEN 'undo' THEN CASE WHEN len(u) > 0 THEN list_append(r, u[len(u)]) ELSE r END WHEN 'redo' THEN r[:len(r) - 1] ELSE CASE WHEN op = 'add' OR i > 0 THEN [] ELSE r END END
  FROM (SELECT *, list_position(list_transform(s, lambda x: x.id), oid) AS i FROM (SELECT s.doc, e.k, s, u, r, action,
    CASE action WHEN 'undo' THEN CASE u[len(u)].a WHEN 'add' THEN 'remove' WHEN 'remove' THEN 'add' ELSE u[len(u)].a END WHEN 'redo' THEN r[len(r)].a ELSE action END AS op,
    CASE action WHEN 'undo' THEN u[len(u)].id WHEN 'redo' THEN r[len(r)].id ELSE id END AS oid,
    CASE action WHEN 'undo' THEN u[len(u)].b WHEN 'redo' THEN r[len(r)].n ELSE state END AS ost
    FROM s JOIN e ON e.doc = s.doc AND e.k = s.k + 1))),
f AS (SELECT doc, arg_max(s, k) AS s FROM s GROUP BY doc)
SELECT doc, unnest(range(1, len(s) + 1)) AS place, unnest(s).id AS id, unnest(s).st AS state FROM f""",
    "note_nearest_y": f"""WITH {oracles._RECTS}, p AS (SELECT o_orderkey AS l_orderkey, o_custkey AS point_id, (o_custkey % 60)::DOUBLE AS y FROM orders),
k AS (SELECT p.l_orderkey, point_id, r.y + r.height / 2 AS m, row_number() OVER (PARTITION BY p.l_orderkey, point_id ORDER BY abs(r.y + r.height / 2 - p.y), seq, r.y) AS k FROM p JOIN r ON r.l_orderkey = p.l_orderkey AND width > 10)
SELECT p.l_orderkey, p.point_id, coalesce(m, p.y) AS at FROM p LEFT JOIN k ON k.l_orderkey = p.l_orderkey AND k.point_id = p.point_id AND k = 1""",
    "hit_notes": f"""WITH {oracles._RECTS}, n AS (SELECT a.l_orderkey, a.seq, 340.0 AS x, coalesce(i.y + i.height / 2, 5.0) AS y FROM r a LEFT JOIN r i ON i.l_orderkey = a.l_orderkey AND i.seq = a.seq - 1 WHERE a.seq % 2 = 0)
SELECT n.l_orderkey, o_custkey AS point_id, max(seq) AS seq FROM n JOIN orders ON o_orderkey = n.l_orderkey WHERE abs(o_custkey % 40 + 320 - x) <= 12 AND abs(o_custkey % 60 - y) <= 12 GROUP BY ALL""",
    "anchor_refreshed": f"""WITH {_SHIFTED}, x AS (SELECT doc_id, item_id, greatest(start_item - 2, 0)::INTEGER AS start_item, CASE WHEN doc_id % 3 = 0 THEN start_offset ELSE 0 END AS start_offset, end_item - 2 AS end_item, end_offset FROM w WHERE doc_id % 3 = 0), {oracles._SCORE},
h AS (SELECT w.*, z.score, w.doc_id % 3 = 0 AS moved FROM w LEFT JOIN z USING (doc_id, item_id))
SELECT doc_id, item_id, (CASE WHEN moved THEN 2 ELSE 1 END)::INTEGER AS version, (CASE WHEN moved AND score >= 0.92 THEN start_item - 2 ELSE start_item END)::INTEGER AS start_item, start_offset, (CASE WHEN moved AND score >= 0.92 THEN end_item - 2 ELSE end_item END)::INTEGER AS end_item, end_offset FROM h""",
}
