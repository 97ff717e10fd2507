"""Queries over page files that are written from the documents (see `writer`) and read back from their bytes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import colors, fonts
from folioscan.session import materialize, table
from folioscan.sources import images, pdf, values, writer, xref


def _doc() -> Column:
    return F.col("path").cast("long").alias("doc_id")


def _survey(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(xref.survey(writer.files(table(spark, sf, "documents")), streams=False), "survey")


def _pages(spark: SparkSession, sf: str, streams: bool = True) -> tuple[DataFrame, DataFrame]:
    found, named = xref.tables(writer.files(table(spark, sf, "documents")), streams)
    return found, materialize(pdf.pages(found, named), "pages")


def xref_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The sections of each file in the order in which a reader comes by them."""
    surveyed = _survey(spark, sf)
    return xref.chain(surveyed).join(xref.sections(surveyed), ["path", "at"]).select(_doc(), "rank", "kind")


def xref_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The newest entry of each object, of tables and of reference streams."""
    rows = xref.entries(_survey(spark, sf))
    return rows.select(_doc(), "obj", "in_use", "gen", "holder", "index")


def pdf_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Each object of the files, how it was found, its type and whether it has a stream."""
    found = xref.objects(_survey(spark, sf))
    v = F.col("value")
    return found.select(_doc(), "obj", "how", values.name(v, "$.Type", None).alias("type"), F.col("stream").isNotNull().alias("has_stream"), F.size(values.array(v, "$.Kids")).alias("n_kids"), values.number(v, "$.Count", -1.0).cast("long").alias("count"), values.string(v, "$.Title", None).alias("title"))


def pdf_summary(spark: SparkSession, sf: str) -> DataFrame:
    surveyed = _survey(spark, sf)
    found = materialize(xref.objects(surveyed), "objects")
    told = pdf.summary(surveyed, found, xref.trailers(surveyed))
    return told.select(_doc(), "version", "catalog", "pages", "page_count", values.string(F.col("info"), "$.Title", None).alias("title"), "error")


def pdf_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Every way from the files' catalogs along references."""
    found, named = xref.tables(writer.files(table(spark, sf, "documents")), streams=False)
    roots = pdf.catalogs(found, named).select("path", "obj")
    return pdf.resolved(found, roots).select(_doc(), F.array_join("trail", "/").alias("trail"), "obj", "again")


def page_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in order, with what they inherit; files have outlines, form fields and empty nodes too."""
    _, of = _pages(spark, sf, streams=False)
    return of.select(_doc(), "page_index", "obj", F.array_join(F.transform("contents", lambda x: x.cast("string")), ",").alias("contents"), "media_box", "crop_box", "rotate", "width", "height")


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of pages and of the forms that they paint, placed by the fonts' widths."""
    found, of = _pages(spark, sf)
    rows = pdf.page_rows(found, of, ("text",))
    style = fonts.style(F.col("base"))
    return rows.select(_doc(), "page_index", "seq", "text", *[F.round(c, 3).alias(c) for c in ("x", "y", "width", "height")], F.concat_ws(" ", *[style[k] for k in ("style", "weight", "family")]).alias("face"))


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Subpaths of pages, with their bounds and how they are painted."""
    found, of = _pages(spark, sf)
    rows = pdf.page_rows(found, of, ("path",))
    return rows.select(_doc(), "page_index", "seq", "subpath", "segments", "closed", *[F.round(c, 3).alias(c) for c in ("x", "y", "width", "height")], "fill", "stroke", colors.css(F.col("fill_color")).alias("fill_css"), colors.css(F.col("stroke_color")).alias("stroke_css"), "line_width")


def page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images where pages place them, and their pixels."""
    found, of = _pages(spark, sf)
    told = materialize(images.described(found), "images")
    drawn = told.join(images.pixels(told), ["path", "obj"]).select("path", "obj", F.col("width").alias("columns"), F.col("height").alias("rows"), "mode", "base", F.hex("rgba").alias("rgba"))
    where = images.placed(pdf.page_rows(found, of, ("placed",)), of, found)
    return where.join(drawn, ["path", "obj"]).select(_doc(), "page_index", "obj", "x", "y", "width", "height", "columns", "rows", "mode", "base", "rgba")


NAMES = ("Courier-Bold", "ABCDEF+TimesNewRoman-Italic", "Helvetica-Oblique", "DejaVuSansMono", "SymbolMT", "ZapfDingbats", "Arial-BoldItalicMT", "F1", "NotoSerif-b", "Garamond-i")


def font_styles(spark: SparkSession, sf: str) -> DataFrame:
    name = F.array(*[F.lit(x) for x in NAMES])[(F.col("p_partkey") % len(NAMES)).cast("int")]
    named = table(spark, sf, "part").select("p_partkey", F.inline(F.array(F.struct(name.alias("name")))))
    return named.select("p_partkey", "name", *[c.alias(k) for k, c in fonts.style(F.col("name")).items()])


QUERIES = {f.__name__: f for f in (xref_chain, xref_rows, pdf_objects, pdf_summary, pdf_resolved, page_tree, page_texts, page_paths, page_images, font_styles)}

_F = writer.FIRST
_DOCS = f"""d AS (SELECT coalesce(doc_id, 0) AS doc_id, coalesce(doc_id, 0) % 4 AS form, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
n AS (SELECT *, ((len(ls) + {writer.LINES - 1}) // {writer.LINES})::BIGINT AS pages FROM d), f AS (SELECT *, (pages + 3) // 4 AS nodes FROM n),
g AS (SELECT doc_id, form, pages, nodes, unnest(generate_series(0, nodes - 1)) AS g FROM f), p AS (SELECT doc_id, form, pages, nodes, unnest(generate_series(0, pages - 1)) AS p FROM f),
o AS (SELECT doc_id, form, pages, nodes, 13 + 2 * pages + nodes AS n, unnest(generate_series(1, 13 + 2 * pages + nodes)) AS obj FROM f)"""
_HELD = ", ".join(map(str, writer.HELD))
_WAYS = [
    ("", "1"), ("Pages", "2"), ("Pages/Resources.Font.F1", "3"), ("Pages/Resources.Font.F1/FontDescriptor", "11"), ("Pages/Resources.XObject.Fm1", "8"),
    ("Pages/Resources.XObject.Fm1/Resources.Font.F9", "3"), ("Pages/Resources.XObject.Fm1/Resources.Font.F9/FontDescriptor", "11"), ("Pages/Resources.XObject.Fm1/Resources.XObject.Fm2", "10"),
    ("Pages/Resources.XObject.Im1", "12"), ("Pages/Resources.XObject.Im1/ColorSpace[3]", "13"), ("Outlines", "4"), ("Outlines/First", "5"), ("Outlines/Last", "5"),
    ("AcroForm.Fields[0]", "6"), ("AcroForm.Fields[0]/Parent", "4"), ("AcroForm.Fields[0]/Parent/First", "5"), ("AcroForm.Fields[0]/Parent/Last", "5"),
]
_AGAIN = ["Outlines/First", "Outlines/Last", "AcroForm.Fields[0]/Parent/First", "AcroForm.Fields[0]/Parent/Last"]
_FIXED = ", ".join([f"('{t}', {o}, false)" for t, o in _WAYS] + [f"('{t}/Parent', 4, true)" for t in _AGAIN])
_WIDE = "CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN 400 + unicode(c) % 7 * 50 ELSE 500 END"

ORACLES = {
    "xref_chain": f"WITH {_DOCS} SELECT doc_id, 0 AS rank, CASE form WHEN 1 THEN 'stream' ELSE 'table' END AS kind FROM f WHERE form < 3 UNION ALL SELECT doc_id, 1, 'table' FROM f WHERE form = 0",
    "xref_rows": f"""WITH {_DOCS}, h AS (SELECT k, row_number() OVER () - 1 AS i FROM unnest([{_HELD}]) t(k))
SELECT doc_id, obj, true AS in_use, 0::INTEGER AS gen, CASE WHEN form = 1 AND i IS NOT NULL THEN n + 1 END AS holder, CASE WHEN form = 1 THEN i END AS index FROM o LEFT JOIN h ON obj = k WHERE form < 3
UNION ALL SELECT doc_id, 0, false, 65535, NULL, NULL FROM f WHERE form < 3 UNION ALL SELECT doc_id, 14 + 2 * pages + nodes, true, 0, NULL, NULL FROM f WHERE form = 1""",
    "pdf_objects": f"""WITH {_DOCS}, w AS (SELECT *, obj BETWEEN {_F} AND {_F - 1} + 2 * pages AND obj % 2 = 0 AS page, obj BETWEEN {_F} AND {_F - 1} + 2 * pages AND obj % 2 = 1 AS content, obj >= {_F} + 2 * pages AS node FROM o)
SELECT doc_id, obj, CASE WHEN form IN (2, 3) THEN 'scan' WHEN form = 1 AND obj IN ({_HELD}) THEN 'member' ELSE 'table' END AS how,
  CASE WHEN page THEN 'Page' WHEN node OR obj IN (2, 7) THEN 'Pages' ELSE CASE obj WHEN 1 THEN 'Catalog' WHEN 3 THEN 'Font' WHEN 4 THEN 'Outlines' WHEN 8 THEN 'XObject' WHEN 11 THEN 'FontDescriptor' WHEN 12 THEN 'XObject' END END AS type,
  content OR obj IN (8, 10, 12) AS has_stream, (CASE WHEN obj = 2 THEN nodes + 1 WHEN node THEN least(4, pages - 4 * (obj - {_F} - 2 * pages)) ELSE 0 END)::INTEGER AS n_kids, CASE obj WHEN 2 THEN pages WHEN 4 THEN 1 ELSE -1 END AS count,
  CASE obj WHEN 5 THEN 'a (nested ) title' WHEN 9 THEN CASE form WHEN 1 THEN 'old ' ELSE 'new ' END || doc_id END AS title FROM w
UNION ALL SELECT doc_id, 14 + 2 * pages + nodes, 'table', 'ObjStm', true, 0, -1, NULL FROM f WHERE form = 1 UNION ALL SELECT doc_id, 15 + 2 * pages + nodes, 'scan', 'XRef', true, 0, -1, NULL FROM f WHERE form = 1""",
    "pdf_summary": f"WITH {_DOCS} SELECT doc_id, '1.5' AS version, 1::BIGINT AS catalog, 2::BIGINT AS pages, f.pages AS page_count, CASE WHEN form < 3 THEN CASE form WHEN 1 THEN 'old ' ELSE 'new ' END || doc_id END AS title, NULL::VARCHAR AS error FROM f",
    "pdf_resolved": f"""WITH {_DOCS}, s AS (SELECT * FROM (VALUES {_FIXED}) t(trail, obj, again))
SELECT doc_id, trail, obj::BIGINT AS obj, again FROM f, s UNION ALL SELECT doc_id, 'Pages/Kids[' || nodes || ']', 7, false FROM f UNION ALL SELECT doc_id, 'Pages/Kids[' || nodes || ']/Parent', 2, true FROM f
UNION ALL SELECT doc_id, 'Pages/Kids[' || g || ']', {_F} + 2 * pages + g, false FROM g UNION ALL SELECT doc_id, 'Pages/Kids[' || g || ']/Parent', 2, true FROM g
UNION ALL SELECT doc_id, 'Pages/Kids[' || p // 4 || ']/Kids[' || p % 4 || ']', {_F} + 2 * p, false FROM p UNION ALL SELECT doc_id, 'Pages/Kids[' || p // 4 || ']/Kids[' || p % 4 || ']/Contents', {_F + 1} + 2 * p, false FROM p
UNION ALL SELECT doc_id, 'Pages/Kids[' || p // 4 || ']/Kids[' || p % 4 || ']/Parent', {_F} + 2 * pages + p // 4, true FROM p""",
    "page_tree": f"""WITH {_DOCS} SELECT doc_id, p::INTEGER AS page_index, {_F} + 2 * p AS obj, ({_F + 1} + 2 * p)::VARCHAR AS contents, '0 0 612 792' AS media_box, CASE WHEN p // 4 % 2 = 0 THEN '10 20 310 420' END AS crop_box,
(CASE p % 4 WHEN 1 THEN 90 WHEN 3 THEN 270 ELSE 0 END)::INTEGER AS rotate, (CASE WHEN p // 4 % 2 = 0 THEN CASE p % 2 WHEN 1 THEN 400 ELSE 300 END ELSE CASE p % 2 WHEN 1 THEN 792 ELSE 612 END END)::DOUBLE AS width,
(CASE WHEN p // 4 % 2 = 0 THEN CASE p % 2 WHEN 1 THEN 300 ELSE 400 END ELSE CASE p % 2 WHEN 1 THEN 612 ELSE 792 END END)::DOUBLE AS height FROM p""",
    "page_texts": f"""WITH {_DOCS}, l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS k, unnest(ls) AS text FROM f),
c AS (SELECT doc_id, k, sum({_WIDE}) AS wide FROM (SELECT doc_id, k, unnest(string_split(text, '')) AS c FROM l WHERE text <> '') GROUP BY ALL),
t AS (SELECT doc_id, k // {writer.LINES} AS p, 2 * (k % {writer.LINES}) AS o, text, 0.0::DOUBLE AS x, k % {writer.LINES} * 14 AS y, wide / 100.0::DOUBLE AS width, 10.0::DOUBLE AS height FROM l JOIN c USING (doc_id, k)
  UNION ALL SELECT doc_id, k // {writer.LINES}, 2 * (k % {writer.LINES}) + 1, '*', coalesce(wide, 0) / 100.0::DOUBLE, k % {writer.LINES} * 14, 4.0, 10 FROM l LEFT JOIN c USING (doc_id, k)
  UNION ALL SELECT doc_id, p, 1000 + k, text, x, y, width, height FROM p, (VALUES (0, 'form', 26.0, 38, 38.4, 16), (1, '!', 64.4, 38, 10.4, 16), (2, 'inner', 24.0, 34, 11.0, 4)) v(k, text, x, y, width, height) WHERE p % 3 = 0)
SELECT doc_id, p::INTEGER AS page_index, (row_number() OVER (PARTITION BY doc_id, p ORDER BY o) - 1)::INTEGER AS seq, text, round(x, 3) AS x, y::DOUBLE AS y, round(width, 3) AS width, height, 'italic bold Times New Roman, Times, serif' AS face FROM t""",
    "page_paths": f"""WITH {_DOCS} SELECT doc_id, p::INTEGER AS page_index, v.* EXCLUDE (w), 'nonzero' AS fill, seq = 1 AS stroke, 'rgb(128, 128, 128)' AS fill_css, 'rgb(255, 0, 0)' AS stroke_css, w::DOUBLE AS line_width
FROM p, (VALUES (0, 0, 3, true, 20.0::DOUBLE, 40.0::DOUBLE, 60.0::DOUBLE, 80.0::DOUBLE, 1), (1, 0, 2, true, 0, 0, 20, 20, 3), (1, 1, 1, false, 10, 10, 8, 6, 3)) v(seq, subpath, segments, closed, x, y, width, height, w)""",
    "page_images": f"WITH {_DOCS} SELECT doc_id, p::INTEGER AS page_index, 12::BIGINT AS obj, 5.0::DOUBLE AS x, 6.0::DOUBLE AS y, 20.0::DOUBLE AS width, 10.0::DOUBLE AS height, 2 AS columns, 2 AS rows, 'indexed' AS mode, 'rgb' AS base, '0A141EFF28323CFF46505AFF28323CFF' AS rgba FROM p WHERE p % 3 = 1",
    "font_styles": f"""WITH k AS (SELECT p_partkey, [{', '.join(f"'{x}'" for x in NAMES)}][p_partkey % {len(NAMES)} + 1] AS name FROM part), l AS (SELECT *, lower(name) AS l FROM k)
SELECT p_partkey, name, CASE WHEN regexp_matches(l, 'courier|mono') THEN 'Courier New, Courier, monospace' WHEN regexp_matches(l, 'times|serif') THEN 'Times New Roman, Times, serif'
  WHEN regexp_matches(l, 'helvetica|arial|sans') THEN 'Helvetica, Arial, sans-serif' WHEN contains(l, 'symbol') THEN 'Symbol' WHEN regexp_matches(l, 'zapf|dingbat') THEN 'ZapfDingbats, Wingdings' ELSE 'sans-serif' END AS family,
  CASE WHEN regexp_matches(l, 'bold|-b') THEN 'bold' ELSE 'normal' END AS weight, CASE WHEN regexp_matches(l, 'italic|oblique|-i') THEN 'italic' ELSE 'normal' END AS style FROM l""",
}
