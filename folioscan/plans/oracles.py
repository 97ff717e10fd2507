"""The same queries as DuckDB SQL."""

from __future__ import annotations

_S = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_CTRL = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}]"


def _lig(x: str) -> str:
    return f"replace(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"


def _n(x: str) -> str:
    plain = f"replace(translate(regexp_replace(coalesce({x}, ''), '{_CTRL}', ' ', 'g'), '‘’“”', '''''\"\"'), chr(173), '')"
    joined = _lig(f"regexp_replace({plain}, '-{_S}+', '', 'g')")
    return f"lower(regexp_replace(regexp_replace({joined}, '{_S}+', ' ', 'g'), '^ | $', '', 'g'))"


def _c(x: str) -> str:
    return f"regexp_replace({_n(x)}, '[^a-z0-9]+', '', 'g')"


def _cc(x: str) -> str:
    lowered = f"lower({_lig(f"regexp_replace(coalesce({x}, ''), '{_CTRL}', '', 'g')")})"
    return f"regexp_replace({lowered}, '[^a-z0-9]+', '', 'g')"


_LINES = "l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), i AS (SELECT doc_id, len(ls) AS n, unnest(generate_series(0, len(ls) - 1))::INTEGER AS item_index, unnest(ls) AS text FROM l)"
_EXACT = f"""
q AS MATERIALIZED (SELECT item_id, {_c('text')} AS quote FROM benchmark),
d AS MATERIALIZED (SELECT doc_id, {_cc('text')} AS hay FROM documents),
f AS MATERIALIZED (SELECT doc_id, item_id, strpos(hay, quote) - 1 AS a, strpos(hay, quote) + length(quote) - 2 AS b FROM d, q WHERE quote <> '' AND contains(hay, quote)),
{_LINES},
ch AS (SELECT doc_id, item_index, unnest(generate_series(0, length(text) - 1)) AS o, unnest(string_split(text, '')) AS c FROM i WHERE text <> '' AND doc_id IN (SELECT doc_id FROM f)),
cs AS MATERIALIZED (SELECT c, length({_cc('c')}) AS s FROM (SELECT DISTINCT c FROM ch)),
r AS MATERIALIZED (SELECT doc_id, item_index, o, s FROM ch JOIN cs USING (c)),
u AS MATERIALIZED (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY item_index, o ROWS UNBOUNDED PRECEDING) AS upto FROM r),
v AS MATERIALIZED (SELECT doc_id, item_index, o, unnest(generate_series((upto - s)::BIGINT, (upto - 1)::BIGINT)) AS pos FROM u WHERE s > 0),
x AS MATERIALIZED (SELECT f.doc_id, f.item_id, s.item_index::INTEGER AS start_item, s.o::INTEGER AS start_offset, e.item_index::INTEGER AS end_item, (e.o + 1)::INTEGER AS end_offset
  FROM f JOIN v s ON s.doc_id = f.doc_id AND s.pos = a JOIN v e ON e.doc_id = f.doc_id AND e.pos = b)
"""
_TEXT = f"""
t AS (SELECT x.doc_id, x.item_id, string_agg(substr(i.text, 1 + CASE WHEN item_index = start_item THEN start_offset ELSE 0 END,
  greatest(0, CASE WHEN item_index = end_item THEN end_offset ELSE length(i.text) END - CASE WHEN item_index = start_item THEN start_offset ELSE 0 END))
  || CASE WHEN item_index < n - 1 AND item_index < end_item THEN chr(10) ELSE '' END, '' ORDER BY item_index) AS text
  FROM x JOIN i ON x.doc_id = i.doc_id AND item_index BETWEEN start_item AND end_item WHERE i.text <> '' GROUP BY ALL)
"""
_RECTS = "r AS (SELECT l_orderkey, l_linenumber::BIGINT AS seq, l_quantity * 10 AS x, (l_linenumber % 3 * 14)::DOUBLE AS y, (l_partkey % 40 + 1)::DOUBLE AS width, 12.0::DOUBLE AS height FROM lineitem)"
_ANN = """a AS (SELECT event_id::VARCHAR AS id, CASE WHEN event_type IN ('click', 'view') THEN 'highlight' WHEN event_type = 'purchase' THEN 'note' ELSE 'drawing' END AS type,
  user_id % 10 AS page_index, CASE WHEN event_id % 5 > 0 THEN concat_ws(' ', event_type, props) END AS text, event_id AS seq FROM events)"""
_HISTORY = """
WITH g AS (SELECT user_id AS id, row_number() OVER (ORDER BY ts, event_id) AS seq, event_id, value AS state,
  CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'update' END AS action FROM events WHERE event_type IN ('signup', 'click', 'view', 'purchase', 'error')),
k AS (SELECT id, max(seq) AS gone FROM g WHERE action = 'remove' GROUP BY id),
l AS (SELECT g.* FROM g LEFT JOIN k USING (id) WHERE gone IS NULL OR seq > gone),
b AS (SELECT id, min(seq) AS seq, arg_min(event_id, seq) AS born, arg_min(state, seq) AS state FROM l WHERE action = 'add' GROUP BY id),
u AS (SELECT l.id, arg_max(l.event_id, l.seq) AS last, arg_max(l.state, l.seq) AS state, count(*) AS n FROM l JOIN b ON l.id = b.id AND l.seq > b.seq WHERE action = 'update' GROUP BY l.id)
SELECT b.id, b.born, coalesce(u.last, b.born) AS last, CASE WHEN u.id IS NULL THEN b.state ELSE u.state END AS state, coalesce(u.n, 0)::BIGINT AS n_updates FROM b LEFT JOIN u ON b.id = u.id
"""
_XREF = "x AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'F' AS in_use FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1)"
_CODEC = "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, sha256(text) AS digest FROM documents"

_p0, _p2, _p3 = "coalesce(lag(c) OVER w, c)", "coalesce(lead(c) OVER w, c)", "coalesce(lead(c, 2) OVER w, lead(c) OVER w, c)"


def _spline(c: str) -> str:
    t = "(step * 0.2::DOUBLE)"
    return (
        f"round((2 * {t} * {t} * {t} - 3 * {t} * {t} + 1) * {c} + ({t} * {t} * {t} - 2 * {t} * {t} + {t}) * (0.5::DOUBLE * ({c}2 - {c}0))"
        f" + (3 * {t} * {t} - 2 * {t} * {t} * {t}) * {c}2 + ({t} * {t} * {t} - {t} * {t}) * (0.5::DOUBLE * ({c}3 - {c})), 6) AS {c}"
    )


def _near(c: str) -> str:
    return ", ".join(f"{p.replace('(c', f'({c}').replace(', c)', f', {c})')} AS {c}{k}" for k, p in ((0, _p0), (2, _p2), (3, _p3)))


ORACLES = {
    "text_items": f"WITH {_LINES} SELECT doc_id, item_index, text, 0.0::DOUBLE AS x, (item_index * 14)::DOUBLE AS y, (length(text) * 6)::DOUBLE AS width, 12.0::DOUBLE AS height, item_index < n - 1 AS has_eol FROM i WHERE text <> ''",
    "text_normalized": f"WITH {_LINES} SELECT doc_id, item_index, {_n('text')} AS normalized FROM i WHERE text <> ''",
    "text_compact": f"WITH {_LINES} SELECT doc_id, item_index, {_c('text')} AS compact, {_cc('text')} AS compact_chars FROM i WHERE text <> ''",
    "span_index": f"WITH {_LINES} SELECT doc_id, item_index, (row_number() OVER (PARTITION BY doc_id ORDER BY item_index) - 1)::INTEGER AS span_index FROM i WHERE {_n('text')} <> ''",
    "anchor_exact": f"WITH {_EXACT} SELECT * FROM x",
    "anchor_normalized": f"""WITH {_LINES},
k AS (SELECT doc_id, item_index, length(text) AS len, {_n('text')} AS nt FROM i), m AS MATERIALIZED (SELECT * FROM k WHERE nt <> ''),
p AS (SELECT *, sum(length(nt) + 1) OVER (PARTITION BY doc_id ORDER BY item_index ROWS UNBOUNDED PRECEDING) - 1 AS b FROM m),
h AS MATERIALIZED (SELECT doc_id, string_agg(nt, ' ' ORDER BY item_index) AS hay FROM m GROUP BY doc_id),
q AS (SELECT item_id, {_n('text')} AS quote FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, item_id, strpos(hay, quote) - 1 AS pos, length(quote) AS n FROM h, q WHERE quote <> '' AND contains(hay, quote))
SELECT f.doc_id, item_id, min(item_index)::INTEGER AS start_item, 0::INTEGER AS start_offset, max(item_index)::INTEGER AS end_item, arg_max(len, item_index)::INTEGER AS end_offset
FROM f JOIN p ON f.doc_id = p.doc_id AND b > pos AND b - length(nt) < pos + n GROUP BY f.doc_id, item_id""",
    "anchor_fuzzy": f"""WITH {_LINES},
k AS (SELECT doc_id, item_index, length(text) AS len, {_c('text')} AS c FROM i), m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY item_index) AS p FROM k WHERE c <> ''),
q AS MATERIALIZED (SELECT item_id, {_c('text')} AS quote FROM benchmark),
w AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM (SELECT s.doc_id, s.p AS sp, s.item_index AS si, e.p - s.p + 1 AS n, e.item_index AS ei, e.len AS elen,
  sum(length(e.c)) OVER v AS total, sum(length(e.c)) OVER v - length(e.c) AS before, string_agg(e.c, '') OVER v AS t
  FROM m s JOIN m e ON e.doc_id = s.doc_id AND e.p BETWEEN s.p AND s.p + 179
  WINDOW v AS (PARTITION BY s.doc_id, s.p ORDER BY e.p ROWS UNBOUNDED PRECEDING)) WHERE before <= (SELECT max(length(quote)) FROM q) * 1.65 + 24),
y AS MATERIALIZED (SELECT w.*, item_id, quote FROM w, q WHERE quote <> '' AND before <= length(quote) * 1.65 + 24 AND total >= greatest(12, length(quote) * 0.45)),
g AS (SELECT id, substr(t, o, 2) AS gram, count(*) AS k FROM (SELECT id, t, unnest(generate_series(1, length(t) - 1)) AS o FROM w) GROUP BY ALL),
h AS (SELECT item_id, substr(quote, o, 2) AS gram, count(*) AS k FROM (SELECT *, unnest(generate_series(1, length(quote) - 1)) AS o FROM q) GROUP BY ALL),
c AS (SELECT id, item_id, sum(least(g.k, h.k)) AS common FROM g JOIN h USING (gram) GROUP BY ALL),
s AS (SELECT y.*, CASE WHEN t = quote THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(common, 0)::DOUBLE / (length(t) + length(quote) - 2)::DOUBLE END AS score FROM y LEFT JOIN c USING (id, item_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, si, n) AS k FROM s)
SELECT doc_id, item_id, si::INTEGER AS start_item, 0::INTEGER AS start_offset, ei::INTEGER AS end_item, elen::INTEGER AS end_offset, round(score, 9) AS score FROM b WHERE k = 1 AND score >= 0.72""",
    "anchor_text": f"WITH {_EXACT}, {_TEXT} SELECT * FROM t",
    "anchor_score": f"""WITH {_EXACT}, {_TEXT}, a AS (SELECT t.doc_id, t.item_id, {_c('t.text')} AS actual, quote FROM t JOIN q USING (item_id))
SELECT doc_id, item_id, CASE WHEN actual = quote THEN 1.0::DOUBLE WHEN contains(actual, quote) OR contains(quote, actual) THEN least(length(actual), length(quote))::DOUBLE / greatest(length(actual), length(quote)) END AS score FROM a""",
    "anchor_rects": f"""WITH {_EXACT}, c AS (SELECT x.doc_id, item_id, item_index, length(text) AS n, CASE WHEN item_index = start_item THEN start_offset ELSE 0 END AS a,
  CASE WHEN item_index = end_item THEN end_offset ELSE length(text) END AS b FROM x JOIN i ON x.doc_id = i.doc_id AND item_index BETWEEN start_item AND end_item WHERE text <> '')
SELECT doc_id, item_id, item_index, (a * 6)::DOUBLE AS x, (item_index * 14)::DOUBLE AS y, greatest(1, (b - a) * 6)::DOUBLE AS width, 12.0::DOUBLE AS height FROM c WHERE b > a""",
    "anchor_from_rects": f"""WITH {_EXACT}, c AS (SELECT x.doc_id, item_id, item_index, CASE WHEN item_index = start_item THEN start_offset ELSE 0 END AS a,
  CASE WHEN item_index = end_item THEN end_offset ELSE length(text) END AS b FROM x JOIN i ON x.doc_id = i.doc_id AND item_index BETWEEN start_item AND end_item WHERE text <> ''),
k AS (SELECT doc_id, item_id, item_index, a * 6 AS x1, greatest(a * 6 + 1, b * 6) AS x2 FROM c WHERE b > a),
e AS (SELECT doc_id, item_id, arg_min(x1, item_index) AS x1, arg_max(x2, item_index) AS x2 FROM k GROUP BY ALL),
n AS (SELECT k.doc_id, item_id, min(i.item_index) AS s, max(i.item_index) AS t FROM k JOIN i ON i.doc_id = k.doc_id AND abs(i.item_index - k.item_index) <= 1 AND i.text <> '' AND 0 < x2 + 8 AND length(i.text) * 6 > x1 - 8 GROUP BY ALL)
SELECT n.doc_id, n.item_id, s::INTEGER AS start_item, greatest(0, least(length(f.text) - 1, ceil((x1 - 1) / 6.0) - 1))::INTEGER AS start_offset,
  t::INTEGER AS end_item, greatest(0, least(length(l.text), floor((x2 + 1) / 6.0) + 1))::INTEGER AS end_offset
FROM n JOIN e USING (doc_id, item_id) JOIN i f ON f.doc_id = n.doc_id AND f.item_index = s JOIN i l ON l.doc_id = n.doc_id AND l.item_index = t""",
    "page_sizes": "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2, 4) THEN p_retailprice ELSE p_size::DOUBLE END AS width, CASE WHEN p_partkey % 5 IN (0, 2, 4) THEN p_size::DOUBLE ELSE p_retailprice END AS height FROM part",
    "ann_colors": """WITH c AS (SELECT event_id, event_id * 7919 % 16777216 AS n FROM events), p AS (SELECT event_id, (n // 65536)::INTEGER AS r, (n // 256 % 256)::INTEGER AS g, (n % 256)::INTEGER AS b FROM c)
SELECT event_id, format('rgba({}, {}, {}, 0.35)', r, g, b) AS rgba, lower(format('#{:02x}{:02x}{:02x}', least(255, r + 24), least(255, g + 24), least(255, b + 24))) AS bright,
CASE WHEN event_id % 3 = 0 THEN format('rgb({0}, {0}, {0})', floor((event_id % 5)::DOUBLE / 4 * 255 + 0.5)::INTEGER)
ELSE format('rgb({}, {}, {})', floor((event_id % 3)::DOUBLE / 3 * 255 + 0.5)::INTEGER, floor((event_id % 5)::DOUBLE / 5 * 255 + 0.5)::INTEGER, floor((event_id % 7)::DOUBLE / 7 * 255 + 0.5)::INTEGER) END AS css FROM p""",
    "rect_bounds": f"WITH {_RECTS} SELECT l_orderkey, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM r GROUP BY l_orderkey",
    "rect_intersections": f"WITH {_RECTS} SELECT a.l_orderkey, a.seq AS a_id, b.seq AS b_id FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.seq < b.seq WHERE a.x < b.x + b.width + 8 AND a.x + a.width > b.x - 8 AND a.y < b.y + b.height + 4 AND a.y + a.height > b.y - 4",
    "rect_merge": f"""WITH {_RECTS},
o AS (SELECT *, max(x + width) OVER (PARTITION BY l_orderkey, y ORDER BY x, width, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM r),
s AS (SELECT *, sum(CASE WHEN edge IS NULL OR x > edge + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, y ORDER BY x, width, seq ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT l_orderkey, y, island, min(x) AS x, max(x + width) - min(x) AS width, max(height) AS height FROM s GROUP BY ALL)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY y, x) - 1)::BIGINT AS line, x, y, width, height FROM m""",
    "nearest_item": f"""WITH {_RECTS}, p AS (SELECT o_orderkey AS l_orderkey, o_custkey AS point_id, (o_custkey % 50)::DOUBLE AS py FROM orders),
k AS (SELECT l_orderkey, point_id, seq, abs(y + height / 2 - py) AS distance FROM r JOIN p USING (l_orderkey))
SELECT l_orderkey, point_id, seq AS item_index, distance FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, point_id ORDER BY distance, seq) AS k FROM k) WHERE k = 1""",
    "hit_test": f"""WITH {_RECTS}, p AS (SELECT o_orderkey AS l_orderkey, o_custkey AS point_id, (o_custkey % 500)::DOUBLE AS px, (o_custkey % 40)::DOUBLE AS py FROM orders)
SELECT l_orderkey, point_id, max(seq) AS seq FROM r JOIN p USING (l_orderkey) WHERE px BETWEEN x AND x + width AND py BETWEEN y AND y + height GROUP BY ALL""",
    "path_smooth": f"""WITH {_RECTS}, p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq, x, width) AS k FROM r),
n AS (SELECT l_orderkey, k, x, y, {_near('x')}, {_near('y')}, lead(k) OVER w IS NULL AS final, count(*) OVER (PARTITION BY l_orderkey) AS n FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY k)),
s AS (SELECT *, unnest(CASE WHEN final OR n < 3 THEN [0] ELSE [0, 1, 2, 3, 4] END)::BIGINT AS step FROM n)
SELECT l_orderkey, k, step, {_spline('x')}, {_spline('y')} FROM s""",
    "ann_titles": f"""WITH {_ANN} SELECT id, CASE WHEN type = 'drawing' THEN 'Drawing' ELSE coalesce(nullif(trim(text, ' '), ''), CASE type WHEN 'note' THEN 'Empty note' ELSE 'Highlight' END) END AS title,
CASE WHEN type = 'note' THEN CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END END AS preview FROM a""",
    "ann_list": f"WITH {_ANN} SELECT row_number() OVER (ORDER BY page_index, type, seq) AS place, id, page_index, type FROM a",
    "ann_by_page": f"WITH {_ANN} SELECT page_index, count(*) AS n, count(*) FILTER (type = 'note') AS n_notes, bool_or(type = 'note') AS has_notes, arg_min(id, seq) AS first_id, arg_max(id, seq) AS last_id FROM a GROUP BY page_index",
    "ann_edited": f"""WITH {_ANN} SELECT id, type, page_index, CASE WHEN seq % 7 = 0 THEN 'edited' ELSE text END AS text, seq FROM a WHERE seq % 11 <> 0
UNION ALL SELECT id || '-copy', type, page_index, text, seq FROM a WHERE seq % 13 = 0""",
    "ann_stored": f"""WITH {_ANN}, k AS (SELECT *, seq % 2 = 0 AS anchored, seq % 3 = 0 AS stray FROM a)
SELECT id, CASE WHEN type <> 'note' THEN 1.0::DOUBLE END AS x, CASE WHEN NOT (type = 'note' AND anchored) THEN 2.0::DOUBLE END AS y,
anchored AND NOT (type = 'highlight' AND stray) AS "has_anchorRange", anchored AND NOT (type = 'note' AND stray) AS "has_textAnchor", NOT (type = 'highlight' AND anchored) AS has_rect, NOT (type = 'highlight' AND anchored) AS has_rects FROM k""",
    "history_replay": _HISTORY,
    "history_stream": _HISTORY,
    "xref_first_wins": f"WITH {_XREF} SELECT * FROM x",
    "ref_resolve": f"WITH {_XREF} SELECT c_custkey AS o_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM x WHERE in_use) k ON c_custkey = k.o_custkey",
    "tree_flatten": """WITH r AS (SELECT 'r' || r_regionkey AS id, 'region' AS kind, r_regionkey::VARCHAR AS path, r_name AS inherited, r_regionkey AS k FROM region),
n AS (SELECT 'n' || n_nationkey AS id, 'nation' AS kind, r.path || '/' || n_nationkey AS path, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r.inherited END AS inherited, n_nationkey AS k FROM nation JOIN r ON n_regionkey = r.k),
c AS (SELECT 'c' || c_custkey AS id, 'customer' AS kind, n.path || '/' || c_custkey AS path, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE n.inherited END AS inherited FROM customer JOIN n ON c_nationkey = n.k)
SELECT id, kind, path, inherited FROM r UNION ALL SELECT id, kind, path, inherited FROM n UNION ALL SELECT * FROM c""",
    "page_window": f"""WITH {_LINES}, p AS (SELECT doc_id, item_index::BIGINT AS page_index FROM i WHERE text <> ''), c AS (SELECT doc_id, max(page_index) // 2 AS current_page FROM p GROUP BY doc_id)
SELECT doc_id, page_index, current_page, abs(page_index - current_page) <= 2 AS render FROM p JOIN c USING (doc_id) WHERE abs(page_index - current_page) <= 6""",
    "page_objects": "SELECT doc_id, unnest([1, 2, 3, 4, 5, 6])::BIGINT AS obj, 0::INTEGER AS gen, unnest([false, false, false, true, false, true]) AS has_stream FROM documents",
    "page_operators": f"WITH {_LINES}, o AS (SELECT doc_id, 2 * item_index + 2 AS seq, 'Tm' AS op, 6 AS n_args FROM i UNION ALL SELECT doc_id, 2 * item_index + 3, 'Tj', 1 FROM i UNION ALL SELECT DISTINCT doc_id, 2 * n + 2, 'ET', 0 FROM i UNION ALL SELECT doc_id, 0, 'BT', 0 FROM l UNION ALL SELECT doc_id, 1, 'Tf', 2 FROM l) SELECT doc_id, seq::INTEGER AS seq, op, n_args::INTEGER AS n_args FROM o",
    "page_text_mapped": f"WITH {_LINES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY item_index) - 1)::INTEGER AS seq, text FROM i WHERE text <> ''",
    "page_text": f"WITH {_LINES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY item_index) - 1)::INTEGER AS seq, text, 0.0::DOUBLE AS x, (item_index * 14)::DOUBLE AS y FROM i WHERE text <> ''",
    **{k: _CODEC for k in ("codec_hex", "codec_ascii85", "codec_run_length", "codec_lzw", "codec_flate", "codec_png")},
}

_UNEVEN = f"{_RECTS}, e AS (SELECT * REPLACE (y + ((width - 1)::BIGINT % 2) * 1.5 AS y), y AS base FROM r)"


def _merged(gap: int) -> str:
    return f"""WITH {_UNEVEN},
o AS (SELECT *, max(x + width) OVER (PARTITION BY l_orderkey, base ORDER BY x, width, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM e),
s AS (SELECT *, sum(CASE WHEN edge IS NULL OR x > edge + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, base ORDER BY x, width, y ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT l_orderkey, base, island, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(height) AS height FROM s GROUP BY ALL)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY base, x) - 1)::BIGINT AS line, x, y, width, height FROM m"""


_NOTES = "n AS (SELECT o_orderkey AS l_orderkey, o_custkey AS note_id, (o_custkey % 60)::DOUBLE AS y, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 9 END AS item_index FROM orders)"
_LOG = "g AS (SELECT user_id AS id, ts, event_id, value AS state, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'update' END AS action FROM events WHERE event_type IN ('signup', 'click', 'view', 'purchase', 'error'))"
_CATALOG = ", ".join(
    f"('{kind}', '{name}', '{value}')"
    for kinds, own in (
        (("drawing",), "Red #E91E63 Blue #2196F3 Green #4CAF50 Black #333333 Orange #FF5722"),
        (("highlight", "note"), "Yellow #FFEB3B Green #4CAF50 Blue #2196F3 Pink #E91E63 Orange #FF5722"),
        (("width",), "Thin 1 Normal 2 Thick 4"),
    )
    for kind in kinds
    for name, value in zip(own.split(" ")[::2], own.split(" ")[1::2], strict=True)
)
_SCORE = f"""{_TEXT}, s AS (SELECT t.doc_id, t.item_id, {_c('t.text')} AS actual, quote FROM t JOIN q USING (item_id)),
z AS (SELECT doc_id, item_id, CASE WHEN actual = '' THEN 0.0::DOUBLE WHEN actual = quote THEN 1.0::DOUBLE WHEN contains(actual, quote) OR contains(quote, actual) THEN least(length(actual), length(quote))::DOUBLE / greatest(length(actual), length(quote)) END AS score FROM s)"""

ORACLES |= {
    "rect_merge_uneven": _merged(20),
    "rect_merge_selection": _merged(6),
    "rect_selected": f"WITH {_RECTS} SELECT * FROM r WHERE width > 1 AND height > 1 AND x + width >= 0 AND x <= 250 AND y + height >= 0 AND y <= 14",
    "rect_rescaled": f"WITH {_RECTS} SELECT l_orderkey, seq, x * 1.5 AS x, y * 1.5 AS y, width * 1.5 AS width, height * 1.5 AS height FROM r",
    "path_rescaled": f"WITH {_RECTS} SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq, x, y, width) - 1 AS k, x * 0.25 AS x, y * 0.25 AS y FROM r",
    "text_spans": f"WITH {_LINES} SELECT doc_id, item_index, 0.0::DOUBLE AS x, round(item_index * 14 / 1.5::DOUBLE, 6) AS y, round(length(text) * 6 / 1.5::DOUBLE, 6) AS width, 8.0::DOUBLE AS height FROM i WHERE trim(text) <> ''",
    "highlight_rects": f"""WITH {_RECTS}, a AS (SELECT * FROM r WHERE l_orderkey % 3 = 0 AND width > 20), h AS (SELECT * FROM a UNION ALL SELECT * FROM r WHERE width <= 20 AND l_orderkey NOT IN (SELECT l_orderkey FROM a)),
o AS (SELECT *, max(x + width) OVER (PARTITION BY l_orderkey, y ORDER BY x, width, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM h),
s AS (SELECT *, sum(CASE WHEN edge IS NULL OR x > edge + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, y ORDER BY x, width, seq ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT l_orderkey, min(x) AS x, y, max(x + width) - min(x) AS width, max(height) AS height FROM s GROUP BY l_orderkey, y, island""",
    "note_y": f"WITH {_RECTS}, {_NOTES} SELECT n.l_orderkey, note_id, coalesce(r.y + r.height / 2, n.y, 16) AS at FROM n LEFT JOIN r ON r.l_orderkey = n.l_orderkey AND r.seq = n.item_index",
    "note_placed": f"""WITH {_RECTS}, {_NOTES}, k AS (SELECT n.l_orderkey, note_id, n.y, seq, row_number() OVER (PARTITION BY n.l_orderkey, note_id ORDER BY abs(r.y + r.height / 2 - n.y), seq) AS k FROM n LEFT JOIN r USING (l_orderkey) WHERE item_index IS NULL)
SELECT l_orderkey, note_id, y, item_index FROM n WHERE item_index IS NOT NULL UNION ALL SELECT l_orderkey, note_id, greatest(16, least(34, y)), seq FROM k WHERE k = 1""",
    "hit_shapes": f"""WITH {_RECTS}, p AS (SELECT o_orderkey AS l_orderkey, o_custkey AS point_id, (o_custkey % 500)::DOUBLE AS px, (o_custkey % 40)::DOUBLE AS py FROM orders)
SELECT l_orderkey, point_id, max(seq) AS seq FROM r JOIN p USING (l_orderkey)
WHERE CASE seq % 3 WHEN 0 THEN px BETWEEN x AND x + width AND py BETWEEN y AND y + height WHEN 1 THEN abs(px - x) <= 12 AND abs(py - y) <= 12 ELSE abs(px - x) <= 8 AND abs(py - y) <= 8 END GROUP BY ALL""",
    "box_selection": f"""WITH {_RECTS}, b AS (SELECT o_orderkey AS l_orderkey, o_custkey AS box_id, least(o_custkey % 500, o_custkey % 300)::DOUBLE AS a, greatest(o_custkey % 500, o_custkey % 300)::DOUBLE AS b, (o_custkey % 20)::DOUBLE AS c, 30.0::DOUBLE AS d FROM orders),
f AS (SELECT l_orderkey, box_id, min(x) AS x, min(y) AS y, max(x + width) AS r, max(y + height) AS l, string_agg('w' || seq, ' ' ORDER BY seq) AS text FROM b JOIN r USING (l_orderkey) WHERE x + width > a AND x < b AND y + height > c AND y < d GROUP BY ALL)
SELECT b.l_orderkey, b.box_id, coalesce(x, a) AS x, coalesce(y, c) AS y, coalesce(r, b) - coalesce(x, a) AS width, coalesce(l, d) - coalesce(y, c) AS height, text FROM b LEFT JOIN f USING (l_orderkey, box_id)""",
    "drawing_bounds": f"WITH {_RECTS} SELECT l_orderkey, min(x) AS x, min(y) AS y, max(x) - min(x) AS width, max(y) - min(y) AS height, count(*) AS n_points FROM r GROUP BY ALL HAVING count(*) > 1",
    "image_bounds": """WITH i AS (SELECT p_partkey AS image_id, [(p_partkey * k % 16) / 16.0::DOUBLE - 0.125 for k in [1, 2, 3]] AS xs, [(p_partkey * k % 16) / 16.0::DOUBLE - 0.125 for k in [4, 5, 6]] AS ys FROM part),
b AS (SELECT image_id, greatest(0, floor(list_min(xs) * 640))::BIGINT AS x, least(640, ceil(list_max(xs) * 640))::BIGINT AS r, greatest(0, floor(list_min(ys) * 480))::BIGINT AS y, least(480, ceil(list_max(ys) * 480))::BIGINT AS l FROM i)
SELECT image_id, x, y, r - x AS width, l - y AS height FROM b WHERE r > x AND l > y""",
    "current_page": """SELECT o_orderkey AS view_id, min(k)::INTEGER AS page_index FROM orders, range(5) t(k) WHERE k * 300 - o_custkey % 900 < 200 AND k * 300 + 290 - o_custkey % 900 > 200 GROUP BY ALL""",
    "selection_anchor": f"""WITH {_LINES}, k AS (SELECT doc_id, coalesce(doc_id, 0) AS k FROM documents),
s AS (SELECT k.doc_id, item_index, CASE WHEN item_index = k % 3 THEN least(k % 7, length(text)) ELSE 0 END AS a, CASE WHEN item_index = k % 3 + k % 5 THEN least(k % 11, length(text)) ELSE length(text) END AS b
  FROM k JOIN i USING (doc_id) WHERE text <> '' AND item_index BETWEEN k % 3 AND k % 3 + k % 5)
SELECT doc_id, 0 AS item_id, min(item_index) AS start_item, arg_min(a, item_index)::INTEGER AS start_offset, max(item_index) AS end_item, arg_max(b, item_index)::INTEGER AS end_offset FROM s WHERE b > a GROUP BY ALL""",
    "ann_page_replaced": f"WITH {_ANN} SELECT * FROM a WHERE page_index <> 3 UNION ALL SELECT * REPLACE ('new' AS text) FROM a WHERE page_index = 3 AND seq % 2 = 0",
    "ann_page_lists": f"WITH {_ANN} SELECT page_index, string_agg(id, ',' ORDER BY seq) AS ids FROM a GROUP BY ALL",
    "ann_preview": f"""WITH {_ANN} SELECT id, upper(type[1]) || type[2:] AS kind, CASE WHEN type = 'drawing' THEN (seq % 40) || ' points' WHEN type = 'highlight' THEN trim(coalesce(text, ''))
  WHEN coalesce(text, '') = '' THEN '(Empty note)' WHEN length(text) > 50 THEN text[:50] || '...' ELSE text END AS label FROM a""",
    "ann_notes_made": """SELECT 'ann_' || (epoch_us(ts::TIMESTAMP) // 1000) || '_' || sha256(concat_ws('|', user_id % 10, event_id % 600, event_id % 800, coalesce(event_type, ''), (epoch_us(ts::TIMESTAMP) // 1000)))[:9] AS id, 'note' AS type, '#FFEB3B' AS color,
  user_id % 10 AS page_index, event_id % 600 AS x, event_id % 800 AS y, coalesce(event_type, '') AS text FROM events""",
    "ann_catalog": f"""WITH {_ANN}, c(kind, name, value) AS (VALUES {_CATALOG}), n AS (SELECT id, CASE WHEN seq % 10 = 0 THEN 'width' ELSE type END AS type, ['Red', 'Green', 'Pink', 'Thick'][seq % 4 + 1] AS color_name FROM a)
SELECT id, type, color_name, value AS color FROM n LEFT JOIN c ON kind = type AND name = color_name""",
    "history_entries": f"""WITH {_LOG}, l AS (SELECT *, (SELECT count(*) FROM g r WHERE r.id = g.id AND r.action = 'remove' AND (r.ts, r.event_id) < (g.ts, g.event_id)) AS life FROM g),
b AS (SELECT *, min(CASE WHEN action = 'add' THEN (ts, event_id) END) OVER (PARTITION BY id, life) AS born FROM l),
e AS (SELECT * FROM b WHERE (action = 'add' AND (ts, event_id) = born) OR (action <> 'add' AND (ts, event_id) > born))
SELECT id, event_id, CASE WHEN action <> 'add' THEN lag(state) OVER (PARTITION BY id, life ORDER BY ts, event_id) END AS before, CASE WHEN action <> 'remove' THEN state END AS after FROM e""",
    "history_undone": """WITH RECURSIVE e AS (SELECT user_id AS doc, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT DISTINCT doc, 0::BIGINT AS k, []::BIGINT[] AS u, []::BIGINT[] AS r FROM e UNION ALL
  SELECT s.doc, e.k, CASE WHEN event_type = 'error' THEN list_slice(u, 1, len(u) - 1) WHEN event_type = 'signup' THEN CASE WHEN len(r) > 0 THEN list_append(u, r[len(r)]) ELSE u END ELSE list_append(u, event_id) END,
    CASE WHEN event_type = 'error' THEN CASE WHEN len(u) > 0 THEN list_append(r, u[len(u)]) ELSE r END WHEN event_type = 'signup' THEN list_slice(r, 1, len(r) - 1) ELSE [] END
  FROM s JOIN e ON e.doc = s.doc AND e.k = s.k + 1),
f AS (SELECT doc, arg_max(u, k) AS u FROM s GROUP BY doc)
SELECT doc, unnest(generate_series(1, len(u))) AS place, unnest(u) AS change FROM f WHERE len(u) > 0""",
    "session_latest": "SELECT user_id, epoch, event_id FROM (SELECT user_id, event_id % 4 AS epoch, event_id, max(event_id % 4) OVER (PARTITION BY user_id) AS last FROM events) WHERE epoch = last",
    "render_changed": "SELECT user_id, event_id, event_type AS render_key FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type",
    "anchor_stands": f"""WITH {_EXACT.replace('x AS MATERIALIZED', 'w AS MATERIALIZED')}, x AS (SELECT * REPLACE (greatest(start_item, end_item - item_id % 3)::INTEGER AS end_item) FROM w), {_SCORE}
SELECT w.doc_id, w.item_id, CASE WHEN score IS NOT NULL AND (score >= 0.92 OR (w.item_id % 5 > 0 AND 1.0 <= score + 0.03)) THEN 'current' ELSE 'recovered' END AS stands FROM w LEFT JOIN z USING (doc_id, item_id)""",
}

_RANGE = "doc_id, item_id, start_item, start_offset, end_item, end_offset"
ORACLES["anchor_resolved"] = f"""WITH e AS MATERIALIZED ({ORACLES['anchor_exact']}), n AS MATERIALIZED ({ORACLES['anchor_normalized']}), f AS MATERIALIZED ({ORACLES['anchor_fuzzy']})
SELECT {_RANGE}, 'exact' AS how FROM e UNION ALL SELECT {_RANGE}, 'normalized' FROM n WHERE NOT EXISTS (FROM e WHERE e.doc_id = n.doc_id AND e.item_id = n.item_id)
UNION ALL SELECT {_RANGE}, 'fuzzy' FROM f WHERE NOT EXISTS (FROM e WHERE e.doc_id = f.doc_id AND e.item_id = f.item_id) AND NOT EXISTS (FROM n WHERE n.doc_id = f.doc_id AND n.item_id = f.item_id)"""
