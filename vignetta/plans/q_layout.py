"""Queries over page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import boxes, layout as E
from ..session import saved
from ..sources.fixtures import VIEWS, base, view
from ..sources.page_store import stored_pages
from .parts import FIGS, figures, kind_case, with_panels
from .registry import query

PG = "paper_key, page"
EXT = "ex AS (SELECT paper_key, page, list_sort(list(x0))[CAST(floor(count(*) * CAST(0.05 AS DOUBLE)) AS INT) + 1] AS \"left\", list_sort(list(x1))[CAST(greatest(0, floor(count(*) * CAST(0.95 AS DOUBLE)) - 1) AS INT) + 1] AS \"right\" FROM fx_blocks GROUP BY paper_key, page)"
CAP = L.CAPTION.replace("'", "''")
CAPS = f"""{EXT}, c0 AS (SELECT b.*, regexp_replace(trim(text), '\\s+', ' ', 'g') AS flat FROM fx_blocks b),
c1 AS (SELECT *, lower(regexp_extract(flat, '{CAP}', 1)) AS word, regexp_replace(regexp_extract(flat, '{CAP}', 2), '\\s+', '', 'g') AS num, regexp_extract(flat, '{CAP}', 3) AS sep, regexp_extract(flat, '{CAP}', 4) AS rest FROM c0 WHERE regexp_matches(flat, '{CAP}')),
cp AS (SELECT c1.paper_key, c1.page, elem_id, CASE WHEN word IN ('table', '表') THEN 'table' ELSE 'figure' END AS kind, num, flat AS caption, x0, y0, x1, y1, page_w, page_h, "left", "right",
 CASE WHEN x1 - x0 > CAST(0.62 AS DOUBLE) * ("right" - "left") OR (x0 < ("left" + "right") / 2 - 20 AND x1 > ("left" + "right") / 2 + 20) THEN -1 WHEN (x0 + x1) / 2 > ("left" + "right") / 2 THEN 1 ELSE 0 END AS col
 FROM c1 JOIN ex ON ex.paper_key = c1.paper_key AND ex.page = c1.page WHERE NOT (trim(sep) = '' AND regexp_matches(rest, '{L.BODY_VERBS}')) AND y1 - y0 <= page_h * CAST(0.35 AS DOUBLE)),
bd AS (SELECT *, CASE WHEN col = -1 THEN 8.0 WHEN col = 0 THEN "left" - 10 ELSE ("left" + "right") / 2 - 4 END AS bx0, CASE WHEN col = -1 THEN page_w - 8 WHEN col = 0 THEN ("left" + "right") / 2 + 4 ELSE "right" + 10 END AS bx1 FROM cp)"""
VIS = """v0 AS (SELECT * REPLACE (greatest(x0, 0.0) AS x0, greatest(y0, 0.0) AS y0, least(x1, page_w) AS x1, least(y1, page_h) AS y1) FROM fx_elements WHERE elem_type IN ('image', 'draw')),
vi AS (SELECT * FROM v0 WHERE x1 > x0 AND y1 > y0 AND ((elem_type = 'image' AND x1 - x0 >= 4 AND y1 - y0 >= 4) OR (elem_type = 'draw' AND NOT (y1 - y0 < 1.5 AND x1 - x0 > CAST(0.55 AS DOUBLE) * page_w) AND NOT (x1 - x0 < 1 AND y1 - y0 < 1))))"""
HEAD = "hd AS (SELECT paper_key, page, coalesce(max(CASE WHEN y1 <= CAST(0.08 AS DOUBLE) * page_h AND y1 - y0 < 24 THEN y1 END), 0.0) AS header FROM fx_blocks GROUP BY paper_key, page)"
TOP = f"""{CAPS}, {VIS}, {HEAD}, nr AS (SELECT c.paper_key, c.page, c.elem_id, c.y0, c.bx0, c.bx1, o.elem_id AS o_id, o.kind AS o_kind, o.y1 AS o_y1 FROM bd c JOIN bd o ON o.paper_key = c.paper_key AND o.page = c.page AND o.elem_id <> c.elem_id AND o.y1 <= c.y0 - 5 AND o.x1 >= c.bx0 AND o.x0 <= c.bx1),
u1 AS (SELECT nr.*, v.y0 AS v_y0, v.y1 AS v_y1, v.elem_id AS v_id, max(v.y1) OVER (PARTITION BY nr.paper_key, nr.page, nr.elem_id, o_id ORDER BY v.y0, v.elem_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
 FROM nr JOIN vi v ON v.paper_key = nr.paper_key AND v.page = nr.page AND v.elem_type = 'draw' AND v.y0 >= o_y1 - 2 AND v.y1 <= nr.y0 - 2 AND v.x1 > bx0 AND v.x0 < bx1 WHERE o_kind = 'table'),
u2 AS (SELECT *, sum(CASE WHEN v_y0 > greatest(o_y1, coalesce(reach, o_y1)) + 28 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_key, page, elem_id, o_id ORDER BY v_y0, v_id ROWS UNBOUNDED PRECEDING) AS cut FROM u1),
bt AS (SELECT paper_key, page, elem_id, max(b) AS bottom FROM (SELECT paper_key, page, elem_id, o_y1 AS b FROM nr UNION ALL SELECT paper_key, page, elem_id, v_y1 FROM u2 WHERE cut = 0) GROUP BY ALL),
rg AS (SELECT bd.*, greatest(coalesce(header, 0.0), coalesce(bottom, 0.0)) AS top FROM bd LEFT JOIN hd USING (paper_key, page) LEFT JOIN bt USING (paper_key, page, elem_id))"""
SCAN = "sc AS (SELECT DISTINCT paper_key, page FROM {} WHERE elem_type = 'image' AND (x1 - x0) * (y1 - y0) > CAST(0.8 AS DOUBLE) * page_w * page_h)"
LOC = f"""{TOP}, {SCAN.format('vi')}, l1 AS (SELECT r.*, v.elem_type, v.elem_id AS v_id, greatest(v.x0, bx0) AS s_x0, least(v.x1, bx1) AS s_x1, greatest(v.y0, top - 2) AS s_y0, least(v.y1, r.y0 + 2) AS s_y1, v.x1 - v.x0 AS v_w
 FROM rg r JOIN vi v ON v.paper_key = r.paper_key AND v.page = r.page WHERE kind = 'figure' AND (r.paper_key, r.page) NOT IN (SELECT (paper_key, page) FROM sc) AND v.y1 <= r.y0 + 2 AND v.y0 >= top - 2),
l2 AS (SELECT *, min(s_y0) OVER (PARTITION BY paper_key, page, elem_id ORDER BY s_y1 DESC, elem_type = 'draw', v_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l1 WHERE s_x1 - s_x0 >= 1 AND s_y1 > s_y0 AND (col = -1 OR s_x1 - s_x0 >= 0.5 * v_w)),
l3 AS (SELECT *, sum(CASE WHEN (reach IS NULL AND s_y1 < y0 - 60) OR (reach IS NOT NULL AND s_y1 < least(y0, reach) - 28) THEN 1 ELSE 0 END) OVER (PARTITION BY paper_key, page, elem_id ORDER BY s_y1 DESC, elem_type = 'draw', v_id ROWS UNBOUNDED PRECEDING) AS cut FROM l2),
lf AS (SELECT paper_key, page, elem_id, any_value(num) AS num, min(s_x0) AS fx0, min(s_y0) AS fy0, max(s_x1) AS fx1, max(s_y1) AS fy1, bool_or(elem_type = 'image') AS has_raster, count(*) FILTER (elem_type = 'draw') AS n_drawings FROM l3 WHERE cut = 0 GROUP BY paper_key, page, elem_id
 HAVING max(s_x1) - min(s_x0) >= 70 AND max(s_y1) - min(s_y0) >= 40)"""


# page tables are stored by page; what a query uses several times is stored once


def _elements(spark, sf):
    return stored_pages(view(spark, sf, "fx_elements"), "elements")


def _blocks(spark, sf, elements=None):
    """fx_blocks over the stored elements."""
    rows = elements or _elements(spark, sf)
    return stored_pages(spark.sql(VIEWS["fx_blocks"].replace("FROM fx_elements e", "FROM {rows}"), rows=rows), "blocks", placed=True)


def _captions(spark, sf, blocks=None):
    b = blocks or _blocks(spark, sf)
    return stored_pages(E.caption_band(E.find_captions(b, E.text_extent(b))), "captions", placed=True)


def _visuals(spark, sf, elements=None):
    return E.visual_rects(elements or view(spark, sf, "fx_elements"))


def _regions(spark, sf, blocks, visuals):
    return E.region_top(_captions(spark, sf, blocks), visuals, E.header_bottom(blocks))


def _located(spark, sf, elements=None, blocks=None):
    e = elements or _elements(spark, sf)
    b, v = blocks or _blocks(spark, sf, e), _visuals(spark, sf, e)
    return E.locate_figure(stored_pages(_regions(spark, sf, b, v), "regions", placed=True), v)


@query("e1_text_extent", f"WITH {EXT} SELECT * FROM ex")
def e1(spark, sf):
    return E.text_extent(view(spark, sf, "fx_blocks"))


@query("e2_find_captions", f"WITH {CAPS} SELECT {PG}, elem_id, kind, num, caption FROM cp")
def e2(spark, sf):
    return _captions(spark, sf).select("paper_key", "page", "elem_id", "kind", "num", "caption")


@query("e3_caption_column", f"WITH {CAPS} SELECT {PG}, elem_id, col FROM cp")
def e3(spark, sf):
    return _captions(spark, sf).select("paper_key", "page", "elem_id", "col")


@query("e4_visual_rects", f"WITH {VIS} SELECT {PG}, elem_id, elem_type, x0, y0, x1, y1 FROM vi")
def e4(spark, sf):
    return _visuals(spark, sf).select("paper_key", "page", "elem_id", "elem_type", "x0", "y0", "x1", "y1")


@query("e5_caption_band", f"WITH {CAPS} SELECT {PG}, elem_id, bx0, bx1 FROM bd")
def e5(spark, sf):
    return _captions(spark, sf).select("paper_key", "page", "elem_id", "bx0", "bx1")


@query("e6_header_bottom", f"WITH {HEAD} SELECT * FROM hd")
def e6(spark, sf):
    return E.header_bottom(view(spark, sf, "fx_blocks"))


@query("e7_region_top", f"WITH {TOP} SELECT {PG}, elem_id, top FROM rg")
def e7(spark, sf):
    e = _elements(spark, sf)
    return _regions(spark, sf, _blocks(spark, sf, e), _visuals(spark, sf, e)).select("paper_key", "page", "elem_id", "top")


@query("e8_locate_figure", f"WITH {LOC} SELECT * EXCLUDE (num) FROM lf")
def e8(spark, sf):
    return _located(spark, sf).select("paper_key", "page", "elem_id", "fx0", "fy0", "fx1", "fy1", "has_raster", "n_drawings")


GROWN = f"""RECURSIVE {LOC}, ar AS (SELECT paper_key, page, list([CAST(x0 AS DOUBLE), y0, x1, y1]) AS around FROM fx_blocks GROUP BY paper_key, page),
g0 AS (SELECT lf.paper_key, lf.page, lf.elem_id, [CAST(fx0 AS DOUBLE), fy0, fx1, fy1] AS box, rg.y0 AS cy0, page_w, page_h,
 list_filter(coalesce(around, []), lambda b: b[1] >= bx0 - 2 AND b[3] <= bx1 + 2 AND b[3] - b[1] < CAST(0.9 AS DOUBLE) * (bx1 - bx0) AND b[4] <= rg.y0 - 1 AND b[2] >= top - 2) AS around
 FROM lf JOIN rg USING (paper_key, page, elem_id) LEFT JOIN ar USING (paper_key, page)),
gr AS (SELECT 0 AS step, * FROM g0 UNION ALL SELECT step + 1, paper_key, page, elem_id, wide, cy0, page_w, page_h, around FROM (SELECT *, list_reduce(list_filter(around, lambda b:
  greatest(0, least(b[3], box[3] + 6) - greatest(b[1], box[1] - 6)) * greatest(0, least(b[4], box[4] + 6) - greatest(b[2], box[2] - 6)) >= greatest(1e-12, 0.5 * (b[3] - b[1]) * (b[4] - b[2]))),
  lambda a, b: [least(a[1], b[1]), least(a[2], b[2]), greatest(a[3], b[3]), greatest(a[4], b[4])], box) AS wide FROM gr) WHERE wide <> box),
gb AS (SELECT paper_key, page, elem_id, arg_max(box, step) AS box, any_value(cy0) AS cy0, any_value(page_w) AS page_w, any_value(page_h) AS page_h FROM gr GROUP BY paper_key, page, elem_id)"""


@query("e9_grow_labels", f"WITH {GROWN} SELECT paper_key, page, elem_id, greatest(0.0, box[1] - 3) AS fx0, greatest(0.0, box[2] - 3) AS fy0, least(page_w, box[3] + 3) AS fx1, least(page_h, least(box[4] + 3, cy0 - 1)) AS fy1 FROM gb")
def e9(spark, sf):
    e = _elements(spark, sf)
    b = _blocks(spark, sf, e)
    grown = boxes.grow_labels(_located(spark, sf, e, b), b)
    return grown.select("paper_key", "page", "elem_id", "fx0", "fy0", "fx1", "fy1")


BIG = "SELECT * REPLACE (CASE WHEN elem_type = 'image' AND elem_id % 2 = 0 THEN 2.0 ELSE x0 END AS x0, CASE WHEN elem_type = 'image' AND elem_id % 2 = 0 THEN 5.0 ELSE y0 END AS y0, CASE WHEN elem_type = 'image' AND elem_id % 2 = 0 THEN 610.0 ELSE x1 END AS x1, CASE WHEN elem_type = 'image' AND elem_id % 2 = 0 THEN 790.0 ELSE y1 END AS y1) FROM fx_elements"
GAP = f"""{TOP}, bg AS ({BIG}), {SCAN.format('bg')}, fl AS (SELECT r.paper_key, r.page, r.elem_id, max(b.y1) AS fl FROM rg r JOIN fx_blocks b ON b.paper_key = r.paper_key AND b.page = r.page AND b.y1 <= r.y0 - 4 AND b.y1 >= r.top AND b.x1 >= bx0 AND b.x0 <= bx1 AND b.x1 - b.x0 >= CAST(0.45 AS DOUBLE) * (bx1 - bx0) GROUP BY ALL),
g1 AS (SELECT r.paper_key, r.page, r.elem_id, greatest(0.0, bx0 + 6) AS fx0, greatest(top, coalesce(fl, top)) + 4 AS fy0, least(page_w, bx1 - 6) AS fx1, least(page_h, r.y0 - 1) AS fy1 FROM rg r LEFT JOIN fl USING (paper_key, page, elem_id) WHERE kind = 'figure' AND (paper_key, page) IN (SELECT (paper_key, page) FROM sc))"""


@query("e10_locate_by_text_gap", f"WITH {GAP} SELECT * FROM g1 WHERE fx1 - fx0 >= 70 AND fy1 - fy0 >= 40")
def e10(spark, sf):
    big = (F.col("elem_type") == "image") & (F.col("elem_id") % 2 == 0)
    pick = lambda c, v: F.when(big, v).otherwise(F.col(c))
    e = _elements(spark, sf)
    scans = e.withColumns({"x0": pick("x0", 2.0), "y0": pick("y0", 5.0), "x1": pick("x1", 610.0), "y1": pick("y1", 790.0)})
    b = _blocks(spark, sf, e)
    regions = stored_pages(_regions(spark, sf, b, _visuals(spark, sf, e)), "regions", placed=True)
    return E.locate_by_text_gap(regions, b, E.visual_rects(scans)).select("paper_key", "page", "elem_id", "fx0", "fy0", "fx1", "fy1")


@query("e11_page_lines", "SELECT paper_key, page, block, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, coalesce(max(gap), 0.0) AS max_gap, string_agg(word, ' ' ORDER BY x0, word_no) AS text FROM (SELECT *, lead(x0) OVER (PARTITION BY paper_key, page, block, line ORDER BY x0, word_no) - x1 AS gap FROM fx_words) GROUP BY paper_key, page, block, line")
def e11(spark, sf):
    return E.page_lines(view(spark, sf, "fx_words"))


def _rules(spark, sf, elements=None):
    """Every third drawing flattened to a rule."""
    thin = F.when(F.col("elem_id") % 3 == 0, F.col("y0") + 1.5).otherwise(F.col("y1"))
    return E.page_rules((elements or view(spark, sf, "fx_elements")).filter("elem_type = 'draw'").withColumn("y1", thin))


@query("e12_page_rules", "SELECT paper_key, page, elem_id FROM fx_elements WHERE elem_type = 'draw' AND elem_id % 3 = 0 AND x1 - x0 >= 30")
def e12(spark, sf):
    return _rules(spark, sf).select("paper_key", "page", "elem_id")


INB = "least({1}, bx1) - greatest({0}, bx0) > CAST(0.3 AS DOUBLE) * least({1} - {0}, bx1 - bx0)"
TABLES = f"""{CAPS}, ru AS (SELECT paper_key, page, list_sort(list([CAST(x0 AS DOUBLE), y0, x1, y0 + 1.5])) AS rules FROM fx_elements WHERE elem_type = 'draw' AND elem_id % 3 = 0 AND x1 - x0 >= 30 GROUP BY paper_key, page),
cs AS (SELECT paper_key, page, list([CAST(x0 AS DOUBLE), y0, x1, y1]) AS caps FROM bd GROUP BY paper_key, page),
tb AS (SELECT paper_key, page, elem_id, num, bx0, bx1, y0 AS cy0, y1 AS cy1, coalesce(rules, []) AS rules, list_filter(caps, lambda c: c <> [CAST(x0 AS DOUBLE), y0, x1, y1]) AS caps,
 list_filter(coalesce(rules, []), lambda r: {INB.format('r[1]', 'r[3]')}) AS flat FROM bd JOIN cs USING (paper_key, page) LEFT JOIN ru USING (paper_key, page) WHERE kind = 'table'),
ln AS (SELECT paper_key, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, coalesce(max(gap), 0.0) AS max_gap, string_agg(word, ' ' ORDER BY x0, word_no) AS text FROM (SELECT *, lead(x0) OVER (PARTITION BY paper_key, page, block, line ORDER BY x0, word_no) - x1 AS gap FROM fx_words) GROUP BY paper_key, page, block, line),
w0 AS (SELECT tb.*, ln.x0, ln.y0, ln.x1, ln.y1, max_gap, text, d.down FROM tb JOIN ln USING (paper_key, page), (VALUES (true), (false)) d(down) WHERE {INB.format('ln.x0', 'ln.x1')} AND CASE WHEN d.down THEN ln.y0 >= cy1 - 1 ELSE ln.y1 <= cy0 + 1 END),
w1 AS (SELECT *, row_number() OVER w AS n, coalesce(lag(CASE WHEN down THEN y1 ELSE y0 END) OVER w, CASE WHEN down THEN cy1 ELSE cy0 END) AS edge FROM w0 WINDOW w AS (PARTITION BY paper_key, page, elem_id, down ORDER BY CASE WHEN down THEN y0 ELSE -y0 END, x0, y0, x1, y1, max_gap, text)),
w2 AS (SELECT *, CASE WHEN down THEN edge ELSE y1 END AS lo, CASE WHEN down THEN y0 ELSE edge END AS hi FROM w1),
w3 AS (SELECT *, list_filter(flat, lambda r: r[2] >= lo - 1 AND r[2] <= hi + 1) AS bt FROM w2),
w4 AS (SELECT *, coalesce((hi - lo > 30 AND len(bt) = 0) OR len(list_filter(caps, lambda c: c[1] < x1 AND c[3] > x0 AND c[2] < y1 AND c[4] > y0)) > 0 OR regexp_matches(text, '(?i)^\\s*(Figure|Fig\\.?|Table|图|表)\\s*\\d')
 OR (n > 1 AND len(bt) > 0 AND CASE WHEN down THEN y0 - list_max(list_transform(bt, lambda r: r[4])) ELSE list_min(list_transform(bt, lambda r: r[2])) - y1 END > 9)
 OR (x1 - x0 >= CAST(0.8 AS DOUBLE) * (bx1 - bx0) AND max_gap < 12 AND NOT (len(list_filter(flat, lambda r: r[4] >= y0 - 25 AND r[4] <= y0 + 1)) > 0 AND len(list_filter(flat, lambda r: r[2] >= y1 - 1 AND r[2] <= y1 + 25)) > 0)), false) AS br FROM w3),
w5 AS (SELECT *, sum(CAST(br AS INT)) OVER (PARTITION BY paper_key, page, elem_id, down ORDER BY n) AS cut FROM w4),
w6 AS (SELECT paper_key, page, elem_id, down, count(*) AS n, any_value(num) AS num, any_value(rules) AS rules, any_value(bx0) AS bx0, any_value(bx1) AS bx1, [min(x0), min(y0), max(x1), max(y1)] AS box FROM w5 WHERE cut = 0 GROUP BY paper_key, page, elem_id, down HAVING count(*) >= 2),
w7 AS (SELECT *, row_number() OVER (PARTITION BY paper_key, page, elem_id ORDER BY n DESC, down DESC) AS rn FROM w6),
w8 AS (SELECT * REPLACE (list_reduce(list_filter(rules, lambda r: {INB.format('r[1]', 'r[3]')}), lambda a, r: CASE WHEN r[2] >= a[2] - 8 AND r[4] <= a[4] + 8 THEN [least(a[1], r[1]), least(a[2], r[2]), greatest(a[3], r[3]), greatest(a[4], r[4])] ELSE a END, box) AS box) FROM w7 WHERE rn = 1)"""


@query("e13_locate_table", f"WITH {TABLES} SELECT paper_key, page, elem_id, 'table' AS kind, num, box[1] - 3 AS fx0, box[2] - 3 AS fy0, box[3] + 3 AS fx1, box[4] + 3 AS fy1, len(rules) AS n_drawings FROM w8 WHERE box[3] - box[1] + 6 >= 60 AND box[4] - box[2] + 6 >= 18")
def e13(spark, sf):
    e, words = _elements(spark, sf), stored_pages(view(spark, sf, "fx_words"), "words")
    return boxes.locate_table(_captions(spark, sf, _blocks(spark, sf, e)), E.page_lines(words), _rules(spark, sf, e))


@query("e14_assign_fig_ids", f"WITH {LOC} SELECT paper_key || '__p' || page || '__fig' || num AS fig_id, elem_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_key, page, regexp_replace(num, '[^0-9A-Za-z.]+', '', 'g') ORDER BY elem_id) AS n FROM lf) WHERE n = 1")
def e14(spark, sf):
    return E.assign_fig_ids(_located(spark, sf)).select("fig_id", "elem_id")


DIRS = """ln AS (SELECT paper_key, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, length(string_agg(word, ' ')) AS chars, CASE WHEN (block + line) % 3 = 0 THEN 1.0 ELSE 0.0 END AS dir_x, CASE WHEN block % 2 = 0 THEN -1.0 ELSE 1.0 END AS dir_y FROM fx_words GROUP BY paper_key, page, block, line)"""


@query("e15_rotation_of", f"""WITH {LOC}, {DIRS}, ids AS (SELECT *, paper_key || '__p' || page || '__fig' || num AS fig_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_key, page, num ORDER BY elem_id) AS n FROM lf) WHERE n = 1),
s AS (SELECT fig_id, sum(CASE WHEN dir_x >= 0.5 THEN chars ELSE 0 END) AS h, sum(CASE WHEN dir_x < 0.5 AND dir_y < 0 THEN chars ELSE 0 END) AS u, sum(CASE WHEN dir_x < 0.5 AND dir_y >= 0 THEN chars ELSE 0 END) AS d
 FROM ids f JOIN ln l ON l.paper_key = f.paper_key AND l.page = f.page AND l.x0 < fx1 AND l.x1 > fx0 AND l.y0 < fy1 AND l.y1 > fy0 AND chars >= 2 GROUP BY fig_id)
SELECT ids.fig_id, CASE WHEN h IS NULL OR u + d + h < 20 OR u + d <= 1.5 * h THEN 0 WHEN u >= d THEN -90 ELSE 90 END AS rotated FROM ids LEFT JOIN s USING (fig_id)""")
def e15(spark, sf):
    lines = E.page_lines(stored_pages(view(spark, sf, "fx_words"), "words")).withColumns({"dir_x": F.when((F.col("block") + F.col("line")) % 3 == 0, 1.0).otherwise(0.0), "dir_y": F.when(F.col("block") % 2 == 0, -1.0).otherwise(1.0)})
    return E.rotation_of(E.assign_fig_ids(_located(spark, sf)), lines)


@query("e16_caption_kind", f"WITH {FIGS} SELECT fig_id, kind FROM fg")
def e16(spark, sf):
    return figures(spark, sf).select("fig_id", "kind")


@query("e17_paper_meta", rf"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'arXiv:2101.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || 'v2 [cs.CV] 3 Mar 2022 ' WHEN 1 THEN 'In CVPR 2023, not 2019. ' WHEN 2 THEN 'SIGGRAPH Asia 2031 ' ELSE '' END || text AS text, CASE WHEN doc_id % 3 = 0 THEN 'main.tex' WHEN doc_id % 3 = 1 THEN ' A Title ' ELSE '' END AS ft FROM documents)
SELECT 'd' || doc_id AS paper_key, regexp_extract(text, '(?i)arXiv:\s*(\d{{4}}\.\d{{4,5}})(v\d+)?', 1) AS arxiv_id, regexp_extract(substring(text, 1, 3000), '{L.VENUES_IN_TEXT}', 1) AS venue,
 coalesce(nullif(regexp_extract(text, 'arXiv:\d{{4}}\.\d{{4,5}}(?:v\d+)?\s*\[[^\]]*\]\s*\d{{1,2}}\s+\w+\s+(20\d\d)', 1), ''), list_max(regexp_extract_all(substring(text, 1, 3000), '\b(20[0-3][0-9])\b', 1)), '') AS year, CASE WHEN doc_id % 3 = 1 THEN 'A Title' ELSE 'd' || doc_id END AS title FROM d""")
def e17(spark, sf):
    d, i = base(spark, sf, "documents"), F.col("doc_id")
    stamp = F.concat(F.lit("arXiv:2101."), F.lpad(i.cast("string"), 5, "0"), F.lit("v2 [cs.CV] 3 Mar 2022 "))
    head = F.when(i % 4 == 0, stamp).when(i % 4 == 1, "In CVPR 2023, not 2019. ").when(i % 4 == 2, "SIGGRAPH Asia 2031 ").otherwise("")
    title = F.when(i % 3 == 0, "main.tex").when(i % 3 == 1, " A Title ").otherwise("")
    return E.paper_meta(d.select(F.concat(F.lit("d"), i.cast("string")).alias("paper_key"), title.alias("file_title"), F.concat(head, "text").alias("text")))


@query("e18_title_from_largest_text", f"""WITH t AS (SELECT paper_key, elem_id AS line_no, y0, caption AS text, CAST(8 + elem_id % 5 AS DOUBLE) AS size FROM (SELECT *, text AS caption FROM fx_blocks) WHERE page = 1 AND y0 <= page_h * 0.5 AND length(trim(text)) >= 3 AND elem_id % 7 <> 0),
b AS (SELECT *, max(size) OVER (PARTITION BY paper_key) AS best FROM t) SELECT paper_key, substring(string_agg(text, ' ' ORDER BY y0, line_no), 1, 200) AS title FROM b WHERE size >= CAST(0.85 AS DOUBLE) * best GROUP BY paper_key""")
def e18(spark, sf):
    b = view(spark, sf, "fx_blocks").filter("page = 1").withColumns({"line_no": F.col("elem_id"), "size": (8 + F.col("elem_id") % 5).cast("double"), "dir_x": F.when(F.col("elem_id") % 7 == 0, 0.0).otherwise(1.0)})
    return E.title_from_largest_text(b)


@query("e19_extract_plan", "SELECT f.* FROM fx_pdfs f LEFT JOIN fx_papers p USING (paper_key) WHERE NOT coalesce(error IS NULL AND abs(pdf_mtime - mtime) < 1 AND extractor_version = 5 AND dpi = 300, false)")
def e19(spark, sf):
    return E.extract_plan(view(spark, sf, "fx_pdfs"), view(spark, sf, "fx_papers"))


@query("e20_pdf_inventory", "SELECT paper_key, 'a/' || paper_key || '.pdf' AS name, bytes FROM fx_pdfs WHERE bytes % 5 <> 0 UNION ALL SELECT paper_key, 'b/' || paper_key || '.pdf', bytes + 1 FROM fx_pdfs WHERE bytes % 5 = 0 AND bytes % 2 = 0")
def e20(spark, sf):
    f = view(spark, sf, "fx_pdfs")
    zh = F.when(F.col("bytes") % 5 == 0, ".zh.pdf").otherwise(".pdf")
    a = f.select("paper_key", F.concat(F.lit("a/"), "paper_key", zh).alias("name"), "bytes")
    b = f.filter("bytes % 2 = 0").select("paper_key", F.concat(F.lit("b/"), "paper_key", F.lit(".pdf")).alias("name"), (F.col("bytes") + 1).alias("bytes"))
    return E.pdf_inventory([a, b]).select("paper_key", "name", "bytes")


CARRY = f"""{FIGS}, nw AS (SELECT * REPLACE (CASE WHEN pos % 5 = 0 THEN page + 1 ELSE page END AS page, CASE WHEN pos % 5 = 0 THEN fig_id || 'x' ELSE fig_id END AS fig_id), NULL AS vv FROM fg),
pv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_key, page, num ORDER BY pos DESC) AS n FROM fg) WHERE n = 1),
ca AS (SELECT nw.fig_id, pv.v_category, pv.v2_category, CASE WHEN pv.fig_id = nw.fig_id AND pv.n_panels >= 1 THEN CASE WHEN pv.n_panels >= 2 THEN pv.n_panels ELSE 0 END END AS np FROM nw LEFT JOIN pv ON pv.paper_key = nw.paper_key AND pv.page = nw.page AND pv.num = nw.num)"""


def _new(f):
    moved = F.col("pos") % 5 == 0
    null = lambda t: F.lit(None).cast(t)
    return f.withColumns({"page": F.when(moved, F.col("page") + 1).otherwise(F.col("page")), "fig_id": F.when(moved, F.concat("fig_id", F.lit("x"))).otherwise(F.col("fig_id")), "v_category": null("string"), "v_chart_type": null("string"), "v2_category": null("string"), "panels": null("array<string>")})


@query("e21_carry_labels", f"WITH {CARRY} SELECT fig_id, v_category, v2_category, np FROM ca UNION ALL SELECT fig_id || '_s' || k, NULL, NULL, NULL FROM (SELECT fig_id, unnest(generate_series(1, np)) AS k FROM ca WHERE np >= 2)")
def e21(spark, sf):
    cols = ("paper_key", "pos", "page", "num", "fig_id", "caption", "thumb_md5", "v_category", "v_chart_type", "v2_category", "v2_chart_type", "v_tags", "parent", "panel", "n_panels", "panels")
    f = saved(figures(spark, sf).select(*cols), "figures")
    out = E.carry_labels(with_panels(f), _new(f))
    return out.select("fig_id", "v_category", "v2_category", F.when(F.col("panels").isNotNull(), F.size("panels")).cast("long").alias("np"))


@query("e22_replace_tables", "SELECT fig_id FROM fx_figures WHERE NOT contains(fig_id, '__tab') UNION ALL SELECT fig_id || 'n' FROM fx_figures WHERE contains(fig_id, '__tab') AND pos % 2 = 1")
def e22(spark, sf):
    f = view(spark, sf, "fx_figures").select("fig_id", "pos")
    return E.replace_tables(f, f.filter("contains(fig_id, '__tab') AND pos % 2 = 1").withColumn("fig_id", F.concat("fig_id", F.lit("n")))).select("fig_id")


@query("e23_refresh_meta", "SELECT paper_key, CASE WHEN error IS NULL AND f.bytes IS NOT NULL THEN 'New ' || paper_key ELSE pdf_title END AS pdf_title, CASE WHEN error IS NULL AND f.bytes IS NOT NULL THEN '2030' ELSE pdf_year END AS pdf_year FROM fx_papers p LEFT JOIN fx_pdfs f USING (paper_key)")
def e23(spark, sf):
    m = view(spark, sf, "fx_pdfs").select("paper_key", F.concat(F.lit("New "), "paper_key").alias("title"), F.lit("").alias("arxiv_id"), F.lit("ICLR").alias("venue"), F.lit("2030").alias("year"))
    return E.refresh_meta(view(spark, sf, "fx_papers"), m).select("paper_key", "pdf_title", "pdf_year")


@query("e24_prune_plan", "SELECT f.* FROM fx_pdfs f JOIN fx_papers p USING (paper_key) WHERE error IS NULL AND extractor_version = 5 AND abs(pdf_mtime - mtime) < 1 AND paper_key IN (SELECT paper_key FROM fx_sidecars)")
def e24(spark, sf):
    return E.prune_plan(view(spark, sf, "fx_pdfs"), view(spark, sf, "fx_sidecars"), view(spark, sf, "fx_papers"))


@query("e24_prune_totals", "SELECT count(*) AS n, sum(bytes) AS bytes FROM fx_pdfs f JOIN fx_papers p USING (paper_key) WHERE error IS NULL AND extractor_version = 5 AND abs(pdf_mtime - mtime) < 1 AND paper_key IN (SELECT paper_key FROM fx_sidecars)")
def e24t(spark, sf):
    return e24(spark, sf).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
