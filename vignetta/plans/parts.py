"""Record tables that the queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lookups as L
from ..sources.fixtures import base, view

PRED = ("bar", "line", "other", "x:method", "x:table")


def sidecars(spark, sf) -> DataFrame:
    s = view(spark, sf, "fx_sidecars")
    return s.withColumn("authors", F.when(F.col("authors_csv") == "", F.array().cast("array<string>")).otherwise(F.split("authors_csv", ";")))


def lines_of(spark, sf, papers: DataFrame) -> DataFrame:
    """Lines that figures of papers (paper_key) are made of; the view's window takes a paper's lines, so the others are left out before it."""
    lines = base(spark, sf, "lineitem")
    return lines.join(papers, F.concat(F.lit("o"), lines["l_orderkey"].cast("string")) == papers["paper_key"], "left_semi")


def figures(spark, sf, papers: DataFrame | None = None) -> DataFrame:
    """Whole figures, of all papers or of some, with caption kind, a prediction for five in six, and the panels of those that split."""
    f = view(spark, sf, "fx_figures", **({} if papers is None else {"lineitem": lines_of(spark, sf, papers)}))
    kind = F.when(F.col("fig_id").contains("__tab"), "table").otherwise(C.caption_kind(F.col("caption"), F.col("num"), F.col("page"), F.col("has_raster"), F.col("n_drawings")))
    label = None
    for i, p in enumerate(PRED):
        label = F.when(F.col("n_drawings") % 6 == i, p) if label is None else label.when(F.col("n_drawings") % 6 == i, p)
    n = F.col("n_drawings") % 4
    return f.withColumns({
        "kind": kind, "pred_label": label, "pred_p": (F.col("n_drawings") % 10) / 10.0, "v_tags": F.when(F.col("v_category").isNotNull(), F.array(F.lit("icons"), F.col("v_category"))),
        "v2_chart_type": F.when(F.col("v2_category").isNotNull(), "line"), "parent": F.lit(None).cast("string"), "panel": F.lit(None).cast("int"), "n_panels": n,
        "panels": F.when(n >= 2, F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.col("fig_id"), F.lit("_s"), k.cast("string")))).when(n == 1, F.array().cast("array<string>")),
    })


def with_panels(figs: DataFrame) -> DataFrame:
    """Figures and the panels of those that split, in one table; a panel has no thumbnail of its own here."""
    rows = figs.withColumn("_k", F.explode(F.when(F.col("n_panels") >= 2, F.sequence(F.lit(0), F.col("n_panels"))).otherwise(F.array(F.lit(0)))))
    child, k = F.col("_k") > 0, F.col("_k").cast("string")
    own = {
        "parent": F.col("fig_id"), "panel": F.col("_k"), "fig_id": F.concat("fig_id", F.lit("_s"), k), "caption": F.concat("caption", F.lit(" [子图 "), k, F.lit("/"), F.col("n_panels").cast("string"), F.lit("]")),
        **{c: F.lit(None) for c in ("panels", "thumb_md5", "v_category", "v_chart_type", "v2_category", "v2_chart_type", "v_tags")},
    }
    return rows.withColumns({c: F.when(child, v).otherwise(F.col(c)) for c, v in own.items()}).select(*figs.columns)


def chart_case(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), '{w}') THEN '{n}'" for n, w in L.CHART_WORDS) + " ELSE '' END"


def kind_case(p: str = "") -> str:
    c = f"{p}caption"
    result, method, example, prompt = (f"regexp_matches({c}, '{w}')" for w in (L.RESULT_WORDS, L.METHOD_WORDS, L.EXAMPLE_WORDS, L.PROMPT_WORDS))
    return (
        f"CASE WHEN {prompt} AND NOT {p}has_raster AND {p}n_drawings < 12 THEN 'prompt' WHEN {p}num = '1' AND {p}page <= 2 AND NOT {result} THEN 'teaser' WHEN {result} AND NOT {p}has_raster THEN 'result' "
        f"WHEN {method} THEN 'method' WHEN {example} AND {p}has_raster THEN 'example' WHEN {result} THEN 'result' WHEN {example} OR {p}has_raster THEN 'example' ELSE 'other' END"
    )


def map_case(expr: str, table: dict, otherwise: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


FIGS = f"""fg AS MATERIALIZED (SELECT *, CASE WHEN contains(fig_id, '__tab') THEN 'table' ELSE {kind_case()} END AS kind,
 CASE n_drawings % 6 WHEN 0 THEN 'bar' WHEN 1 THEN 'line' WHEN 2 THEN 'other' WHEN 3 THEN 'x:method' WHEN 4 THEN 'x:table' END AS pred_label, (n_drawings % 10) / 10.0 AS pred_p,
 CASE WHEN v_category IS NOT NULL THEN 'icons ; ' || v_category ELSE '' END AS v_tags, CASE WHEN v2_category IS NOT NULL THEN 'line' END AS v2_chart_type, n_drawings % 4 AS n_panels, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS INT) AS panel FROM fx_figures)"""
#: Visible rows: figures that don't split and all panels.
SHOWN = f"""{FIGS}, wh AS (SELECT paper_key, pos, page, num, fig_id, caption, has_raster, n_drawings, full_width, v_category, v_chart_type, v2_category, v2_chart_type, v_tags, thumb_md5, tw, th, thumb_bytes, kind, pred_label, pred_p, n_panels, parent, panel FROM fg WHERE n_panels < 2),
pn AS (SELECT paper_key, pos, page, num, fig_id || '_s' || k AS fig_id, caption || ' [子图 ' || k || '/' || n_panels || ']' AS caption, has_raster, n_drawings, full_width, NULL AS v_category, NULL AS v_chart_type, NULL AS v2_category, NULL AS v2_chart_type, '' AS v_tags, NULL AS thumb_md5, tw, th, thumb_bytes, kind, pred_label, pred_p, n_panels, fig_id AS parent, k AS panel
 FROM (SELECT *, unnest(generate_series(1, n_panels)) AS k FROM fg WHERE n_panels >= 2)),
sh AS (SELECT * FROM wh UNION ALL SELECT * FROM pn)"""
VENUES = "vt(name, area, ord) AS (VALUES " + ", ".join(f"('{v}', '{a}', {i})" for v, a, i in L.venue_areas()) + ")"
META = f"""{VENUES}, m0 AS (SELECT p.paper_key, coalesce(nullif(s.title, ''), pdf_title, '') AS title,
 coalesce(nullif(year_hint, ''), nullif(substring(published, 1, 4), ''), nullif(pdf_year, ''), nullif(s2_year, ''), '') AS year, coalesce(nullif(venue_hint, ''), pdf_venue, '') AS rv,
 coalesce(authors_csv, '') AS authors_csv, coalesce(citations, 0) AS citations, pdf_arxiv_id AS arxiv_id, coalesce(note, '') AS note, coalesce(url, '') AS url, s.paper_key IS NOT NULL AS has_side, dpi
 FROM fx_papers p LEFT JOIN fx_sidecars s USING (paper_key) WHERE error IS NULL),
m1 AS MATERIALIZED (SELECT *, {map_case('lower(rv)', L.VENUE_ALIASES, 'rv')} AS venue, CASE WHEN NOT has_side THEN 'local' WHEN regexp_matches(lower(note), 'best|outstanding|distinguished|honou?rable|award') THEN 'award' WHEN url <> '' THEN 'seed' ELSE 'local' END AS source FROM m0),
ar AS (SELECT v, area FROM (SELECT v, area, row_number() OVER (PARTITION BY v ORDER BY length(name) DESC, ord) AS n FROM (SELECT DISTINCT venue AS v FROM m1) JOIN vt ON regexp_matches(lower(v), '(^|[^a-z])' || name || '([^a-z]|$)')) WHERE n = 1),
mt AS MATERIALIZED (SELECT m1.* EXCLUDE (rv, has_side), coalesce(ar.area, CASE WHEN arxiv_id <> '' THEN 'preprint' ELSE '' END) AS area,
 CASE {" ".join(f"WHEN regexp_matches(lower(note), '{w}') THEN {r}" for r, _, _, w in L.AWARD_TIERS)} WHEN regexp_matches(lower(note), '\\brecent \\(') THEN 5 WHEN source = 'seed' THEN 4 ELSE 5 END AS award_rank,
 CASE {" ".join(f"WHEN regexp_matches(lower(note), '{w}') THEN '{e}'" for _, _, e, w in L.AWARD_TIERS)} WHEN regexp_matches(lower(note), '\\brecent \\(') THEN 'Recent' WHEN source = 'seed' THEN 'High impact' ELSE '' END AS award_en FROM m1 LEFT JOIN ar ON ar.v = m1.venue)"""
