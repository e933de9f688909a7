"""Queries over the build of the gallery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lookups as L
from ..operators import build as B
from ..operators import gallery as G
from ..sources.fixtures import base, view
from .parts import FIGS, META, SHOWN, chart_case, figures, kind_case, map_case, sidecars, with_panels
from .registry import query

X = map_case("pred_label", L.NON_CHART_KIND, "NULL")
TITLE = "substring(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 1, 80)"


def _meta(spark, sf):
    return B.resolve_meta(view(spark, sf, "fx_papers"), sidecars(spark, sf))


def _shown(spark, sf):
    return B.hide_composites(with_panels(figures(spark, sf)))


def _files(spark, sf):
    """Stored files: a thumbnail of most figures, the full image of some, PNG for one in five."""
    f = view(spark, sf, "fx_figures").select("fig_id", "pos", "n_drawings")
    ext = F.when(F.col("n_drawings") % 5 == 0, "png").otherwise("webp")
    kinds = F.array(F.struct(F.lit(True).alias("is_thumb"), ext.alias("ext"), (F.col("pos") % 9 != 0).alias("there")), F.struct(F.lit(False).alias("is_thumb"), F.lit("png").alias("ext"), (F.col("pos") % 2 == 0).alias("there")))
    return f.select("fig_id", F.explode(F.filter(kinds, lambda x: x["there"])).alias("x")).select("fig_id", "x.is_thumb", "x.ext")


FILES = "fl AS (SELECT fig_id, true AS is_thumb, CASE WHEN n_drawings % 5 = 0 THEN 'png' ELSE 'webp' END AS ext FROM fx_figures WHERE pos % 9 <> 0 UNION ALL SELECT fig_id, false, 'png' FROM fx_figures WHERE pos % 2 = 0)"


def _index(spark, sf):
    return B.load_index(
        view(spark, sf, "fx_papers"), sidecars(spark, sf), with_panels(figures(spark, sf)), _files(spark, sf),
        figures_of=lambda papers: with_panels(figures(spark, sf, papers)),
    )


DEDUP = "dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_key, thumb_md5 ORDER BY pos) AS rn FROM sh WHERE paper_key IN (SELECT paper_key FROM mt)) WHERE rn = 1 OR thumb_md5 IS NULL)"
OVER = "ov AS (SELECT * REPLACE (CASE WHEN v2_category IS NOT NULL THEN v2_category ELSE v_category END AS v_category, CASE WHEN v2_category IS NOT NULL THEN coalesce(v2_chart_type, '') ELSE v_chart_type END AS v_chart_type) FROM {})"
KIND = f"""k1 AS (SELECT * REPLACE (CASE WHEN v_category IS NULL AND kind <> 'table' THEN {kind_case()} ELSE kind END AS kind) FROM {{}}),
k2 AS (SELECT * REPLACE (CASE WHEN v_category IS NULL AND coalesce(pred_label, '') <> '' THEN CASE WHEN parent IS NOT NULL THEN coalesce({X}, 'result') WHEN kind = 'result' THEN coalesce({X}, kind) ELSE kind END ELSE kind END AS kind) FROM k1)"""
GUESS = f"""gs AS MATERIALIZED (SELECT *, CASE WHEN (v_category = 'data' AND coalesce(v_chart_type, '') IN ('', 'other', 'mixed')) OR (v_category IS NULL AND kind = 'result') THEN
 coalesce(nullif(CASE WHEN parent IS NOT NULL AND coalesce(pred_label, '') <> '' THEN '' ELSE coalesce(nullif({chart_case('v_tags')}, ''), {chart_case('caption')}) END, ''),
 CASE WHEN coalesce(pred_label, '') NOT IN ('', 'other', 'x:method', 'x:background', 'x:example', 'x:table', 'x:prompt') THEN pred_label END) END AS chart_guess FROM {{}})"""
RECAP = "rc AS (SELECT * REPLACE (CASE WHEN parent IS NOT NULL THEN regexp_replace(caption, '\\s*\\[子图 (\\d+)/(\\d+)\\]', ' [\\1/\\2]', 'g') ELSE caption END AS caption) FROM {})"
INDEX = f"""{META}, {SHOWN}, {DEDUP}, {OVER.format('dd')}, {KIND.format('ov')}, {RECAP.format('k2')}, {GUESS.format('rc')},
nf AS (SELECT mt.*, c.n_figs, coalesce(nullif({TITLE}, ''), paper_key) AS fold_key FROM mt JOIN (SELECT paper_key, count(*) AS n_figs FROM gs GROUP BY paper_key) c USING (paper_key)),
pp AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold_key ORDER BY n_figs DESC, source = 'seed' DESC, paper_key || '.json') AS rn FROM nf) WHERE rn = 1),
ff AS (SELECT * FROM gs WHERE paper_key IN (SELECT paper_key FROM pp))"""
CAT = f"coalesce(nullif(v_category, ''), {map_case('kind', L.KIND_CATEGORY | {'table': 'table'}, repr('other'))})"


@query("b1_resolve_meta", f"WITH {META} SELECT paper_key, title, year, venue, authors_csv AS authors, citations, arxiv_id, source, area, award_rank FROM mt")
def b1(spark, sf):
    return _meta(spark, sf).select("paper_key", "title", "year", "venue", F.array_join("authors", ";").alias("authors"), "citations", "arxiv_id", "source", "area", "award_rank")


@query("b2_source_of", f"WITH {META} SELECT source, count(*) AS n FROM mt GROUP BY source")
def b2(spark, sf):
    return _meta(spark, sf).groupBy("source").agg(F.count("*").alias("n"))


@query("b3_award_of", f"WITH {META} SELECT paper_key, award_rank, award_en FROM mt")
def b3(spark, sf):
    return _meta(spark, sf).select("paper_key", "award_rank", "award_en")


@query("b4_norm_venue", f"SELECT paper_key, {map_case('lower(trim(venue_hint))', L.VENUE_ALIASES, 'trim(venue_hint)')} AS venue FROM fx_sidecars")
def b4(spark, sf):
    return view(spark, sf, "fx_sidecars").select("paper_key", C.norm_venue(F.col("venue_hint")).alias("venue"))


@query("b5_area_of", f"WITH {META} SELECT area, venue, count(*) AS n FROM mt GROUP BY area, venue")
def b5(spark, sf):
    return _meta(spark, sf).groupBy("area", "venue").agg(F.count("*").alias("n"))


@query("b6_dedupe_images", f"WITH {SHOWN} SELECT fig_id, CAST(thumb_bytes AS DOUBLE) / greatest(1, tw * th) * 1000 AS ratio, substring(thumb_md5, 1, 8) AS v FROM (SELECT *, row_number() OVER (PARTITION BY paper_key, thumb_md5 ORDER BY pos) AS rn FROM sh) WHERE rn = 1 OR thumb_md5 IS NULL")
def b6(spark, sf):
    return B.dedupe_images(_shown(spark, sf)).select("fig_id", "ratio", "v")


@query("b6_text_copies", "SELECT source, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY source, md5(text)")
def b6_docs(spark, sf):
    d = base(spark, sf, "documents").select("source", "doc_id", F.md5("text").alias("h"))
    return d.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("h")


@query("b7_hash_delta", "WITH t AS (SELECT fig_id || '.thumb.webp' AS name, thumb_bytes + 0.75 AS mtime, fig_id || '.thumb.webp:' || thumb_bytes AS key, pos FROM fx_figures) SELECT name, mtime, key FROM t WHERE pos % 9 <> 0 AND pos % 4 = 0")
def b7(spark, sf):
    t = view(spark, sf, "fx_figures").select(F.concat("fig_id", F.lit(".thumb.webp")).alias("name"), (F.col("thumb_bytes") + 0.75).cast("double").alias("mtime"), "pos", "thumb_bytes")
    cache = t.filter("pos % 4 <> 0").select(F.concat("name", F.lit(":"), F.col("thumb_bytes").cast("string")).alias("key"))
    return B.hash_delta(t.filter("pos % 9 <> 0").select("name", "mtime"), cache)


@query("b8_overlay_second_opinion", f"WITH {FIGS}, {OVER.format('fg')} SELECT fig_id, v_category, v_chart_type FROM ov")
def b8(spark, sf):
    return B.overlay_second_opinion(figures(spark, sf).withColumn("manual", F.lit(False))).select("fig_id", "v_category", "v_chart_type")


@query("b9_rewrite_panel_captions", f"WITH {SHOWN}, {RECAP.format('sh')} SELECT fig_id, caption FROM rc")
def b9(spark, sf):
    return B.rewrite_panel_captions(_shown(spark, sf)).select("fig_id", "caption")


@query("b10_reconcile_kind", f"WITH {SHOWN}, {KIND.format('sh')} SELECT fig_id, kind FROM k2")
def b10(spark, sf):
    return B.reconcile_kind(_shown(spark, sf)).select("fig_id", "kind")


@query("b11_chart_guess", f"WITH {SHOWN}, {GUESS.format('sh')} SELECT fig_id, chart_guess FROM gs")
def b11(spark, sf):
    return B.chart_guess(_shown(spark, sf)).select("fig_id", "chart_guess")


@query("b12_asset_urls", f"""WITH {FILES}, b AS (SELECT fig_id, bool_or(is_thumb AND ext = 'webp') AS tw, bool_or(is_thumb AND ext = 'png') AS tp, bool_or(NOT is_thumb AND ext = 'webp') AS fw, bool_or(NOT is_thumb AND ext = 'png') AS fp FROM fl GROUP BY fig_id)
SELECT f.fig_id, 'figs/' || f.fig_id || '.thumb' || CASE WHEN NOT coalesce(b.tw, false) AND coalesce(tp, false) THEN '.png' ELSE '.webp' END || '?v=' || substring(thumb_md5, 1, 8) AS thumb,
 'figs/' || f.fig_id || CASE WHEN NOT coalesce(fw, false) AND coalesce(fp, false) THEN '.png' ELSE '.webp' END || '?v=' || substring(thumb_md5, 1, 8) AS full FROM fx_figures f LEFT JOIN b USING (fig_id)""")
def b12(spark, sf):
    return B.asset_urls(view(spark, sf, "fx_figures").withColumn("v", F.substring("thumb_md5", 1, 8)), _files(spark, sf)).select("fig_id", "thumb", "full")


@query("b13_fold_by_title", f"""WITH {META}, n AS (SELECT mt.*, c.n_figs, coalesce(nullif({TITLE}, ''), paper_key) AS fold_key FROM mt JOIN (SELECT paper_key, count(*) AS n_figs FROM fx_figures GROUP BY paper_key) c USING (paper_key))
SELECT paper_key, fold_key FROM (SELECT *, row_number() OVER (PARTITION BY fold_key ORDER BY n_figs DESC, source = 'seed' DESC, paper_key || '.json') AS rn FROM n) WHERE rn = 1""")
def b13(spark, sf):
    counts = view(spark, sf, "fx_figures").groupBy("paper_key").agg(F.count("*").alias("n_figs"))
    return B.fold_by_title(_meta(spark, sf).join(counts, "paper_key"))


@query("b14_load_index", f"WITH {INDEX} SELECT ff.paper_key, fig_id, title, venue, area, year, kind, v_category, v_chart_type, chart_guess FROM ff JOIN pp USING (paper_key)")
def b14(spark, sf):
    papers, figs = _index(spark, sf)
    return figs.select("paper_key", "fig_id", "kind", "v_category", "v_chart_type", "chart_guess").join(papers.select("paper_key", "title", "venue", "area", "year"), "paper_key")


@query("g_area_categories", f"WITH {INDEX} SELECT area, {CAT} AS category, count(*) AS n_figures, count(DISTINCT paper_key) AS n_papers FROM ff JOIN pp USING (paper_key) GROUP BY area, {CAT}")
def flagship(spark, sf):
    papers, figs = _index(spark, sf)
    cat = F.coalesce(C.blank_to_null(F.col("v_category")), C.kind_category(F.col("kind"), tables=True))
    return figs.select("paper_key", cat.alias("category")).join(papers.select("paper_key", "area"), "paper_key").groupBy("area", "category").agg(F.count("*").alias("n_figures"), F.count_distinct("paper_key").alias("n_papers"))


def _fmt(e):
    return f"trim(format('{{:,}}', {e}))"


@query("b15_site_numbers", f"""WITH {META}, {FIGS}, c AS (SELECT {CAT} AS cat, v_chart_type FROM fg)
SELECT {_fmt('(SELECT count(*) FROM mt)')} AS n_papers, {_fmt("(SELECT count(DISTINCT nullif(venue, '')) FROM mt)")} AS n_venues, {_fmt("(SELECT count(DISTINCT nullif(area, '')) FROM mt)")} AS n_areas,
 {_fmt("count(*) FILTER (cat = 'table')")} AS n_table, {_fmt("count(*) FILTER (cat = 'data')")} AS n_data, {_fmt("count(*) FILTER (cat = 'method')")} AS n_method,
 {_fmt("count(*) FILTER (cat = 'data' AND v_chart_type = 'heatmap')")} AS n_heatmap, {_fmt("count(*) FILTER (cat = 'data' AND v_chart_type = 'line')")} AS n_line, {_fmt("count(*) FILTER (cat = 'data' AND v_chart_type = 'bar')")} AS n_bar FROM c""")
def b15(spark, sf):
    return B.site_numbers(_meta(spark, sf), figures(spark, sf))


@query("b16_n_originals", f"WITH {SHOWN} SELECT count(*) FILTER (parent IS NULL) + (SELECT count(*) FROM (SELECT DISTINCT paper_key, parent FROM sh WHERE parent IS NOT NULL) d WHERE parent NOT IN (SELECT fig_id FROM sh)) AS n_figures FROM sh")
def b16(spark, sf):
    return B.n_originals(_shown(spark, sf))


@query("b17_data_updated", "SELECT strftime(max(ts), '%Y-%m-%d') AS updated FROM events")
def b17(spark, sf):
    return B.data_updated(base(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("modified")))


PICTURE = {"px_w": "tw * 3", "px_h": "CASE WHEN pos % 2 = 0 THEN th * 3 END", "rotated": "CASE WHEN n_drawings % 7 = 0 THEN 90 END", "density": "CASE WHEN n_drawings % 3 > 0 THEN n_drawings / 4.0E0 END"}
NAMES_OF = {"thumb": "concat('figs/', fig_id, '.thumb.webp?v=', substring(thumb_md5, 1, 8))", "full": "concat('figs/', fig_id, '.webp')", "chart_guess": "CASE WHEN n_drawings % 5 = 0 THEN 'bar' END"}
MORE = {"v_summary_zh": "CASE WHEN pos % 3 = 0 THEN concat('图 ', num) END", "v_verified": "v2_category"}
SLIM = {**PICTURE, **NAMES_OF, **MORE}
_FIELDS = ", ".join(f"'{c}': \"{c}\"" for c in B.SLIM_FIELDS)
_EXTRA = ", ".join(f"'{c}': coalesce({c}, 0)" for c in B.SLIM_EXTRA)


@query("b18_slim_index", f"""WITH {META}, {FIGS}, sx AS (SELECT * EXCLUDE (v_tags), CASE WHEN v_category IS NOT NULL THEN ['icons', v_category] END AS v_tags, {", ".join(f'{e} AS "{c}"' for c, e in SLIM.items())} FROM fg),
sj AS (SELECT paper_key, list({{{_FIELDS}, 'extra': {{{_EXTRA}, 'dpi': coalesce(dpi, 170)}}, 'vision': CASE WHEN v_category IS NOT NULL THEN {{'category': v_category, 'chart_type': v_chart_type, 'tags': v_tags, 'summary_zh': v_summary_zh, 'verified': v_verified}} END}} ORDER BY pos) AS figs
 FROM sx JOIN mt USING (paper_key) GROUP BY paper_key)
SELECT mt.paper_key, to_json({{'title': title, 'authors': CASE WHEN authors_csv = '' THEN [] ELSE string_split(authors_csv, ';')[1:6] END}}) AS meta, coalesce(to_json(figs), '[]') AS figures FROM mt LEFT JOIN sj USING (paper_key)""")
def b18(spark, sf):
    # figures are dealt by paper before paths and nested fields are made of them
    f = figures(spark, sf).withColumn("thumb_md5", F.substring("thumb_md5", 1, 8)).repartition("paper_key").withColumns({c: F.expr(e) for c, e in SLIM.items()})
    keep = {"ignoreNullFields": "false"}
    slim = B.slim_index(_meta(spark, sf), f)
    return slim.select("paper_key", F.to_json(F.struct("title", "authors"), keep).alias("meta"), F.to_json("figures", keep).alias("figures"))


@query("b19_assign_shards", f"WITH {META} SELECT paper_key, CAST(floor((row_number() OVER (ORDER BY paper_key) - 1) / ceil(count(*) OVER () / 4.0)) AS INT) AS shard FROM mt")
def b19(spark, sf):
    return B.assign_shards(_meta(spark, sf).select("paper_key"), 4)


@query("b20_exclude_sources", f"WITH {META} SELECT paper_key, source FROM mt WHERE source NOT IN ('local')")
def b20(spark, sf):
    return B.exclude_sources(_meta(spark, sf)).select("paper_key", "source")


def _names(spark, sf):
    name = F.concat("fig_id", F.when(F.col("is_thumb"), ".thumb").otherwise(""), F.lit("."), "ext")
    return _files(spark, sf).select(name.alias("name"))


NAMES = f"{FILES}, nm AS (SELECT fig_id, fig_id || CASE WHEN is_thumb THEN '.thumb' ELSE '' END || '.' || ext AS name FROM fl)"


@query("b21_publish_files", f"WITH {NAMES}, {META}, {FIGS} SELECT fig_id, name FROM nm WHERE fig_id IN (SELECT fig_id FROM fg JOIN mt USING (paper_key) WHERE n_panels < 2 AND source <> 'local')")
def b21(spark, sf):
    live = B.hide_composites(figures(spark, sf)).join(B.exclude_sources(_meta(spark, sf)).select("paper_key"), "paper_key", "left_semi")
    return B.publish_files(_names(spark, sf), live)


@query("b22_stale_files", f"WITH {NAMES} SELECT fig_id, name FROM nm WHERE fig_id NOT IN (SELECT fig_id FROM fx_figures f JOIN fx_papers p USING (paper_key) WHERE error IS NULL)")
def b22(spark, sf):
    good = view(spark, sf, "fx_papers").filter("error IS NULL").select("paper_key")
    return B.stale_files(_names(spark, sf), view(spark, sf, "fx_figures").join(good, "paper_key", "left_semi"))


_AREA_ROWS = ", ".join(f"{{'id': '{i}', 'zh': '{zh}', 'en': '{en}', 'group': '{g}', 'top': {list(top)}}}" for i, zh, en, g, top, _ in L.AREAS)


@query("b23_index_header", f"WITH {META}, {SHOWN} SELECT (SELECT count(*) FROM mt) AS n_papers, count(*) FILTER (parent IS NULL) + count(DISTINCT parent) AS n_figures, count(*) AS n_entries, (SELECT strftime(max(ts), '%Y-%m-%d') FROM events) AS updated, 28 AS n_areas, to_json([{_AREA_ROWS}]) AS areas FROM sh")
def b23(spark, sf):
    files = base(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("modified"))
    return B.index_header(_meta(spark, sf), _shown(spark, sf), files).withColumn("n_areas", F.size("areas")).withColumn("areas", F.to_json("areas"))


@query("x6_hide_composites", f"WITH {SHOWN} SELECT fig_id, parent FROM sh")
def x6(spark, sf):
    return _shown(spark, sf).select("fig_id", "parent")


@query("s8_embed_safe_json", "SELECT page_id, md5(replace(replace(replace(html, '&', chr(92) || 'u0026'), '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e')) AS safe FROM pages")
def s8(spark, sf):
    from ..sources.writers import embed_safe

    return base(spark, sf, "pages").select("page_id", F.md5(embed_safe(F.col("html"))).alias("safe"))


# the gallery


def _gallery(spark, sf):
    """One row per shown figure with its paper's fields."""
    cat = F.coalesce(C.blank_to_null(F.col("v_category")), C.kind_category(F.col("kind"), tables=True))
    f = _shown(spark, sf).select("paper_key", "fig_id", "caption", cat.alias("category"), F.col("v_chart_type").alias("chart_type"), F.col("v_tags").alias("tags"))
    return f.join(_meta(spark, sf).select("paper_key", "title", "arxiv_id", "venue", "area", "year", "award_en"), "paper_key")


GALLERY = f"{META}, {SHOWN}, gl AS (SELECT sh.paper_key, fig_id, caption, {CAT} AS category, v_chart_type AS chart_type, v_tags AS tags, title, arxiv_id, venue, area, year, award_en FROM sh JOIN mt USING (paper_key))"
TEXT = "lower(caption || ' ' || title || ' ' || tags || ' ' || arxiv_id)"


@query("g1_search", f"WITH {GALLERY} SELECT fig_id FROM gl WHERE contains({TEXT}, 'figure') AND contains({TEXT}, 'study') AND category = 'data' AND chart_type = 'bar' AND contains(tags, 'icons')")
def g1(spark, sf):
    return G.search(_gallery(spark, sf), q="Figure STUDY", cat="data", chart="bar", tag="icons").select("fig_id")


@query("g1_search_area", f"WITH {GALLERY} SELECT fig_id FROM gl WHERE contains({TEXT}, 'overview') AND area = 'ml' AND award_en = 'Best paper'")
def g1b(spark, sf):
    return G.search(_gallery(spark, sf), q="overview", area="ml", award="Best paper").select("fig_id")


@query("g2_figure_detail", f"WITH {META}, {FIGS} SELECT fig_id, caption, title, venue, year FROM fg JOIN mt USING (paper_key) WHERE fig_id = (SELECT min(fig_id) FROM fx_figures WHERE paper_key = 'o1')")
def g2(spark, sf):
    figs = figures(spark, sf)
    one = figs.filter("paper_key = 'o1'").agg(F.min("fig_id")).first()[0]
    return G.figure_detail(figs, _meta(spark, sf), one).select("fig_id", "caption", "title", "venue", "year")


@query("g3_facet_counts", f"""WITH {GALLERY} SELECT 'category' AS facet, category AS value, '' AS detail, count(*) AS n FROM gl GROUP BY 2
UNION ALL SELECT 'chart_type', chart_type, '', count(*) FROM gl WHERE category = 'data' AND coalesce(chart_type, '') <> '' GROUP BY 2
UNION ALL SELECT 'venue', venue, area, count(*) FROM gl WHERE venue <> '' GROUP BY 2, 3 UNION ALL SELECT 'award', award_en, '', count(*) FROM gl WHERE award_en <> '' GROUP BY 2
UNION ALL SELECT 'tag', t, '', count(*) FROM (SELECT unnest(string_split(tags, ' ; ')) AS t FROM gl WHERE tags <> '') GROUP BY 2""")
def g3(spark, sf):
    return G.facet_counts(_gallery(spark, sf))


@query("g4_ranked_editions", f"WITH {META} SELECT paper_key, venue, year, row_number() OVER (PARTITION BY venue, year ORDER BY award_rank, citations DESC, paper_key) AS place FROM mt")
def g4(spark, sf):
    return G.ranked_editions(_meta(spark, sf)).select("paper_key", "venue", "year", "place")
