"""Queries over labels and the chart-type model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import chartmodel as M
from ..operators import labels as C
from ..session import saved
from ..sources.fixtures import base, view
from .parts import FIGS, META, SHOWN, chart_case, figures, map_case, sidecars, with_panels
from .q_build import _meta
from .registry import query

THUMBS = "fig_id IN (SELECT fig_id FROM fx_figures WHERE pos % 9 <> 0)"
CATS = ", ".join(f"'{c}'" for c in L.CATEGORIES)
TYPES = ", ".join(f"'{c}'" for c in L.CHART_TYPES)
LABELS = f"""r AS (SELECT fig_id, CAST(regexp_replace(reply, '^`+(json)?|`+$', '', 'g') AS JSON) AS j FROM fx_responses),
c AS (SELECT fig_id, lower(trim(j->>'category')) AS cat, lower(trim(j->>'chart_type')) AS ct, CASE WHEN json_type(j->'tags') = 'ARRAY' THEN CAST(j->'tags' AS VARCHAR[]) ELSE string_split(j->>'tags', ',') END AS tg FROM r),
lb AS (SELECT fig_id, CASE WHEN cat IN ({CATS}) THEN cat ELSE 'other' END AS category, CASE WHEN cat <> 'data' OR cat NOT IN ({CATS}) THEN '' WHEN ct IN ({TYPES}) THEN ct ELSE 'other' END AS chart_type,
 array_to_string(list_filter(list_transform(tg, lambda x: lower(trim(x))), lambda x: x <> '')[1:6], '|') AS tags FROM c)"""
EFF = f"""CASE WHEN v2_category IS NOT NULL THEN v2_category WHEN v_category IS NOT NULL THEN v_category ELSE {map_case('kind', L.KIND_CATEGORY, repr('other'))} END"""


def _thumbs(spark, sf):
    return view(spark, sf, "fx_figures").filter("pos % 9 <> 0").select("fig_id")


@query("c1_parse_labels", f"WITH {LABELS} SELECT * FROM lb")
def c1(spark, sf):
    return C.parse_labels(view(spark, sf, "fx_responses")).select("fig_id", "category", "chart_type", F.array_join("tags", "|").alias("tags"))


@query("c2_effective_label", f"WITH {FIGS} SELECT fig_id, {EFF} AS category, CASE WHEN v2_category IS NOT NULL THEN 'line' ELSE coalesce(v_chart_type, '') END AS chart_type FROM fg")
def c2(spark, sf):
    return C.effective_label(figures(spark, sf)).select("fig_id", F.col("eff_category").alias("category"), F.col("eff_chart_type").alias("chart_type"))


@query("c3_classify_queue", f"""WITH {META}, {SHOWN} SELECT fig_id, CASE WHEN pred_p >= 0.8 THEN 1 ELSE 0 END AS sure, coalesce(award_rank, 6) AS rank FROM (SELECT * FROM sh) s LEFT JOIN mt USING (paper_key)
WHERE v_category IS NULL AND (parent IS NOT NULL OR kind = 'result') AND {THUMBS} ORDER BY 2, 3, s.paper_key || '.json', pos, fig_id""")
def c3(spark, sf):
    f = saved(figures(spark, sf).select("paper_key", "pos", "fig_id", "caption", "kind", "v_category", "v_chart_type", "v2_category", "v2_chart_type", "v_tags", "pred_label", "pred_p", "parent", "panel", "n_panels", "panels", "thumb_md5"), "figures")
    q = C.classify_queue(with_panels(f), f.filter("pos % 9 <> 0").select("fig_id"), _meta(spark, sf).select("paper_key", "award_rank"), only_charts=True)
    return q.select("fig_id", "sure", "rank")


@query("c4_verify_queue", f"WITH {SHOWN} SELECT fig_id, {EFF} AS category FROM sh WHERE v2_category IS NULL AND {EFF} IN ('data', 'method') AND v_category IS NOT NULL AND {THUMBS}")
def c4(spark, sf):
    return C.verify_queue(with_panels(figures(spark, sf)), _thumbs(spark, sf), ("data", "method"), include_unlabeled=False).select("fig_id", F.col("eff_category").alias("category"))


@query("c5_write_back", f"WITH {LABELS}, {FIGS}, g AS (SELECT fig_id, CASE WHEN pos % 8 = 1 THEN 'prompt' ELSE category END AS category, CASE WHEN pos % 8 = 1 THEN '' ELSE chart_type END AS chart_type FROM lb JOIN (SELECT fig_id, pos FROM fx_figures) p USING (fig_id) WHERE pos % 4 = 1) SELECT fg.fig_id, coalesce(g.category, v_category) AS v_category, CASE WHEN g.fig_id IS NOT NULL THEN g.chart_type ELSE v_chart_type END AS v_chart_type FROM fg LEFT JOIN g USING (fig_id)")
def c5(spark, sf):
    """Labels with failed ones, unknown ids and, for one figure in eight, a second label that comes later."""
    pos = view(spark, sf, "fx_figures").select("fig_id", "pos", F.when(F.col("pos") % 4 != 1, "failed").alias("error"))
    labels = saved(C.parse_labels(view(spark, sf, "fx_responses")).join(pos, "fig_id").withColumn("seq", F.lit(1)), "labels")
    extra = labels.withColumn("fig_id", F.concat(F.lit("none"), "fig_id"))
    again = labels.filter("pos % 8 = 1").withColumns({"category": F.lit("prompt"), "chart_type": F.lit(""), "seq": F.lit(2)})
    return C.write_back(figures(spark, sf), labels.unionByName(extra).unionByName(again)).select("fig_id", "v_category", "v_chart_type")


@query("c6_label_progress", "SELECT paper_key, count(*) FILTER (n_drawings % 5 > 0) AS calls, sum(CASE WHEN n_drawings % 5 > 0 THEN 300 + n_drawings ELSE 0 END) AS prompt_tokens, sum(CASE WHEN n_drawings % 5 > 0 THEN pos * 7 ELSE 0 END) AS completion_tokens, count(*) FILTER (n_drawings % 11 = 0 AND n_drawings % 5 > 0) AS errors, count(*) FILTER (n_drawings % 5 = 0) AS remaining FROM fx_figures GROUP BY paper_key")
def c6(spark, sf):
    done = F.col("n_drawings") % 5 > 0
    r = view(spark, sf, "fx_figures").select("paper_key", done.alias("done"), F.when(done, 300 + F.col("n_drawings")).otherwise(0).alias("prompt_tokens"), F.when(done, F.col("pos") * 7).otherwise(0).alias("completion_tokens"), F.when(done & (F.col("n_drawings") % 11 == 0), "timeout").alias("error"))
    return C.label_progress(r)


OV = "o AS (SELECT fig_id, CASE WHEN pos % 2 = 0 THEN 'data' END AS category, 'point' AS chart_type FROM fx_figures WHERE n_drawings % 7 = 2)"


@query("c7_apply_overrides", f"""WITH {SHOWN}, {OV} SELECT sh.fig_id, CASE WHEN a.fig_id IS NOT NULL THEN coalesce(a.category, v_category, 'data') WHEN b.fig_id IS NOT NULL THEN coalesce(b.category, v_category, 'data') ELSE v_category END AS v_category,
CASE WHEN a.fig_id IS NOT NULL OR b.fig_id IS NOT NULL THEN 'point' ELSE v_chart_type END AS v_chart_type, a.fig_id IS NOT NULL OR b.fig_id IS NOT NULL AS manual FROM sh LEFT JOIN o a ON a.fig_id = sh.fig_id LEFT JOIN o b ON b.fig_id = sh.parent""")
def c7(spark, sf):
    f = view(spark, sf, "fx_figures").filter("n_drawings % 7 = 2")
    first = f.select("fig_id", F.lit("table").alias("category"), F.lit("bar").alias("chart_type")).filter("length(fig_id) % 2 = 0")
    later = f.select("fig_id", F.when(F.col("pos") % 2 == 0, "data").alias("category"), F.lit("point").alias("chart_type"))
    shown = with_panels(figures(spark, sf)).filter("coalesce(size(panels), 0) <= 0")
    return C.apply_overrides(shown, C.merge_overrides([first, later])).select("fig_id", "v_category", "v_chart_type", "manual")


@query("c8_chart_from_text", f"WITH {FIGS} SELECT fig_id, coalesce(nullif({chart_case('v_tags')}, ''), {chart_case('caption')}) AS chart FROM fg")
def c8(spark, sf):
    return figures(spark, sf).select("fig_id", C.chart_class(F.col("v_tags"), F.col("caption")).alias("chart"))


@query("c9_label_figures", f"WITH {FIGS} SELECT coalesce(v_category, {map_case('kind', L.KIND_CATEGORY, repr('other'))}) AS category, count(*) AS n FROM fg GROUP BY 1")
def c9(spark, sf):
    return C.label_figures(figures(spark, sf)).groupBy(F.col("v_category").alias("category")).agg(F.count("*").alias("n"))


# the chart-type model

AL = map_case("x", M.ALIAS, "x")


def _al(e):
    return map_case(e, M.ALIAS, e)


LAB = f"""lab AS (SELECT *, CASE WHEN v_category = 'data' THEN CASE WHEN nullif(nullif({_al("coalesce(v_chart_type, '')")}, ''), 'other') IS NOT NULL THEN {_al('v_chart_type')} ELSE coalesce(nullif({_al('g')}, ''), 'other') END
 WHEN v_category IS NULL THEN nullif({_al('g')}, '') ELSE {map_case('v_category', M.NON_CHART, 'NULL')} END AS label FROM (SELECT *, CASE WHEN parent IS NULL THEN coalesce(nullif({chart_case('v_tags')}, ''), {chart_case('caption')}) ELSE '' END AS g FROM sh))"""
CAND = f"""cd AS (SELECT fig_id, pos FROM sh WHERE (coalesce(v_category, '') = 'data' AND coalesce(nullif({_al('v_chart_type')}, ''), 'other') = 'other') OR (v_category IS NULL AND (kind = 'result' OR parent IS NOT NULL)))"""


def _shown(spark, sf):
    return with_panels(figures(spark, sf)).filter("coalesce(size(panels), 0) <= 0")


@query("m1_training_label", f"WITH {SHOWN}, {LAB} SELECT fig_id, label FROM lab")
def m1(spark, sf):
    return M.training_label(_shown(spark, sf)).select("fig_id", "label")


@query("m2_chart_candidates", f"WITH {SHOWN}, {CAND} SELECT fig_id FROM cd")
def m2(spark, sf):
    return M.chart_candidates(_shown(spark, sf)).select("fig_id")


@query("m3_embedding_delta", f"WITH {SHOWN}, {CAND}, k AS (SELECT cd.fig_id, cd.fig_id || '|' || f.thumb_bytes AS fig_key, f.pos FROM cd JOIN fx_figures f USING (fig_id) WHERE f.pos % 9 <> 0) SELECT 'new' AS what, fig_key FROM k WHERE pos % 4 = 0 UNION ALL SELECT 'live', fig_key FROM k WHERE pos % 4 <> 0")
def m3(spark, sf):
    f = view(spark, sf, "fx_figures")
    thumbs = f.filter("pos % 9 <> 0").select("fig_id", (F.col("thumb_bytes") + 0.5).alias("mtime"))
    cache = f.filter("pos % 4 <> 0").select(F.concat("fig_id", F.lit("|"), F.col("thumb_bytes").cast("string")).alias("fig_key"))
    new, live = M.embedding_delta(M.chart_candidates(_shown(spark, sf)), thumbs, cache)
    return new.select(F.lit("new").alias("what"), "fig_key").unionByName(live.select(F.lit("live").alias("what"), "fig_key"))


@query("m4_normalize_embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm2, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS first FROM embeddings")
def m4(spark, sf):
    n = M.normalize_embeddings(base(spark, sf, "embeddings"))
    return n.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"), F.round(F.get("embedding", F.lit(0)), 4).alias("first"))


@query("m5_frequent_classes", f"WITH {SHOWN}, {LAB} SELECT label, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 12")
def m5(spark, sf):
    return M.frequent_classes(M.training_label(_shown(spark, sf)))


@query("m6_class_weights", f"WITH {SHOWN}, {LAB}, c AS (SELECT label, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 12) SELECT label, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 9) AS weight, n FROM c")
def m6(spark, sf):
    w = M.class_weights(saved(M.training_label(_shown(spark, sf)).select("label"), "training-labels"))
    return w.groupBy("label").agg(F.round(F.max("weight"), 9).alias("weight"), F.count("*").alias("n"))


def _embedded(spark, sf):
    e = M.normalize_embeddings(base(spark, sf, "embeddings"))
    return e.select("vec_id", "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"))


def _model(spark, sf):
    return M.fit_chart_model(M.class_weights(_embedded(spark, sf).filter("vec_id % 4 <> 0")))


@query("m7_fit_chart_model")
def m7(spark, sf):
    """In-sample accuracy of the model by class."""
    rows = M.class_weights(_embedded(spark, sf))
    model, classes = M.fit_chart_model(rows)
    p = M.probabilities(model, classes, rows)
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("pred_label")).cast("double")), 3).alias("accuracy"))


EMB = "em AS MATERIALIZED (SELECT vec_id, 'c' || label AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS e FROM embeddings)"


@query("m7_fit_certificate", "WITH c AS (SELECT 'c' || label AS label, count(*) AS n FROM embeddings GROUP BY label HAVING count(label) >= 12) SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 9) AS weight, TRUE AS optimal FROM c")
def m7_certificate(spark, sf):
    """The fitted model is the optimum: no component of the gradient is over 1e-5."""
    rows = M.class_weights(_embedded(spark, sf))
    model, classes = M.fit_chart_model(rows)
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("weight"), 9).alias("weight"))
    return sizes.join(M.optimality(model, classes, rows), "label").select("label", "n", "weight", (F.col("gradient") < 1e-5).alias("optimal"))


@query("m8_with_folds", "WITH f AS (SELECT vec_id, 'c' || label AS label, md5(CAST(vec_id AS VARCHAR)) AS h FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 12)) SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY h, vec_id) - 1) % 5 AS INT) AS fold FROM f")
def m8_folds(spark, sf):
    return M.with_folds(M.class_weights(_embedded(spark, sf)).select("vec_id", "label"), "vec_id")


@query("m8_cross_validate")
def m8(spark, sf):
    oof = M.cross_validate(M.class_weights(_embedded(spark, sf)), "vec_id")
    return oof.select("vec_id", "label", "fold", "pred_label", F.round("pred_p", 4).alias("pred_p"))


@query("m9_cv_report", "WITH o AS (SELECT CASE WHEN vec_id % 3 = 0 THEN label ELSE label % 7 END = label AS hit, (vec_id % 10) / 10.0 >= 0.6 AS sure FROM embeddings) SELECT avg(CAST(hit AS DOUBLE)) AS accuracy, avg(CASE WHEN sure THEN CAST(hit AS DOUBLE) END) AS accuracy_sure, avg(CAST(sure AS DOUBLE)) AS share_sure FROM o")
def m9(spark, sf):
    e = base(spark, sf, "embeddings")
    pred = F.when(F.col("vec_id") % 3 == 0, F.col("label")).otherwise(F.col("label") % 7)
    return M.cv_report(e.select("label", pred.alias("pred_label"), ((F.col("vec_id") % 10) / 10.0).alias("pred_p")), 0.6)


@query("m10_predict_charts")
def m10(spark, sf):
    model, classes = _model(spark, sf)
    return M.predict_charts(model, classes, _embedded(spark, sf).filter("vec_id % 4 = 0"), min_p=0.3).select("vec_id", "pred_label", "pred_p")


@query("m10_score_columns", f"""WITH {EMB}, d AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM em), m AS (SELECT label AS cls, i, avg(x) AS m FROM d GROUP BY label, i), b AS (SELECT cls, -sum(m * m) / 2 AS b FROM m GROUP BY cls),
s AS (SELECT vec_id, cls, sum(x * m) + any_value(b) AS s FROM d JOIN m USING (i) JOIN b USING (cls) GROUP BY vec_id, cls), t AS (SELECT vec_id, cls, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls) AS n FROM s WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, cls AS pred_label, round(p, 4) AS pred_p FROM t WHERE n = 1""")
def m10_columns(spark, sf):
    """The column path of scoring, over a model that SQL can fit: nearest class means."""
    rows = _embedded(spark, sf)
    return M.score_columns(rows.select("vec_id", "embedding"), *M.class_means(rows)).select("vec_id", "pred_label", F.round("pred_p", 4).alias("pred_p"))


@query("m11_prediction_counts", f"WITH {SHOWN} SELECT coalesce(CASE WHEN pred_p >= 0.5 THEN pred_label END, '(unsure)') AS pred_label, count(*) AS n FROM sh GROUP BY 1")
def m11(spark, sf):
    return M.prediction_counts(_shown(spark, sf).withColumn("pred_label", F.when(F.col("pred_p") >= 0.5, F.col("pred_label"))))
