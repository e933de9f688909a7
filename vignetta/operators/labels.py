"""Figure labels: parse replies, choose the effective label, queues, write-back, corrections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lookups as L

SURE = 0.8


def parse_labels(responses: DataFrame) -> DataFrame:
    """(fig_id, reply) -> category, chart_type, tags, summary; replies that aren't JSON objects are dropped.

    Fences go, unknown categories and chart types become `other`, tags come as a list or a comma string.
    """
    text = F.trim("reply")
    text = F.when(text.contains("`"), F.regexp_replace(text, r"^`+(json)?|`+$", "")).otherwise(text)
    j = F.from_json(text, "category string, chart_type string, tags string, summary_zh string")
    cat = F.lower(F.trim(F.coalesce(F.col("j.category"), F.lit("other"))))
    kind = F.lower(F.trim(F.coalesce(F.col("j.chart_type"), F.lit(""))))
    raw = F.coalesce(F.col("j.tags"), F.lit("[]"))
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, ","))
    tags = F.slice(F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != ""), 1, 6)
    rows = responses.select("fig_id", C.once(j).alias("j")).filter("j IS NOT NULL")
    rows = rows.select("fig_id", F.when(cat.isin(*L.CATEGORIES), cat).otherwise("other").alias("category"), kind.alias("kind"), tags.alias("tags"), F.substring(F.trim(F.coalesce("j.summary_zh", F.lit(""))), 1, 80).alias("summary"))
    chart = F.when(F.col("category") != "data", "").when(F.col("kind").isin(*L.CHART_TYPES), F.col("kind")).otherwise("other")
    return rows.select("fig_id", "category", chart.alias("chart_type"), "tags", "summary")


def effective_label(figures: DataFrame) -> DataFrame:
    """Second opinion before first label before caption kind (tables have no entry there)."""
    second, first = F.col("v2_category").isNotNull(), F.col("v_category").isNotNull()
    return figures.withColumns({
        "eff_category": F.when(second, F.col("v2_category")).when(first, F.col("v_category")).otherwise(C.kind_category(F.col("kind"))),
        "eff_chart_type": F.when(second, F.coalesce("v2_chart_type", F.lit(""))).when(first, F.coalesce("v_chart_type", F.lit(""))).otherwise(""),
    })


def _whole_or_panel(figures: DataFrame) -> DataFrame:
    return figures.filter(F.coalesce(F.size("panels"), F.lit(0)) <= 0)


def classify_queue(figures: DataFrame, thumbs: DataFrame, ranks: DataFrame, only_charts: bool = False, limit: int | None = None, force: bool = False) -> DataFrame:
    """Figures to label next, by (sure, award rank, file name, place); ranks is (paper_key, award_rank)."""
    todo = _whole_or_panel(figures)
    if not force:
        todo = todo.filter("v_category IS NULL")
    if only_charts:
        todo = todo.filter("parent IS NOT NULL OR kind = 'result'")
    todo = todo.join(thumbs.select("fig_id"), "fig_id", "left_semi").join(ranks, "paper_key", "left")
    todo = todo.withColumns({"sure": F.when(F.coalesce("pred_p", F.lit(0.0)) >= SURE, 1).otherwise(0), "rank": F.coalesce("award_rank", F.lit(6))})
    name = F.concat("paper_key", F.lit(".json"))
    order = [F.col("sure"), F.col("rank"), name, F.col("pos"), F.col("fig_id")] if only_charts else [name, F.col("pos"), F.col("fig_id")]
    todo = todo.orderBy(*order)
    return todo.limit(limit) if limit else todo


def verify_queue(figures: DataFrame, thumbs: DataFrame, cats: tuple[str, ...], include_unlabeled: bool = True, limit: int | None = None) -> DataFrame:
    """Figures of some effective categories that have no second opinion yet."""
    todo = effective_label(_whole_or_panel(figures)).filter(F.col("v2_category").isNull() & F.col("eff_category").isin(*cats))
    if not include_unlabeled:
        todo = todo.filter("v_category IS NOT NULL")
    todo = todo.join(thumbs.select("fig_id"), "fig_id", "left_semi")
    return todo.orderBy(F.concat("paper_key", F.lit(".json")), "pos", "fig_id").limit(limit) if limit else todo


def write_back(figures: DataFrame, labels: DataFrame) -> DataFrame:
    """Merge labels (fig_id, category, chart_type, tags, optional error and seq) by id; unknown ids and errors are ignored.

    Of several labels of one id the one of the largest seq counts; without seq, or with equal ones, the largest in order of its fields.
    """
    good = labels.filter("error IS NULL") if "error" in labels.columns else labels
    seq = [F.col("seq")] if "seq" in labels.columns else []
    last = good.groupBy("fig_id").agg(F.max(F.struct(*seq, "category", "chart_type", "tags")).alias("n"))
    new = last.select("fig_id", F.col("n.category").alias("n_category"), F.col("n.chart_type").alias("n_chart_type"), F.col("n.tags").alias("n_tags"))
    j = figures.join(new, "fig_id", "left")
    hit = F.col("n_category").isNotNull()
    return j.withColumns({"v_category": F.coalesce("n_category", "v_category"), "v_chart_type": F.when(hit, F.col("n_chart_type")).otherwise(F.col("v_chart_type")), "v_tags": F.when(hit, F.col("n_tags")).otherwise(F.col("v_tags"))}).drop("n_category", "n_chart_type", "n_tags")


def label_progress(results: DataFrame) -> DataFrame:
    """Per paper: calls, tokens, errors and what is left; results has (paper_key, prompt_tokens, completion_tokens, error, done)."""
    return results.groupBy("paper_key").agg(
        F.count_if("done").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(~F.col("done")).alias("remaining"),
    )


def merge_overrides(sources: list[DataFrame]) -> DataFrame:
    """Override tables (fig_id, category, chart_type) in order: a later file wins per id, ids with `_` in front are notes."""
    rows = None
    for i, s in enumerate(sources):
        r = s.filter(~F.col("fig_id").startswith("_")).withColumn("seq", F.lit(i))
        rows = r if rows is None else rows.unionByName(r)
    last = Window.partitionBy("fig_id").orderBy(F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "seq")


def apply_overrides(figures: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual corrections by own id, else by the parent's; fields not given are kept, else `data` and blank."""
    own = overrides.select("fig_id", F.col("category").alias("o_cat"), F.col("chart_type").alias("o_type"), F.lit(True).alias("o"))
    up = overrides.select(F.col("fig_id").alias("p_id"), F.col("category").alias("p_cat"), F.col("chart_type").alias("p_type"), F.lit(True).alias("p"))
    j = figures.join(own, "fig_id", "left").join(up, C.same_or_spread(F.col("parent"), F.col("fig_id"), F.col("p_id")), "left")
    mine, theirs = F.col("o").isNotNull(), F.col("p").isNotNull()
    cat = F.when(mine, F.coalesce("o_cat", "v_category", F.lit("data"))).when(theirs, F.coalesce("p_cat", "v_category", F.lit("data"))).otherwise(F.col("v_category"))
    kind = F.when(mine, F.coalesce("o_type", "v_chart_type", F.lit(""))).when(theirs, F.coalesce("p_type", "v_chart_type", F.lit(""))).otherwise(F.col("v_chart_type"))
    return j.withColumns({"v_category": cat, "v_chart_type": kind, "manual": mine | theirs, "v2_category": F.when(~(mine | theirs), F.col("v2_category"))}).drop("o_cat", "o_type", "o", "p_id", "p_cat", "p_type", "p")


def caption_labeler(batch: pd.DataFrame) -> pd.Series:
    """Default labelling function: the caption's kind decides; replies have the form of a model's."""
    kind = batch["kind"].map(L.KIND_CATEGORY).fillna("other")
    return '{"category": "' + kind + '", "chart_type": "", "tags": ["caption"], "summary_zh": ""}'


def label_figures(figures: DataFrame, labeler: Callable[[pd.DataFrame], pd.Series] = caption_labeler) -> DataFrame:
    """Apply a labelling function batch by batch to unlabelled figures and merge what it says.

    One row is tried first so that a function that can't work fails before the job starts.
    """
    asked = figures.filter("v_category IS NULL").select("fig_id", "caption", "kind")
    probe = asked.limit(1).toPandas()
    if len(probe):
        labeler(probe)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"fig_id": b["fig_id"], "reply": labeler(b)})

    return write_back(figures, parse_labels(asked.mapInPandas(run, "fig_id string, reply string")))


def chart_class(tags: Column, caption: Column) -> Column:
    return C.chart_from_text(tags, caption)
