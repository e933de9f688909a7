"""Gallery queries: search, one figure, facet counts, ranking inside an edition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def search(index: DataFrame, q: str = "", cat: str = "", chart: str = "", venue: str = "", area: str = "", award: str = "", tag: str = "") -> DataFrame:
    """Figures that meet all filters; every keyword of q must occur in caption, title, tags or arXiv id. `chart` counts only for data."""
    text = F.lower(F.concat_ws(" ", "caption", "title", F.array_join("tags", " "), "arxiv_id"))
    out = index
    for word in q.lower().split():
        out = out.filter(text.contains(word))
    for column, value in (("category", cat), ("venue", venue), ("area", area), ("award_en", award)):
        if value:
            out = out.filter(F.col(column) == value)
    if chart and cat == "data":
        out = out.filter(F.col("chart_type") == chart)
    if tag:
        out = out.filter(F.array_contains("tags", tag))
    return out


def figure_detail(figures: DataFrame, papers: DataFrame, fig_id: str) -> DataFrame:
    return figures.filter(F.col("fig_id") == fig_id).join(papers, "paper_key")


def facet_counts(index: DataFrame) -> DataFrame:
    """(facet, value, detail, n) in one pass over the figures."""
    none = F.lit("")
    pair = lambda facet, value, detail=none, keep=None: F.when(keep if keep is not None else F.lit(True), F.struct(F.lit(facet).alias("facet"), F.coalesce(value, none).alias("value"), F.coalesce(detail, none).alias("detail")))
    one = F.array(
        pair("category", F.col("category")),
        pair("chart_type", F.col("chart_type"), keep=(F.col("category") == "data") & (F.coalesce("chart_type", none) != "")),
        pair("venue", F.col("venue"), F.col("area"), F.coalesce("venue", none) != ""),
        pair("award", F.col("award_en"), keep=F.coalesce("award_en", none) != ""),
    )
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"), none.alias("detail")))
    return index.select(F.explode(F.concat(F.filter(one, lambda x: x.isNotNull()), tags)).alias("f")).groupBy("f.facet", "f.value", "f.detail").agg(F.count("*").alias("n"))


def ranked_editions(papers: DataFrame) -> DataFrame:
    """Papers of a venue and year by award rank, then citations, then key."""
    place = F.row_number().over(Window.partitionBy("venue", "year").orderBy("award_rank", F.desc("citations"), "paper_key"))
    return papers.withColumn("place", place)
