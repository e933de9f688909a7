"""Candidates by citations and enrichment from a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lookups as L

SCAN_LIMIT = 3000


def known_papers(papers: DataFrame, sidecars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known_id) and (known_title) sets over index and sidecars."""
    ids = papers.select(F.explode(F.array("pdf_arxiv_id", "paper_key")).alias("known_id")).filter("known_id <> ''").union(sidecars.select("paper_key")).distinct()
    titles = papers.select(C.title_key(F.col("pdf_title"), 80, " ").alias("known_title")).union(sidecars.select(C.title_key(F.col("title"), 80, " "))).distinct()
    return ids, titles


def pick_top_cited(candidates: DataFrame, venues: DataFrame, ids: DataFrame, titles: DataFrame, cap: int | None = None, scan: int = SCAN_LIMIT) -> DataFrame:
    """The most cited open, unknown papers of each venue; venues has (venue, short, want).

    Filters run before the keep-first so that a row without a usable body doesn't hide a later one.
    """
    order = Window.partitionBy("venue").orderBy(F.desc("citations"), "cand_id")
    scanned = candidates.withColumn("scan_rank", F.row_number().over(order)).filter(F.col("scan_rank") <= scan)
    open_url = F.when(F.coalesce("oa_url", F.lit("")).rlike("|".join(h.replace(".", r"\.") for h in L.OPEN_HOSTS)), F.col("oa_url"))
    body = F.coalesce(C.blank_to_null(F.col("arxiv")), open_url)
    rows = scanned.withColumns({"title_key": C.title_key(F.col("title"), 80, " "), "body": body}).filter("trim(coalesce(title, '')) <> '' AND body IS NOT NULL")
    rows = rows.join(titles.withColumnRenamed("known_title", "title_key"), "title_key", "left_anti")
    rows = rows.join(ids.select(F.col("known_id").alias("arxiv")), "arxiv", "left_anti")
    first = Window.partitionBy("venue", "title_key").orderBy("scan_rank")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("venue").orderBy("scan_rank"))
    want = F.least("want", F.lit(cap)) if cap else F.col("want")
    return rows.withColumn("place", place).join(F.broadcast(venues), "venue").filter(F.col("place") <= want)


def render_seed_lines(picks: DataFrame, recent: bool = False) -> DataFrame:
    line = F.concat(
        "body", F.lit("   # "), "short", F.lit(" "), F.col("year").cast("string"), F.lit(" Recent (" if recent else " High-impact ("),
        F.coalesce("citations", F.lit(0)).cast("string"), F.lit(" citations): "), F.trim("title"),
    )
    return picks.select("venue", "place", line.alias("line"))


def enrich_need(papers: DataFrame, sidecars: DataFrame, force: bool = False) -> DataFrame:
    """Good papers whose sidecar has no authors, with the arXiv id and title to look them up by."""
    joined = papers.filter("error IS NULL").join(sidecars.select("paper_key", "title", "authors", "year_hint"), "paper_key", "left")
    if not force:
        joined = joined.filter(F.coalesce(F.size("authors"), F.lit(0)) <= 0)
    return joined.select("paper_key", F.col("pdf_arxiv_id").alias("arxiv_id"), F.coalesce(C.blank_to_null(F.col("title")), "pdf_title").alias("title"))


def enrich_by_arxiv(need: DataFrame, catalog: DataFrame) -> DataFrame:
    hits = catalog.filter("arxiv IS NOT NULL").select(F.col("arxiv").alias("arxiv_id"), "cand_id", F.col("title").alias("cat_title"), F.col("citations").alias("cat_citations"), F.col("year").alias("cat_year"), F.col("venue").alias("cat_venue"))
    return need.filter("arxiv_id <> ''").join(hits, "arxiv_id")


def enrich_by_title(need: DataFrame, catalog: DataFrame) -> DataFrame:
    """For rows without arXiv id: the most cited catalog row with the same first 60 letters of the title."""
    keyed = catalog.select(C.title_key(F.col("title"), 60, " ").alias("tk"), "cand_id", F.col("title").alias("cat_title"), F.col("citations").alias("cat_citations"), F.col("year").alias("cat_year"), F.col("venue").alias("cat_venue"))
    best = keyed.groupBy("tk").agg(F.max_by(F.struct("cand_id", "cat_title", "cat_citations", "cat_year", "cat_venue"), F.struct("cat_citations", -F.col("cand_id"))).alias("b")).select("tk", "b.*")
    asked = need.filter("arxiv_id = '' AND length(title) > 12").withColumn("tk", C.title_key(F.col("title"), 60, " "))
    return asked.join(best, "tk").drop("tk")


def apply_enrichment(sidecars: DataFrame, hits: DataFrame) -> DataFrame:
    """Sidecars with authors, citations, year and venue of their hit; hits has cat_* columns and cat_authors."""
    return _enriched(sidecars.join(hits, "paper_key", "left"))


def apply_by_arxiv(sidecars: DataFrame, need: DataFrame, catalog: DataFrame) -> DataFrame:
    """apply_enrichment with the hits of enrich_by_arxiv, for need of one row a paper; catalog also has `authors`.

    Papers meet their id first and the catalog last: however many catalog rows an id has, what they multiply isn't moved again.
    """
    hits = catalog.filter("arxiv IS NOT NULL").select("arxiv", *[F.col(c).alias(f"cat_{c}") for c in ("title", "citations", "year", "venue", "authors")])
    asked = sidecars.join(need.filter("arxiv_id <> ''").select("paper_key", "arxiv_id"), "paper_key", "left")
    return _enriched(asked.join(hits, C.same_or_spread(F.col("arxiv_id"), F.col("paper_key"), F.col("arxiv")), "left"))


def _enriched(j: DataFrame) -> DataFrame:
    hit = F.col("cat_title").isNotNull()
    short = (F.col("title") == "") | (F.length("title") < 8)
    return j.select(
        "paper_key",
        F.when(hit & short & (F.col("cat_title") != ""), F.col("cat_title")).otherwise(F.col("title")).alias("title"),
        F.when(hit, F.filter("cat_authors", lambda a: a != "")).otherwise(F.col("authors")).alias("authors"),
        F.when(hit, F.coalesce("cat_citations", F.lit(0))).otherwise(F.col("citations")).alias("citations"),
        F.when(hit & F.col("cat_year").isNotNull() & (F.col("year_hint") == ""), F.col("cat_year").cast("string")).otherwise(F.col("s2_year")).alias("s2_year"),
        F.when(hit & (F.coalesce("cat_venue", F.lit("")) != ""), F.col("cat_venue")).alias("s2_venue"),
    )


def enrich_report(need: DataFrame, by_id: DataFrame, by_title: DataFrame) -> DataFrame:
    marks = need.select("paper_key").join(by_id.select("paper_key", F.lit(1).alias("i")).distinct(), "paper_key", "left").join(by_title.select("paper_key", F.lit(1).alias("t")).distinct(), "paper_key", "left")
    return marks.agg(F.count("*").alias("need"), F.count("i").alias("by_id"), F.count("t").alias("by_title"), F.sum(F.when(F.col("i").isNull() & F.col("t").isNull(), 1).otherwise(0)).alias("missing"))
