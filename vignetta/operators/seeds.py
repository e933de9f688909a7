"""Seed lists: parse curated lines, keep the first of each key, plan metadata and downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

MIN_FILE_BYTES = 10_000
_VENUE_YEAR = r"^([A-Za-z][A-Za-z&/ -]*?)\s*(20\d\d)"


def parse_seeds(lines: DataFrame) -> DataFrame:
    """(file_seq, line_no, line) -> seeds; comments, blank lines, NOPDF rows and rows without an id are left out."""
    at = F.instr("line", "#")
    rows = lines.select("file_seq", "line_no", C.once(C.stripped(F.col("line"))).alias("line")).filter("line <> '' AND line NOT LIKE '#%'").select(
        "file_seq", "line_no",
        F.trim(F.substring_index("line", "#", 1)).alias("body"),
        F.when(at > 0, F.trim(F.expr("substring(line, instr(line, '#') + 1)"))).otherwise("").alias("note"),
    ).filter(~F.upper("body").startswith("NOPDF"))
    is_url = F.lower("body").startswith("http")
    given = F.struct(is_url.alias("is_url"), F.when(is_url, F.regexp_extract("body", r"^(\S+)", 1)).alias("url"), F.when(~is_url, C.arxiv_id(F.col("body"))).alias("found"))
    rows = rows.select("file_seq", "line_no", "note", C.once(given).alias("g")).filter("g.is_url OR g.found <> ''").withColumns(C.url_parts(F.col("g.url")))
    is_url, found, url = F.col("g.is_url"), F.col("g.found"), F.col("g.url")
    venue_year = F.regexp_extract("note", _VENUE_YEAR, 2)
    return rows.select(
        "file_seq", "line_no",
        F.when(is_url, "").otherwise(found).alias("arxiv_id"),
        F.when(is_url, url).otherwise(F.concat(F.lit("https://arxiv.org/pdf/"), found)).alias("url"),
        F.when(is_url, C.key_of_parts()).otherwise(found).alias("key"),
        F.trim(F.regexp_extract("note", _VENUE_YEAR, 1)).alias("venue_hint"),
        F.when(venue_year != "", venue_year).otherwise(F.regexp_extract("note", r"^(20\d\d)", 1)).alias("year_hint"),
        "note",
    )


def dedupe_seeds(seeds: DataFrame) -> DataFrame:
    """The first row of every key in (file, line) order."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("file_seq", "line_no"))
    return seeds.withColumn("_n", first).filter("_n = 1").drop("_n")


def seeds_from_ids(seeds: DataFrame, ids: DataFrame) -> DataFrame:
    """Append ad-hoc ids (pos, id) after the files' seeds, without hints."""
    found = C.arxiv_id(F.col("id"))
    more = ids.filter(found != "").select(
        F.lit(2**31 - 1).alias("file_seq"), F.col("pos").cast("long").alias("line_no"), found.alias("arxiv_id"),
        F.concat(F.lit("https://arxiv.org/pdf/"), found).alias("url"), found.alias("key"), F.lit("").alias("venue_hint"), F.lit("").alias("year_hint"), F.lit("").alias("note"),
    )
    return seeds.unionByName(more)


def need_metadata(seeds: DataFrame, sidecars: DataFrame) -> DataFrame:
    """arXiv seeds whose sidecar has no title."""
    titled = sidecars.filter("title <> ''").select(F.col("paper_key").alias("key"))
    return seeds.filter("arxiv_id <> ''").join(titled, "key", "left_anti")


def merge_sidecars(seeds: DataFrame, api: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars after a fetch: titled ones stay; for the rest the API's fields under the seed's."""
    titled = sidecars.filter("title <> ''")
    fresh = seeds.join(titled.select(F.col("paper_key").alias("key")), "key", "left_anti").join(api, "arxiv_id", "left")
    return titled.select("paper_key", "title", "published", "url", "venue_hint", "year_hint", "note").unionByName(
        fresh.select(F.col("key").alias("paper_key"), F.coalesce("api_title", F.lit("")).alias("title"), F.coalesce("api_published", F.lit("")).alias("published"), "url", "venue_hint", "year_hint", "note")
    )


def download_plan(seeds: DataFrame, files: DataFrame, sidecars: DataFrame, refetch: bool = False) -> DataFrame:
    """Seeds without a stored file of sensible size that aren't marked as pruned (unless refetching)."""
    stored = files.filter(F.col("bytes") > MIN_FILE_BYTES).select(F.col("paper_key").alias("key"))
    out = seeds.join(stored, "key", "left_anti")
    if not refetch:
        out = out.join(sidecars.filter("pdf_pruned").select(F.col("paper_key").alias("key")), "key", "left_anti")
    return out


def paper_key(stem: Column, has_sidecar: Column) -> Column:
    """Key of a stored file: its stem if a sidecar names it, an arXiv id in it, else the cleaned stem."""
    found = C.arxiv_id(stem)
    return F.when(has_sidecar, stem).when(found != "", found).otherwise(F.substring(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), 1, 80))
