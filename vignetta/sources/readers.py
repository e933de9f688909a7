"""Sources: seed lists, index records, sidecars, file listings, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIGURE = (
    "struct<fig_id:string,num:string,page:int,caption:string,bbox:array<double>,full_width:boolean,has_raster:boolean,n_drawings:int,width_pt:double,height_pt:double,kind:string,"
    "parent:string,panel:int,n_panels:int,panels:array<string>,extra:struct<px_w:int,px_h:int,rotated:int,tw:int,th:int,density:double,v:string>,"
    "vision:struct<category:string,chart_type:string,tags:array<string>,summary_zh:string,model:string,verified:string>,vision2:struct<model:string,category:string,chart_type:string>,"
    "chart_pred:struct<label:string,p:double,model:string>>"
)
INDEX_SCHEMA = (
    "paper_key string, pdf string, pdf_mtime double, extractor_version int, dpi int, tables_version int, meta struct<title:string,arxiv_id:string,venue:string,year:string>, "
    f"figures array<{_FIGURE}>, error string, _corrupt_record string"
)
SIDECAR_SCHEMA = (
    "paper_key string, title string, authors array<string>, published string, abs_url string, pdf_pruned boolean, pdf_bytes bigint, s2_title string, citations bigint, s2_year string, s2_venue string, "
    "arxiv_id string, url string, venue_hint string, year_hint string, note string, _corrupt_record string"
)


def read_seed_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_seq, line_no, line) of several lists; the order of paths and lines is kept, blank and comment lines are not."""
    rows = None
    for i, p in enumerate(paths):
        text = spark.read.text(p, wholetext=True).select(F.lit(i).alias("file_seq"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
        rows = text if rows is None else rows.unionByName(text)
    line = F.trim("line")
    return rows.filter((line != "") & ~line.startswith("#")).select("file_seq", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def read_index(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(papers, figures) of JSON records, one to a file or one to a line; error records and those without figures are left out."""
    records = spark.read.schema(INDEX_SCHEMA).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    good = records.filter("_corrupt_record IS NULL AND error IS NULL AND size(figures) > 0")
    figures = good.select("paper_key", F.posexplode("figures").alias("pos", "f")).select("paper_key", "pos", "f.*")
    return good.drop("figures", "_corrupt_record"), figures


def read_sidecars(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Per-paper metadata, one record to a file or one to a line, keyed by the record's own key or else by the file's stem."""
    rows = spark.read.schema(SIDECAR_SCHEMA).option("multiLine", not lines).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    # a broken record has no title; naming a second column lets the reader prune the rest
    return rows.filter("NOT (_corrupt_record IS NOT NULL AND title IS NULL)").withColumn("paper_key", F.coalesce("paper_key", stem)).drop("_corrupt_record")


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, mtime, bytes) of stored files; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.unix_millis("modificationTime").alias("_ms"), F.col("length").alias("bytes")).withColumn("mtime", F.col("_ms") / 1000).drop("_ms")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, height, width, channels, data) of PNG or JPEG files; data holds BGR rows."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select(
        F.substring_index("image.origin", "/", -1).alias("name"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"
    )
