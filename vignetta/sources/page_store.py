"""Page tables stored by page."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import keep_until_exit, shared_path

PAGE = ["paper_key", "page"]


def stored_pages(df: DataFrame, name: str, buckets: int | None = None, placed: bool = False) -> DataFrame:
    """df written to the shared folder in buckets of (paper_key, page), sorted by them, and read back as a table of the session.

    Joins on the page, and groupings and windows that start with it, find a page's rows in one partition: tables with equal
    `buckets` meet without an exchange. `buckets` is spark.sql.shuffle.partitions if not given; set it so that the largest
    table's bucket suits one task. `placed` says that df comes from such tables and is written as it lies. A null key
    is a page of its own here and matches none in joins. An empty table gives an empty table.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    (df if placed else df.repartition(n, *PAGE)).write.bucketBy(n, *PAGE).sortBy(*PAGE).option("path", path).saveAsTable(table)
    keep_until_exit(spark, path)
    return spark.table(table)
