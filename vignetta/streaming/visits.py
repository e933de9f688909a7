"""Visit counters and the incremental index on Structured Streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..functions import lookups as L
from ..operators.layout import is_fresh
from ..session import shuffles_removed
from . import levels

COOKIE = r"(^|;\s*)pf_v=1(;|$)"
COOKIE_LIFE = "365 days"


def visit_counters(visits: DataFrame) -> DataFrame:
    """views counts every visit, visitors those without the cookie; works on a stream and on a table."""
    fresh = ~F.coalesce("cookie", F.lit("")).rlike(COOKIE)
    return visits.groupBy().agg(F.count("*").alias("views"), F.sum(F.when(fresh, 1).otherwise(0)).alias("visitors"))


def counters_snapshot(counters: DataFrame) -> DataFrame:
    """(k, n) rows; both counters start at 0."""
    return counters.select(F.expr("stack(2, 'views', coalesce(views, 0L), 'visitors', coalesce(visitors, 0L)) AS (k, n)"))


def counters_map(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counters"))  # two rows


def _keyed_state(spark: SparkSession) -> None:
    """State by key on disk: it grows with browsers, not with an executor's memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_visits(visits: DataFrame) -> DataFrame:
    """(user_id, ts, event_id) of each browser's first event; works on a stream and on a table.

    On a stream it is the first so far: a row for each browser whose first event is new or turned out to be an earlier one, in update mode.
    Events may come late, in any order and repeatedly.
    """
    return visits.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first")).select("user_id", "first.ts", "first.event_id")


def new_browsers(visits: DataFrame) -> DataFrame:
    """Events of browsers not seen within the cookie's life, as they arrive; the state forgets a browser when its cookie has ended, and events later than that are dropped."""
    return visits.withWatermark("ts", COOKIE_LIFE).dropDuplicatesWithinWatermark(["user_id"])


def run_first_visits(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the levelled table `path` (levels.newest by user_id) at each browser's first visit."""
    _keyed_state(stream.sparkSession)
    first = first_visits(stream)
    return first.writeStream.outputMode("update").foreachBatch(lambda rows, batch: levels.put(rows, path, batch, "user_id")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_new_browsers(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append new browsers to the files of `path`, each once."""
    _keyed_state(stream.sparkSession)
    return new_browsers(stream).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, path: str, schema, max_files: int | None = 8) -> DataFrame:
    """A stream of files, max_files of them a batch; without it, all that have come are one batch."""
    files = spark.readStream.schema(schema)
    return (files.option("maxFilesPerTrigger", max_files) if max_files else files).parquet(path)


def run_counters(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Counters of a stream as the in-memory table `name`, everything that is there now; replayed files don't count twice."""
    return visit_counters(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_index(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the newest version of arriving records (record_key, seq, ...) batch by batch, each batch in its own folder.

    A batch that is run again after an interruption replaces its folder, so nothing is lost or doubled.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        nth = F.row_number().over(Window.partitionBy("record_key").orderBy(F.desc("seq")))
        batch.withColumn("_n", nth).filter("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_records(spark: SparkSession, path: str) -> DataFrame:
    """What incremental_index has gathered: the newest version of every record."""
    nth = F.row_number().over(Window.partitionBy("record_key").orderBy(F.desc("seq"), F.desc("batch")))
    return spark.read.parquet(path).withColumn("_n", nth).filter("_n = 1").drop("_n", "batch")


EXTRACTED, LABELLED = "extracted", "labelled"
_FIGURE = "struct<pos:bigint,fig_id:string,page:bigint,num:string,v_category:string,v_chart_type:string,v_tags:array<string>,v2_category:string,parent:string,panels:array<string>>"
EVENT_SCHEMA = (
    f"paper_key string, seq bigint, kind string, mtime double, extractor_version int, dpi int, error string, figures array<{_FIGURE}>, labels array<struct<fig_id:string,category:string,chart_type:string,tags:array<string>>>"
)
_RECORD = f"paper_key string, pdf_mtime double, extractor_version int, dpi int, error string, figures array<{_FIGURE}>"


def as_events(rows: DataFrame) -> DataFrame:
    """rows with all columns of EVENT_SCHEMA, those they don't have null."""
    schema = rows.sparkSession.createDataFrame([], EVENT_SCHEMA).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def index_figures(records: DataFrame) -> DataFrame:
    """One row for each figure of index records."""
    return records.select("paper_key", F.inline("figures"))


def changes_by_paper(events: DataFrame, parts: int | None = None) -> DataFrame:
    """What a batch of events says of each paper: its newest extraction `e`, their number `n` and all labels, by id and seq. Rows move once, to `parts` partitions."""
    rows = events.filter("paper_key IS NOT NULL")
    rows = rows.repartition(parts, "paper_key") if parts else rows
    extracted = F.col("kind") == EXTRACTED
    said = F.transform("labels", lambda x: F.struct(x["fig_id"].alias("fig_id"), F.col("seq").alias("seq"), x["category"].alias("category"), x["chart_type"].alias("chart_type"), x["tags"].alias("tags")))
    return rows.groupBy("paper_key").agg(
        F.max_by(F.when(extracted, F.struct("seq", "mtime", "extractor_version", "dpi", "error", "figures")), F.when(extracted, F.col("seq"))).alias("e"),
        F.count_if(extracted).alias("n"),
        F.sort_array(F.filter(F.flatten(F.collect_list(F.when(F.col("kind") == LABELLED, said))), lambda x: x["fig_id"].isNotNull())).alias("labels"),
    )


def _labelled(figures: Column, labels: Column, before: Column) -> Column:
    """Figures with the last label of their id (write_back by paper); with `before`, the last of a smaller seq."""

    def last(f: Column) -> Column:
        x = C.last_of(labels, lambda x: (x["fig_id"] < f["fig_id"]) | ((x["fig_id"] == f["fig_id"]) & F.coalesce(x["seq"] < before, F.lit(True))))
        return F.transform(F.array(x), lambda x: F.when((x["fig_id"] == f["fig_id"]) & (before.isNull() | x["seq"].isNotNull()) & x["category"].isNotNull(), x))[0]

    named = lambda f, x: f.withField("v_category", x["category"]).withField("v_chart_type", x["chart_type"]).withField("v_tags", x["tags"])
    return F.when(F.size(labels) > 0, F.zip_with(figures, F.transform(figures, last), lambda f, x: F.when(x.isNull(), f).otherwise(named(f, x)))).otherwise(figures)


def _carried(old: Column, new: Column) -> Column:
    """New figures with what the old one on their page and number has (carry_labels by paper), as (f, own); own says that it has panels and the same id. `old` is in order of (page, num, pos)."""

    def last(f: Column) -> Column:
        x = C.last_of(old, lambda x: (x["page"] < f["page"]) | ((x["page"] == f["page"]) & (x["num"] <= f["num"])))
        return F.transform(F.array(x), lambda x: F.when((x["page"] == f["page"]) & (x["num"] == f["num"]), x["f"]))[0]

    def carry(f: Column, x: Column) -> Column:
        known, own = x["v_category"].isNotNull(), F.coalesce(x["panels"].isNotNull() & (x["fig_id"] == f["fig_id"]), F.lit(False))
        pick = {c: F.when(known, x[c]).otherwise(f[c]) for c in ("v_category", "v_chart_type", "v_tags")} | {"v2_category": F.coalesce(x["v2_category"], f["v2_category"]), "panels": F.when(own, x["panels"]).otherwise(f["panels"])}
        return F.struct(reduce(lambda f, c: f.withField(c, pick[c]), pick, f).alias("f"), own.alias("own"))

    alone = lambda f: F.struct(f.alias("f"), F.lit(False).alias("own"))
    return F.when(F.size(old) > 0, F.zip_with(new, F.transform(new, last), lambda f, x: F.when(x.isNull(), alone(f)).otherwise(carry(f, x)))).otherwise(F.transform(new, alone))


def merged_changes(changes: DataFrame, version: int = L.EXTRACTOR_VERSION, dpi: int = 300) -> DataFrame:
    """The records that changes_by_paper makes of the current ones, which stand beside them as `record`; see merged_records."""
    again = (F.col("n") > 0) & ~is_fresh(F.col("record"), F.col("e.mtime"), version, dpi)
    none = F.array().cast(f"array<{_FIGURE}>")
    rows = changes.withColumn("again", again).filter("again OR (record IS NOT NULL AND size(labels) > 0)")
    head = lambda new, old: F.when(F.col("again"), F.col(f"e.{new}")).otherwise(F.col(f"record.{old}")).alias(old)
    heads = [head("mtime", "pdf_mtime"), head("extractor_version", "extractor_version"), head("dpi", "dpi"), head("error", "error")]
    found = F.when(F.col("again") & F.col("e.error").isNull(), F.col("e.figures"))
    rows = rows.select("paper_key", "again", *heads, "labels", F.when(F.col("again"), F.col("e.seq")).alias("since"), F.coalesce("record.figures", none).alias("stored"), F.coalesce(found, none).alias("found"))
    # each step is worked out once a row, however often the next one looks into it
    step = lambda rows, name, c: rows.withColumn(name, C.once(c))
    rows = step(rows, "old", _labelled(F.col("stored"), F.col("labels"), F.col("since")))
    whole = F.filter("old", lambda f: F.col("again") & f["parent"].isNull() & f["page"].isNotNull() & f["num"].isNotNull())
    rows = step(rows, "whole", F.sort_array(F.transform(whole, lambda f: F.struct(f["page"].alias("page"), f["num"].alias("num"), f["pos"].alias("pos"), f.alias("f")))))
    rows = step(rows, "new", _carried(F.col("whole"), F.col("found")))
    rows = step(rows, "parents", F.sort_array(F.transform(F.filter("new", lambda x: x["own"]), lambda x: x["f"]["fig_id"])))
    panels = F.filter("old", lambda f: f["parent"].isNotNull() & (C.last_of(F.col("parents"), lambda p: p <= f["parent"]) == f["parent"]))
    rows = step(rows, "made", F.when(F.col("again"), F.concat(F.transform("new", lambda x: x["f"]), panels)).otherwise(F.col("old")))
    rows = step(rows, "late", F.filter("labels", lambda x: x["seq"] > F.col("since")))
    made = _labelled(F.col("made"), F.col("late"), F.lit(None).cast("long"))
    return rows.select("paper_key", "pdf_mtime", "extractor_version", "dpi", "error", F.sort_array(made).alias("figures"))


def merged_records(events: DataFrame, current: DataFrame, version: int = L.EXTRACTOR_VERSION, dpi: int = 300) -> DataFrame:
    """The records that a batch of events changes, given the current records of its papers.

    A paper's newest extraction counts, and only if the current record is missing, failed, or of another file, version or resolution; its
    figures take the labels of the old ones on the same page and number. Labels go to their paper's figures by id: those from before the
    extraction to the old figures, later ones to the new. Labels of unknown papers or figures are ignored, as are events without a paper.

    Records hold their figures, so a batch is merged record by record: rows move by paper alone, and a paper's figures are never rows of their own.
    """
    record = F.struct(*[c for c in current.columns if c != "paper_key"]).alias("record")
    return merged_changes(changes_by_paper(events).join(current.select("paper_key", record), "paper_key", "left"), version, dpi)


def maintain_index(stream: DataFrame, path: str, checkpoint: str, buckets: int | None = None) -> StreamingQuery:
    """Keep the levelled table of index records `path` (levels.newest by paper_key) up to date with a stream of events (EVENT_SCHEMA).

    Each batch is dealt by paper once, meets the current records of its papers in the buckets they are stored in, and stores what has changed.
    An interrupted batch is run again from the checkpoint; one that had been stored by then is passed over, so finished work is kept and nothing
    is applied twice. `buckets` is spark.sql.shuffle.partitions if not given; set it so that a bucket's records suit one task.
    """

    def merge(events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        if levels.is_stored(spark, path, batch):
            return
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        record = spark.createDataFrame([], _RECORD).drop("paper_key").schema
        changes = levels.with_newest(changes_by_paper(events, n), path, "paper_key", "record", record)
        with shuffles_removed(spark):
            levels.put(merged_changes(changes), path, batch, "paper_key", buckets=n)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
