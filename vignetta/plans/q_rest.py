"""Queries over panels, streams and files."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import panels as X
from ..session import keep_until_exit, remove, saved, shared_path, shuffles_removed
from ..sources import readers, writers
from ..sources.fixtures import base, view
from ..streaming import levels
from ..streaming import visits as V
from .parts import FIGS, META, figures, with_panels
from .q_build import _meta
from .q_labels import EFF
from .registry import query


@query("x1_split_candidates", f"WITH {FIGS} SELECT fig_id FROM fg WHERE n_panels = 0 AND pos % 9 <> 0 AND CASE WHEN v_category IS NOT NULL OR v2_category IS NOT NULL THEN {EFF} = 'data' ELSE kind = 'result' END")
def x1(spark, sf):
    images = view(spark, sf, "fx_figures").filter("pos % 9 <> 0").select("fig_id")
    return X.split_candidates(with_panels(figures(spark, sf)), images).select("fig_id")


SIDE = 200


def pictures(spark, sf):
    """A drawn grid of filled squares for each supplier, as read_images gives it: 1 to 5 columns, 1 to 4 rows, narrow or wide gutters."""
    k = F.col("s_suppkey")
    rows = base(spark, sf, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), (1 + k % 5).cast("int").alias("cols"), (1 + k % 4).cast("int").alias("rows"), F.when(k % 3 == 0, 12).otherwise(40).alias("gap"))

    def draw(batches):
        for b in batches:
            for f in b.itertuples(index=False):
                image = np.full((f.gap + f.rows * (SIDE + f.gap), f.gap + f.cols * (SIDE + f.gap)), 255, np.uint8)
                for y in range(f.rows):
                    for x in range(f.cols):
                        image[f.gap + y * (SIDE + f.gap) :, f.gap + x * (SIDE + f.gap) :][:SIDE, :SIDE] = 10
                yield pd.DataFrame({"name": [f.name], "height": [image.shape[0]], "width": [image.shape[1]], "channels": [1], "data": [image.tobytes()]})

    # the suppliers lie in a file or two; drawn, each is some 1,000 times as large
    spread = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    return spread.mapInPandas(draw, "name string, height int, width int, channels int, data binary")


def drawn(spark, sf):
    """The pictures as PNG files, read again."""
    path = shared_path(spark, "pictures")
    writers.write_images(pictures(spark, sf), path)
    return readers.read_images(spark, path).withColumn("name", F.regexp_replace("name", r"\.png$", ""))


@query("s5_read_images", "SELECT 's' || s_suppkey AS name, gap + rows * (200 + gap) AS height, gap + cols * (200 + gap) AS width, cols * rows * 40000 AS ink FROM (SELECT s_suppkey, 1 + s_suppkey % 5 AS cols, 1 + s_suppkey % 4 AS rows, CASE WHEN s_suppkey % 3 = 0 THEN 12 ELSE 40 END AS gap FROM supplier)")
def s5(spark, sf):
    return X.ink_counts(drawn(spark, sf)).select("name", *[F.col(c).cast("long").alias(c) for c in ("height", "width", "ink")])


@query("x2_split_panels", """WITH p AS (SELECT 's' || s_suppkey AS name, 1 + s_suppkey % 5 AS cols, 1 + s_suppkey % 4 AS rows, CASE WHEN s_suppkey % 3 = 0 THEN 12 ELSE 40 END AS gap FROM supplier),
c AS (SELECT *, unnest(generate_series(0, cols * rows - 1)) AS k FROM p WHERE cols * rows BETWEEN 2 AND CASE WHEN gap = 40 THEN 16 ELSE 6 END)
SELECT name, k AS panel, greatest(0, gap + (k // rows) * (200 + gap) - 14) AS x0, greatest(0, gap + (k % rows) * (200 + gap) - 14) AS y0,
 least(gap + cols * (200 + gap), gap + (k // rows) * (200 + gap) + 214) AS x1, least(gap + rows * (200 + gap), gap + (k % rows) * (200 + gap) + 214) AS y1 FROM c""")
def x2(spark, sf):
    cut = X.split_panels(drawn(spark, sf)).select("name", F.posexplode("boxes").alias("panel", "b"))
    return cut.select("name", F.col("panel").cast("long").alias("panel"), *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("x3_blank_runs", "WITH b AS (SELECT l_orderkey AS fig_id, idx, idx - row_number() OVER (PARTITION BY l_orderkey ORDER BY idx) AS g FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS idx FROM lineitem) WHERE l_quantity <= 20) SELECT fig_id, min(idx) AS start, max(idx) + 1 AS \"end\" FROM b GROUP BY fig_id, g HAVING count(*) >= 2")
def x3(spark, sf):
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    p = base(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fig_id"), idx.alias("idx"), (F.col("l_quantity") > 20).alias("ink"))
    return X.blank_runs(p, 2)


def _boxes(f):
    box = lambda k: F.struct(k.alias("x0"), F.lit(0).alias("y0"), (k + 1).alias("x1"), F.lit(9).alias("y1"))
    n = F.col("n_drawings") % 4
    return f.select("fig_id", F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), box)).otherwise(F.array().cast("array<struct<x0:int,y0:int,x1:int,y1:int>>")).alias("boxes"))


@query("x4_panel_rows", f"WITH {FIGS} SELECT fig_id, caption, parent FROM fg UNION ALL SELECT fig_id || '_s' || k, caption || ' [' || k || '/' || n_panels || ']', fig_id FROM (SELECT *, unnest(generate_series(1, n_panels)) AS k FROM fg WHERE n_panels >= 2)")
def x4(spark, sf):
    f = saved(figures(spark, sf).select("fig_id", "caption", "parent", "panel", "n_panels", "panels", "n_drawings"), "figures")
    return X.panel_rows(f, _boxes(f)).select("fig_id", "caption", "parent")


@query("x5_drop_stale_panels", f"WITH {FIGS} SELECT fig_id FROM fg UNION ALL SELECT fig_id || '_s' || k FROM (SELECT *, unnest(generate_series(1, n_panels)) AS k FROM fg WHERE n_panels >= 2 AND NOT (pos % 3 = 0))")
def x5(spark, sf):
    f = figures(spark, sf)
    counts = f.filter("n_panels >= 2").select("fig_id", (F.col("n_panels") + F.when(F.col("pos") % 3 == 0, 1).otherwise(0)).alias("n_new"))
    return X.drop_stale_panels(with_panels(f), counts).select("fig_id")


COUNT = "SELECT count(*) AS views, sum(CASE WHEN regexp_matches(cookie, '(^|;\\s*)pf_v=1(;|$)') THEN 0 ELSE 1 END) AS visitors FROM fx_visits"


def _stream(spark, sf):
    path = shared_path(spark, "visits")
    view(spark, sf, "fx_visits").repartition(4).write.parquet(path)
    return V.watch(spark, path, spark.read.parquet(path).schema)


@query("v1_visit_counters", COUNT)
def v1(spark, sf):
    name = "visit_counters_" + uuid.uuid4().hex
    V.run_counters(_stream(spark, sf), name, shared_path(spark, "visits-state")).awaitTermination()
    return spark.table(name)


@query("v2_counters_snapshot", f"WITH c AS ({COUNT}) SELECT 'views' AS k, views AS n FROM c UNION ALL SELECT 'visitors', visitors FROM c".replace("WITH c", "WITH c"))
def v2(spark, sf):
    return V.counters_snapshot(V.visit_counters(view(spark, sf, "fx_visits")))


def _shuffled_visits(spark, sf):
    """A stream over files that hold the visits in no order, one in five of them twice."""
    path = shared_path(spark, "visits")
    v = view(spark, sf, "fx_visits").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "cookie")
    v.unionByName(v.filter("event_id % 5 = 0")).repartition(8, F.rand(3)).write.parquet(path)
    return V.watch(spark, path, v.schema, max_files=3)


@query("v3_first_visits", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM fx_visits) WHERE n = 1")
def v3(spark, sf):
    path = shared_path(spark, "first-visits")
    V.run_first_visits(_shuffled_visits(spark, sf), path, shared_path(spark, "first-visits-state")).awaitTermination()
    return levels.newest(spark, path, "user_id").select("user_id", "event_id")


@query("v3_new_browsers", "SELECT DISTINCT user_id FROM fx_visits")
def v3_browsers(spark, sf):
    path = shared_path(spark, "browsers")
    V.run_new_browsers(_shuffled_visits(spark, sf), path, shared_path(spark, "browsers-state")).awaitTermination()
    return spark.read.parquet(path).select("user_id")


@query("v4_incremental_index", "SELECT user_id AS record_key, max(event_id) AS seq FROM fx_visits GROUP BY user_id")
def v4(spark, sf):
    path = shared_path(spark, "records")
    s = _stream(spark, sf).select(F.col("user_id").alias("record_key"), F.col("event_id").alias("seq"))
    V.incremental_index(s, path, shared_path(spark, "records-state")).awaitTermination()
    return V.newest_records(spark, path).select("record_key", "seq")


def _figure(x, moved):
    """A figure as an extraction gives it; with moved, those it finds a page further on have another id."""
    null = lambda t: F.lit(None).cast(t)
    return F.struct(
        x["pos"].cast("long").alias("pos"), F.when(moved, F.concat(x["fig_id"], F.lit("x"))).otherwise(x["fig_id"]).alias("fig_id"), (x["page"] + F.when(moved, 1).otherwise(0)).cast("long").alias("page"), x["num"].alias("num"),
        null("string").alias("v_category"), null("string").alias("v_chart_type"), null("array<string>").alias("v_tags"), null("string").alias("v2_category"), null("string").alias("parent"), null("array<string>").alias("panels"),
    )


#: Papers whose records one task sorts in memory.
PAPERS_A_TASK = 100_000


def _paper_parts(spark, sf):
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base(spark, sf, "orders").count() // PAPERS_A_TASK))


def record_events(spark, sf):
    """Three waves of events on papers: extractions, labels, extractions of stored files again, and labels again.

    Figures are gathered by paper once and stored beside what is known of the paper and its file; the waves are projections of that. They are
    stored once before they are gathered, so that the rows dealt by order are gone before rows are dealt by paper.
    """
    papers = view(spark, sf, "fx_papers").select("paper_key", F.struct(F.col("pdf_mtime").alias("mtime"), "extractor_version", "dpi", "error").alias("paper"))
    stored = view(spark, sf, "fx_pdfs").select("paper_key", F.struct("mtime", F.lit(5).alias("extractor_version"), F.lit(300).alias("dpi"), F.lit(None).cast("string").alias("error")).alias("file"))
    figs, path = view(spark, sf, "fx_figures").select("paper_key", "pos", "fig_id", "page", "num", "v_category", "v_chart_type"), shared_path(spark, "figures")
    with shuffles_removed(spark):
        figs.write.parquet(path, compression="zstd")
        # figures move as rows: as lists they are longer
        dealt = spark.read.schema(figs.schema).parquet(path).repartition(_paper_parts(spark, sf), "paper_key")
        lists = dealt.groupBy("paper_key").agg(F.collect_list(F.struct("pos", "fig_id", "page", "num", "v_category", "v_chart_type")).alias("list"))
        rows = saved(lists.join(papers, "paper_key", "left").join(stored, "paper_key", "left"), "paper-figures", "zstd")
    remove(spark, path)
    event = lambda df, seq, kind: df.withColumns({"seq": F.lit(seq).cast("long"), "kind": F.lit(kind)})
    found = lambda what, moved, seq: event(rows.filter(F.col(what).isNotNull()).select("paper_key", f"{what}.*", F.transform("list", lambda x: _figure(x, moved(x))).alias("figures")), seq, V.EXTRACTED)

    def said(which, category, chart_type, seq):
        label = lambda x: F.struct(x["fig_id"].alias("fig_id"), category(x).alias("category"), chart_type(x).alias("chart_type"), F.array(F.lit("t")).alias("tags"))
        return event(rows.select("paper_key", F.transform(F.filter("list", which), label).alias("labels")).filter("size(labels) > 0"), seq, V.LABELLED)

    return [
        found("paper", lambda x: F.lit(False), 1),
        said(lambda x: x["pos"] % 4 == 1, lambda x: F.coalesce(x["v_category"], F.lit("data")), lambda x: F.coalesce(x["v_chart_type"], F.lit("")), 2),
        found("file", lambda x: x["pos"] % 5 == 0, 3).unionByName(said(lambda x: x["pos"] % 6 == 2, lambda x: F.lit("table"), lambda x: F.lit(""), 4), allowMissingColumns=True),
    ]


@query("v4_maintain_index", """WITH pl AS (SELECT f.paper_key FROM fx_pdfs f JOIN fx_papers p USING (paper_key) WHERE NOT (error IS NULL AND abs(pdf_mtime - mtime) < 1 AND extractor_version = 5 AND dpi = 300)),
g AS (SELECT f.*, p.error, pl.paper_key IS NOT NULL AS again, pl.paper_key IS NOT NULL AND pos % 5 = 0 AS moved FROM fx_figures f JOIN fx_papers p USING (paper_key) LEFT JOIN pl USING (paper_key) WHERE pl.paper_key IS NOT NULL OR error IS NULL)
SELECT paper_key, CASE WHEN moved THEN fig_id || 'x' ELSE fig_id END AS fig_id, CASE WHEN moved THEN page + 1 ELSE page END AS page, CASE WHEN moved THEN NULL WHEN pos % 6 = 2 THEN 'table' WHEN pos % 4 = 1 AND error IS NULL THEN coalesce(v_category, 'data') END AS v_category,
 CASE WHEN moved THEN NULL WHEN pos % 6 = 2 THEN '' WHEN pos % 4 = 1 AND error IS NULL THEN coalesce(v_chart_type, '') END AS v_chart_type FROM g""")
def v4_maintain(spark, sf):
    events, path, state = shared_path(spark, "events"), shared_path(spark, "index"), shared_path(spark, "index-state")
    for wave in record_events(spark, sf):
        # a wave is one batch; the stream is taken up again at its checkpoint for each, and a wave's files go when it has been merged
        V.as_events(wave).write.mode("append").parquet(events, compression="zstd")
        V.maintain_index(V.watch(spark, events, V.EVENT_SCHEMA, max_files=None), path, state, _paper_parts(spark, sf)).awaitTermination()
        remove(spark, events)
    keep_until_exit(spark, path)
    keep_until_exit(spark, state)
    return V.index_figures(levels.newest(spark, path, "paper_key")).select("paper_key", "fig_id", "page", "v_category", "v_chart_type")


# files that Spark writes from the tables and reads again


@query("s1_read_seed_lines", "SELECT CAST(file_seq AS INT) AS file_seq, md5(concat(body, '   # ', note)) AS h FROM fx_seeds")
def s1(spark, sf):
    seeds = view(spark, sf, "fx_seeds").select("file_seq", F.concat("body", F.lit("   # "), "note").alias("value"))
    paths = [shared_path(spark, f"seeds{i}") for i in range(3)]
    for i, p in enumerate(paths):
        seeds.filter(F.col("file_seq") == i).select("value").union(spark.range(1).select(F.lit("# a comment"))).write.text(p)
    return readers.read_seed_lines(spark, paths).select("file_seq", F.md5("line").alias("h"))


def _records(spark, sf):
    f = view(spark, sf, "fx_figures")
    one = F.struct("fig_id", "num", F.col("page").cast("int").alias("page"), "caption", "full_width", "has_raster", "n_drawings")
    figs = f.groupBy("paper_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", one.alias("f")))), lambda x: x["f"]).alias("figures"))
    p = view(spark, sf, "fx_papers").select("paper_key", "pdf_mtime", "extractor_version", "dpi", "error", F.struct(F.col("pdf_title").alias("title"), F.col("pdf_arxiv_id").alias("arxiv_id"), F.col("pdf_venue").alias("venue"), F.col("pdf_year").alias("year")).alias("meta"))
    return p.join(figs, "paper_key", "left")


@query("s2_read_index", "SELECT p.paper_key, pdf_title AS title, count(*) AS n, min(f.pos) - 1 AS first FROM fx_papers p JOIN fx_figures f USING (paper_key) WHERE error IS NULL GROUP BY 1, 2")
def s2(spark, sf):
    path = shared_path(spark, "index")
    # a compressed file can't be read in parts, so none gets long
    _records(spark, sf).write.option("maxRecordsPerFile", 100_000).json(path, compression="gzip")
    papers, figs = readers.read_index(spark, path, lines=True)
    seen = figs.groupBy("paper_key").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first"))
    return papers.select("paper_key", "meta.title").join(seen, "paper_key")


@query("s3_read_sidecars", "SELECT paper_key, title, note, url, citations FROM fx_sidecars")
def s3(spark, sf):
    path = shared_path(spark, "sidecars")
    view(spark, sf, "fx_sidecars").select("paper_key", "title", "note", "url", "published", "citations").write.json(path)
    return readers.read_sidecars(spark, path, lines=True).select("paper_key", "title", "note", "url", "citations")


@query("s4_file_inventory", "SELECT 'page' || page_id || '.html' AS name, coalesce(strlen(html), 0) AS bytes FROM pages")
def s4(spark, sf):
    """Every page's HTML as a stored file: name and size."""
    path = shared_path(spark, "html")
    page = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html"))
    writers.write_files(base(spark, sf, "pages").select(page.alias("name"), F.col("html").cast("binary").alias("data")), path)
    return readers.file_inventory(spark, path, "*.html").select("name", "bytes")


@query("s6_write_index", f"WITH {META} SELECT paper_key, title, venue FROM mt")
def s6(spark, sf):
    path = shared_path(spark, "merged")
    writers.write_index(_meta(spark, sf), path)
    return spark.read.schema("paper_key string, title string, venue string").json(path)


@query("s7_write_shards", f"WITH {META} SELECT paper_key, CAST(floor((row_number() OVER (ORDER BY paper_key) - 1) / ceil(count(*) OVER () / 4.0)) AS INT) AS shard FROM mt")
def s7(spark, sf):
    path = shared_path(spark, "shards")
    writers.write_shards(_meta(spark, sf).select("paper_key", "title"), path, 4)
    return spark.read.json(path).select("paper_key", "shard")
