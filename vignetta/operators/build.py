"""From index records to the published gallery: resolve, fold, aggregate, publish."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lookups as L
from ..session import saved, shared_path


def area_of(venue: Column) -> Column:
    """Area of a venue name: of the known names found in it with no letter on either side, the longest counts."""
    v = F.lower(C.stripped(F.coalesce(venue, F.lit(""))))
    out = None
    for name, area, _ in sorted(L.venue_areas(), key=lambda x: (-len(x[0]), x[2])):
        hit = v.rlike(f"(^|[^a-z]){name}([^a-z]|$)")
        out = F.when(hit, area) if out is None else out.when(hit, area)
    return out.otherwise("")


def with_area(papers: DataFrame) -> DataFrame:
    """Add `area`; patterns run once for each distinct venue. Papers of no known venue but with an arXiv id are preprints."""
    areas = papers.select("venue").distinct().withColumn("_area", area_of(F.col("venue")))
    joined = papers.join(areas, papers["venue"].eqNullSafe(areas["venue"]), "left").drop(areas["venue"])
    fallback = F.when(F.coalesce("arxiv_id", F.lit("")) != "", "preprint").otherwise("")
    return joined.withColumn("area", F.coalesce(C.blank_to_null(F.col("_area")), fallback)).drop("_area")


def best_meta(papers: DataFrame, sidecars: DataFrame) -> DataFrame:
    """One row per good paper: the best title, year, venue and id over sidecar and PDF, and where it came from."""
    s = sidecars.select("paper_key", *[F.col(c).alias(f"s_{c}") for c in ("title", "published", "venue_hint", "year_hint", "s2_year", "note", "url", "authors", "citations")], F.lit(True).alias("has_side"))
    # made before the join, so that the source alone doesn't move note and url
    s = s.withColumn("s_source", C.source_of(F.lit(True), F.col("s_note"), F.col("s_url")))
    j = papers.filter("error IS NULL").join(s, "paper_key", "left")
    blank = C.blank_to_null
    has = F.coalesce("has_side", F.lit(False))
    full_id = F.col("paper_key").rlike(r"^\d{4}\.\d{4,5}(v\d+)?$")
    return j.select(
        "paper_key",
        F.coalesce(blank(F.col("s_title")), "pdf_title", F.lit("")).alias("title"),
        F.coalesce(blank(F.col("s_year_hint")), blank(F.substring("s_published", 1, 4)), blank(F.col("pdf_year")), blank(F.col("s_s2_year")), F.lit("")).alias("year"),
        C.norm_venue(F.coalesce(blank(F.col("s_venue_hint")), "pdf_venue")).alias("venue"),
        F.coalesce("s_authors", F.array().cast("array<string>")).alias("authors"),
        F.coalesce("s_citations", F.lit(0)).alias("citations"),
        F.coalesce(blank(F.col("pdf_arxiv_id")), F.when(has & full_id, F.col("paper_key")), F.lit("")).alias("arxiv_id"),
        F.coalesce("s_note", F.lit("")).alias("note"), F.coalesce("s_url", F.lit("")).alias("url"), F.coalesce("s_source", F.lit("local")).alias("source"), "dpi",
    )


def with_award(papers: DataFrame) -> DataFrame:
    rank, text = F.col("award_rank"), F.col("note")
    return papers.withColumn("award_rank", C.award_rank(text, F.col("source"))).withColumns({"award_zh": C.award_label(rank, text, False), "award_en": C.award_label(rank, text)})


def resolve_meta(papers: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Good papers with their best metadata, award and area."""
    return with_area(with_award(best_meta(papers, sidecars)))


def hide_composites(figures: DataFrame) -> DataFrame:
    """A figure that was split is shown only as its panels."""
    return figures.filter(F.coalesce(F.size("panels"), F.lit(0)) <= 0)


def dedupe_images(figures: DataFrame) -> DataFrame:
    """Within a paper the first figure of every thumbnail hash; figures without thumbnail stay."""
    nth = F.row_number().over(Window.partitionBy("paper_key", "thumb_md5").orderBy("pos"))
    ratio = F.col("thumb_bytes") / F.greatest(F.lit(1), F.col("tw") * F.col("th")) * 1000
    kept = figures.withColumn("_n", nth).filter("_n = 1 OR thumb_md5 IS NULL").drop("_n")
    return kept.withColumns({"ratio": ratio, "density": F.bround(ratio, 1), "v": F.substring("thumb_md5", 1, 8)})


def count_images(figures: DataFrame) -> DataFrame:
    """How many figures of each paper dedupe_images keeps; moves keys and hashes once, in no order."""
    hashes = figures.select("paper_key", "thumb_md5").repartition("paper_key").groupBy("paper_key", "thumb_md5").agg(F.count("*").alias("_n"))
    return hashes.groupBy("paper_key").agg(F.sum(F.when(F.col("thumb_md5").isNull(), F.col("_n")).otherwise(1)).alias("n_figs"))


def hash_delta(thumbs: DataFrame, cache: DataFrame) -> DataFrame:
    """Thumbnails (name, mtime) whose name and whole second aren't in the cache (key)."""
    key = F.concat("name", F.lit(":"), F.floor("mtime").cast("string"))
    return thumbs.withColumn("key", key).join(cache, "key", "left_anti")


def overlay_second_opinion(figures: DataFrame) -> DataFrame:
    """The second opinion replaces category and chart type unless a manual correction holds; tags stay."""
    manual = F.coalesce("manual", F.lit(False)) if "manual" in figures.columns else F.lit(False)
    use = F.col("v2_category").isNotNull() & ~manual
    return figures.withColumns({"v_chart_type": F.when(use, F.coalesce("v2_chart_type", F.lit(""))).otherwise(F.col("v_chart_type")), "v_category": F.when(use, F.col("v2_category")).otherwise(F.col("v_category"))})


def rewrite_panel_captions(figures: DataFrame) -> DataFrame:
    new = F.regexp_replace("caption", r"\s*\[子图 (\d+)/(\d+)\]", r" [$1/$2]")
    return figures.withColumn("caption", F.when(F.col("parent").isNotNull(), new).otherwise(F.col("caption")))


def reconcile_kind(figures: DataFrame) -> DataFrame:
    """Caption kind anew for unlabelled figures, then what the picture says where nothing else does."""
    open_ = F.col("v_category").isNull()
    kind = F.when(open_ & (F.col("kind") != "table"), C.caption_kind(F.col("caption"), F.col("num"), F.col("page"), F.col("has_raster"), F.col("n_drawings"))).otherwise(F.col("kind"))
    step = figures.withColumn("kind", kind)
    seen = open_ & (F.coalesce("pred_label", F.lit("")) != "")
    moved = C.mapped(F.col("pred_label"), L.NON_CHART_KIND, F.lit(None))
    whole = F.when((F.col("kind") == "result") & moved.isNotNull(), moved).otherwise(F.col("kind"))
    return step.withColumn("kind", F.when(seen & F.col("parent").isNotNull(), F.coalesce(moved, F.lit("result"))).when(seen, whole).otherwise(F.col("kind")))


def chart_guess(figures: DataFrame) -> DataFrame:
    """A chart class for data figures whose label leaves it open and for unlabelled results; null when there is none."""
    vague = (F.col("v_category") == "data") & F.coalesce("v_chart_type", F.lit("")).isin("", "other", "mixed")
    asked = F.coalesce(vague, F.lit(False)) | (F.col("v_category").isNull() & (F.col("kind") == "result"))
    pred = F.coalesce("pred_label", F.lit(""))
    text = F.when(~(F.col("parent").isNotNull() & (pred != "")), C.chart_of_texts())
    from_picture = F.when(~pred.isin("", "other", *L.NON_CHART_KIND), pred)
    return figures.withColumns(C.chart_texts(F.col("v_tags"), F.col("caption"))).withColumn("chart_guess", F.when(asked, F.coalesce(text, from_picture))).drop("low_tags", "low_caption")


def asset_urls(figures: DataFrame, files: DataFrame) -> DataFrame:
    """thumb and full paths; files has (fig_id, is_thumb, ext). WebP before PNG, WebP when neither is stored."""
    best = files.groupBy("fig_id").agg(*[F.max(F.when((F.col("is_thumb") == t) & (F.col("ext") == e), 1)).alias(f"{n}_{e}") for t, n in ((True, "t"), (False, "f")) for e in ("webp", "png")])
    q = F.when(F.coalesce("v", F.lit("")) != "", F.concat(F.lit("?v="), "v")).otherwise("")
    ext = lambda n: F.when(F.col(f"{n}_webp").isNull() & F.col(f"{n}_png").isNotNull(), ".png").otherwise(".webp")
    j = figures.join(best, "fig_id", "left")
    return j.withColumns({"thumb": F.concat(F.lit("figs/"), "fig_id", F.lit(".thumb"), ext("t"), q), "full": F.concat(F.lit("figs/"), "fig_id", ext("f"), q)}).drop("t_webp", "t_png", "f_webp", "f_png")


def first_of_title(papers: DataFrame) -> DataFrame:
    """Of papers with one normalised title the copy with most figures, then curated ones, then file-name order; with its number of figures.

    Only keys and counts go through the window; blank titles fall back to the paper's own key.
    """
    key = F.coalesce(C.blank_to_null(C.title_key(F.col("title"))), F.col("paper_key"))
    order = Window.partitionBy("fold_key").orderBy(F.desc("n_figs"), F.desc(F.col("source") == "seed"), F.concat("paper_key", F.lit(".json")))
    small = papers.select("paper_key", "source", "n_figs", key.alias("fold_key"))
    return small.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("paper_key", "fold_key", "n_figs")


def fold_by_title(papers: DataFrame) -> DataFrame:
    return first_of_title(papers).drop("n_figs")


def choose_papers(papers: DataFrame, sidecars: DataFrame, figures: DataFrame) -> DataFrame:
    """(paper_key, n_figs) of papers that stay; title, source and number of figures decide, so no other column is made or moved."""
    counted = best_meta(papers, sidecars).select("paper_key", "title", "source").join(count_images(hide_composites(figures)), "paper_key")
    return first_of_title(counted).select("paper_key", "n_figs").distinct()


def load_index(papers: DataFrame, sidecars: DataFrame, figures: DataFrame, files: DataFrame, figures_of: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Papers and figures of the gallery.

    The papers that stay are found first; metadata, the removal of repeated pictures and the text rules run on their rows only. Papers and deduplicated figures
    are stored once, because callers use them several times. `figures_of` reads the figures of given papers (paper_key) from a source that can leave out others early.
    """
    chosen = saved(choose_papers(papers, sidecars, figures), "gallery-chosen")
    key = chosen.select("paper_key")
    stay = lambda df: df.join(key, "paper_key", "left_semi")
    meta = saved(with_award(best_meta(stay(papers), stay(sidecars))).join(chosen, "paper_key"), "gallery-papers")
    figs = saved(dedupe_images(hide_composites(figures_of(key) if figures_of else stay(figures))), "gallery-figures")
    return with_area(meta), asset_urls(chart_guess(rewrite_panel_captions(reconcile_kind(overlay_second_opinion(figs)))), files)


def site_numbers(papers: DataFrame, figures: DataFrame) -> DataFrame:
    """One row of formatted counts."""
    fmt = lambda c: F.format_number(F.coalesce(c, F.lit(0)), 0)
    p = papers.agg(fmt(F.count("*")).alias("n_papers"), fmt(F.count_distinct(C.blank_to_null(F.col("venue")))).alias("n_venues"), fmt(F.count_distinct(C.blank_to_null(F.col("area")))).alias("n_areas"))
    cat = F.coalesce(C.blank_to_null(F.col("v_category")), C.kind_category(F.col("kind"), tables=True))
    data = cat == "data"
    f = figures.agg(*[fmt(F.count_if(cat == c)).alias(f"n_{c}") for c in ("table", "data", "method")], *[fmt(F.count_if(data & (F.col("v_chart_type") == c))).alias(f"n_{c}") for c in ("heatmap", "line", "bar")])
    return p.join(f, F.lit(True))  # two one-row aggregates


def n_originals(figures: DataFrame) -> DataFrame:
    """Figures as they stand in the papers: whole ones, and once each composite whose panels are shown.

    One grouping by id: every row stands under its own id, panels also under their parent's; a parent that is no row's own id is a composite.
    """
    entry = lambda c, parent, whole: F.struct(c.alias("id"), parent.alias("parent"), whole.cast("long").alias("whole"))
    panel = F.col("parent").isNotNull()
    entries = F.array(entry(F.col("fig_id"), F.lit(False), ~panel), F.when(panel, entry(F.col("parent"), F.lit(True), F.lit(False))))
    rows = figures.select("paper_key", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("paper_key", "e.*")
    ids = rows.groupBy("paper_key", "id").agg(F.sum("whole").alias("whole"), F.max("parent").alias("named"), F.min("parent").alias("unknown"))
    # ids of a null paper equal none
    lone = F.col("named") & (F.col("unknown") | F.col("paper_key").isNull())
    return ids.agg((F.coalesce(F.sum("whole"), F.lit(0)) + F.count_if(lone)).alias("n_figures"))


def data_updated(files: DataFrame) -> DataFrame:
    """Date of the newest record file; today when there is none."""
    return files.agg(F.date_format(F.coalesce(F.max("modified"), F.current_timestamp()), "yyyy-MM-dd").alias("updated"))


#: What the page needs of a figure, of its picture and of its label.
SLIM_FIELDS = ("fig_id", "num", "page", "caption", "kind", "has_raster", "full_width", "panel", "n_panels", "thumb", "full", "chart_guess")
SLIM_EXTRA = ("px_w", "px_h", "rotated", "tw", "th", "density")
SLIM_LABEL = ("category", "chart_type", "tags", "summary_zh", "verified")
SLIM_AUTHORS = 6
OLD_DPI = 170


def slim_index(papers: DataFrame, figures: DataFrame) -> DataFrame:
    """Nested rows for the page: papers with six authors and their figures in order, each with 12 fields, what is known of the picture and its label.

    Figures have `pos` and all of SLIM_FIELDS, SLIM_EXTRA and SLIM_LABEL (the last with v_ in front); a missing column is an error, a missing
    number of the picture is 0, a paper's missing resolution OLD_DPI. A figure without a category has no label.
    """
    extra = F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in SLIM_EXTRA])
    label = F.when(F.col("v_category").isNotNull(), F.struct(*[F.col(f"v_{c}").alias(c) for c in SLIM_LABEL]))
    per = figures.groupBy("paper_key").agg(F.sort_array(F.collect_list(F.struct("pos", *SLIM_FIELDS, extra.alias("extra"), label.alias("vision")))).alias("figures"))
    joined = papers.withColumn("authors", F.slice(F.coalesce("authors", F.array().cast("array<string>")), 1, SLIM_AUTHORS)).join(per, "paper_key", "left")
    dpi = F.coalesce("dpi", F.lit(OLD_DPI))
    slim = F.transform("figures", lambda f: f.dropFields("pos").withField("extra", f["extra"].withField("dpi", dpi)))
    return joined.withColumn("figures", F.coalesce(slim, F.array().cast(joined.select(slim.alias("f")).schema["f"].dataType)))


def assign_shards(papers: DataFrame, n: int) -> DataFrame:
    """Contiguous shards of papers in key order.

    Rows are range-partitioned and numbered inside their partitions; a count per partition (one small row each) gives
    the offsets, so no task sees all papers.
    """
    spark = papers.sparkSession
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_path(spark, "ranged")
    # range bounds come from a sample, so the ranged rows are written once: counts and rows must agree
    papers.repartitionByRange(parts, "paper_key").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    spread = spark.read.parquet(path)
    numbered = spread.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("paper_key")))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition, no more
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    placed = numbered.join(F.broadcast(before), "_part").join(F.broadcast(total), F.lit(True))
    per = F.greatest(F.lit(1), F.ceil(F.col("_total") / n))
    return placed.withColumn("shard", F.floor((F.col("_before") + F.col("_n") - 1) / per).cast("int")).drop("_part", "_n", "_before", "_total")


def exclude_sources(papers: DataFrame, sources: tuple[str, ...] = ("local",)) -> DataFrame:
    return papers.filter(~F.col("source").isin(*sources)) if sources else papers


def figure_of_file(name: Column) -> Column:
    return F.regexp_replace(name, r"(\.thumb)?\.(png|webp)$", "")


def publish_files(files: DataFrame, figures: DataFrame) -> DataFrame:
    """Stored files (name) of published figures."""
    return files.withColumn("fig_id", figure_of_file(F.col("name"))).join(figures.select("fig_id"), "fig_id", "left_semi")


def stale_files(files: DataFrame, all_figures: DataFrame) -> DataFrame:
    """Stored files that no index record names, folded copies and split composites included."""
    return files.withColumn("fig_id", figure_of_file(F.col("name"))).join(all_figures.select("fig_id"), "fig_id", "left_anti")


def index_header(papers: DataFrame, figures: DataFrame, files: DataFrame) -> DataFrame:
    """One row: counts, date and the table of areas (id, both labels, group, headline venues)."""
    areas = [F.struct(*[F.lit(x).alias(n) for x, n in zip(area, ("id", "zh", "en", "group"))], F.array(*map(F.lit, area[4])).alias("top")) for area in L.AREAS]
    one = papers.agg(F.count("*").alias("n_papers"))
    for part in (n_originals(figures), figures.agg(F.count("*").alias("n_entries")), data_updated(files)):
        one = one.join(part, F.lit(True))  # one-row aggregates
    return one.withColumn("areas", F.array(*areas))
