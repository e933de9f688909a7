"""Page layout to figures: captions, bands, region tops, figure and table boxes, ids, metadata, plans.

All page work is keyed by (paper_key, page): joins are on the page alone, groupings and windows start with it. Over tables
stored by page (sources.page_store) none of it moves rows between executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lookups as L

PAGE = ["paper_key", "page"]
CAPTION_GAP, ELEMENT_GAP = 60.0, 28.0
MIN_W, MIN_H = 70.0, 40.0


def text_extent(blocks: DataFrame) -> DataFrame:
    """Left and right edge of a page's text, picked by index near the 5th and 95th percent."""
    at = lambda c, i: F.element_at(F.sort_array(F.collect_list(c)), i.cast("int") + 1)
    n = F.count("*")
    return blocks.groupBy(*PAGE).agg(at("x0", F.floor(n * 0.05)).alias("left"), at("x1", F.greatest(F.lit(0), F.floor(n * 0.95) - 1)).alias("right"))


def find_captions(blocks: DataFrame, extent: DataFrame) -> DataFrame:
    """Caption blocks with kind, num, column (-1 full width, 0 left, 1 right)."""
    flat = F.regexp_replace(F.regexp_replace("text", r"(?U)\s+", " "), "^ | $", "")
    part = lambda i: F.regexp_extract("flat", L.CAPTION, i)
    rows = blocks.withColumn("flat", flat).filter(F.col("flat").rlike(L.CAPTION)).withColumns({"word": F.lower(part(1)), "raw_num": part(2), "sep": part(3), "rest": part(4)})
    body = (F.regexp_replace("sep", r"(?U)\s+", "") == "") & F.col("rest").rlike(L.BODY_VERBS)
    rows = rows.filter(~body & (F.col("y1") - F.col("y0") <= F.col("page_h") * 0.35)).join(extent, PAGE)
    return rows.select(
        *PAGE, "elem_id", F.when(F.col("word").isin("table", "表"), "table").otherwise("figure").alias("kind"), F.regexp_replace("raw_num", r"(?U)\s+", "").alias("num"),
        F.col("flat").alias("caption"), "x0", "y0", "x1", "y1", "page_w", "page_h", "left", "right", caption_column().alias("col"),
    )


def caption_column() -> Column:
    x0, x1, left, right = F.col("x0"), F.col("x1"), F.col("left"), F.col("right")
    mid = (left + right) / 2
    full = (x1 - x0 > 0.62 * (right - left)) | ((x0 < mid - 20) & (x1 > mid + 20))
    return F.when(full, -1).when((x0 + x1) / 2 > mid, 1).otherwise(0)


def caption_band(captions: DataFrame) -> DataFrame:
    """The horizontal band a caption's figure may fill."""
    mid = (F.col("left") + F.col("right")) / 2
    return captions.withColumns({
        "bx0": F.when(F.col("col") == -1, 8.0).when(F.col("col") == 0, F.col("left") - 10).otherwise(mid - 4),
        "bx1": F.when(F.col("col") == -1, F.col("page_w") - 8).when(F.col("col") == 0, mid + 4).otherwise(F.col("right") + 10),
    })


def visual_rects(elements: DataFrame) -> DataFrame:
    """Images and drawings clipped to the page, without specks and header rules."""
    rows = elements.filter("elem_type IN ('image', 'draw')").withColumns({"x0": F.greatest("x0", F.lit(0.0)), "y0": F.greatest("y0", F.lit(0.0)), "x1": F.least("x1", "page_w"), "y1": F.least("y1", "page_h")})
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    image = F.col("elem_type") == "image"
    hairline = (h < 1.5) & (w > 0.55 * F.col("page_w"))
    return rows.filter((w > 0) & (h > 0) & ((image & (w >= 4) & (h >= 4)) | (~image & ~hairline & ~((w < 1) & (h < 1)))))


def header_bottom(blocks: DataFrame) -> DataFrame:
    """Lowest edge of one-line blocks wholly in the top 8 % of a page, else the page's top."""
    head = (F.col("y1") <= 0.08 * F.col("page_h")) & (F.col("y1") - F.col("y0") < 24) & ~F.trim("text").contains("\n")
    return blocks.groupBy(*PAGE).agg(F.coalesce(F.max(F.when(head, F.col("y1"))), F.lit(0.0)).alias("header"))


def _with_elements(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """rows with the columns of found for the same (page, elem_id), of which found has one row at most; how is inner or left.

    found travels as one map for each page: a join on elem_id too would move both sides.
    """
    cols = [c for c in found.columns if c not in (*PAGE, "elem_id")]
    of = found.filter("elem_id IS NOT NULL").groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("elem_id", F.struct(*cols)))).alias("_of"))
    got = rows.join(of, PAGE, how).withColumn("_of", F.try_element_at("_of", F.col("elem_id")))
    got = got.filter("_of IS NOT NULL") if how == "inner" else got
    return got.select(*rows.columns, *[F.col("_of")[c].alias(c) for c in cols])


def _cuts(rows: DataFrame, key: list[str], order: list[Column], edge: Column, stop: Column) -> DataFrame:
    """rows with `cut`, the number of rows of the key up to this one that `stop` cuts off; `edge` is named reach in stop and runs over earlier rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumn("reach", edge.over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("_stop", F.when(stop, 1).otherwise(0)).withColumn("cut", F.sum("_stop").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_stop")


def region_top(captions: DataFrame, visuals: DataFrame, header: DataFrame) -> DataFrame:
    """Captions (with band) and the lowest edge of what belongs to something else above each.

    A table above reaches down through the drawings that hang contiguously under its caption.
    """
    o = captions.select(*PAGE, F.col("elem_id").alias("o_id"), F.col("kind").alias("o_kind"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "x1", "y1")])
    near = captions.join(o, PAGE).filter("o_id <> elem_id AND o_y1 <= y0 - 5 AND o_x1 >= bx0 AND o_x0 <= bx1").select(*PAGE, "elem_id", "y0", "bx0", "bx1", "o_id", "o_kind", "o_y1")
    d = visuals.filter("elem_type = 'draw'").select(*PAGE, F.col("elem_id").alias("v_id"), *[F.col(c).alias(f"v_{c}") for c in ("x0", "y0", "x1", "y1")])
    d = d.select(*[F.col(c).alias(f"d_{c}") if c in PAGE else F.col(c) for c in d.columns])
    under = (F.col("paper_key") == F.col("d_paper_key")) & (F.col("page") == F.col("d_page")) & F.expr("o_kind = 'table' AND v_y0 >= o_y1 - 2 AND v_y1 <= y0 - 2 AND v_x1 > bx0 AND v_x0 < bx1")
    hung = _cuts(near.join(d, under, "left"), [*PAGE, "elem_id", "o_id"], [F.col("v_y0"), F.col("v_id")], F.max("v_y1"), F.col("v_y0") > F.greatest("o_y1", F.coalesce("reach", "o_y1")) + ELEMENT_GAP)
    tops = hung.groupBy(*PAGE, "elem_id").agg(F.max(F.greatest("o_y1", F.when(F.col("cut") == 0, F.col("v_y1")))).alias("bottom"))
    rows = _with_elements(captions.join(header, PAGE, "left"), tops, "left")
    return rows.withColumn("top", F.greatest(F.coalesce("header", F.lit(0.0)), F.coalesce("bottom", F.lit(0.0)))).drop("header", "bottom")


def locate_figure(regions: DataFrame, visuals: DataFrame) -> DataFrame:
    """The visuals stacked above each figure caption as one box (fx0 .. fy1), with has_raster and n_drawings.

    Pages with an image of over 80 % of the page are left to locate_by_text_gap.
    """
    v = visuals.select(*PAGE, F.col("elem_id").alias("v_id"), "elem_type", *[F.col(c).alias(f"v_{c}") for c in ("x0", "y0", "x1", "y1")])
    scanned = scanned_pages(visuals)
    j = regions.filter("kind = 'figure'").join(scanned, PAGE, "left_anti").join(v, PAGE)
    seen = {"s_x0": F.greatest("v_x0", "bx0"), "s_x1": F.least("v_x1", "bx1"), "s_y0": F.greatest("v_y0", F.col("top") - 2), "s_y1": F.least("v_y1", F.col("y0") + 2)}
    j = j.filter("v_y1 <= y0 + 2 AND v_y0 >= top - 2").withColumns(seen)
    j = j.filter("s_x1 - s_x0 >= 1 AND s_y1 > s_y0 AND (col = -1 OR s_x1 - s_x0 >= 0.5 * (v_x1 - v_x0))")
    key = [*PAGE, "elem_id"]
    stop = F.when(F.col("reach").isNull(), F.col("s_y1") < F.col("y0") - CAPTION_GAP).otherwise(F.col("s_y1") < F.least("y0", "reach") - ELEMENT_GAP)
    got = _cuts(j, key, [F.desc("s_y1"), (F.col("elem_type") == "draw"), F.col("v_id")], F.min("s_y0"), stop).filter("cut = 0")
    box = got.groupBy(*key).agg(F.min("s_x0").alias("fx0"), F.min("s_y0").alias("fy0"), F.max("s_x1").alias("fx1"), F.max("s_y1").alias("fy1"), F.max(F.col("elem_type") == "image").alias("has_raster"), F.count_if(F.col("elem_type") == "draw").alias("n_drawings"))
    return _with_elements(regions, box, "inner").filter((F.col("fx1") - F.col("fx0") >= MIN_W) & (F.col("fy1") - F.col("fy0") >= MIN_H))


def scanned_pages(visuals: DataFrame) -> DataFrame:
    big = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > 0.8 * F.col("page_w") * F.col("page_h")
    return visuals.filter((F.col("elem_type") == "image") & big).select(*PAGE).distinct()


def locate_by_text_gap(regions: DataFrame, blocks: DataFrame, visuals: DataFrame) -> DataFrame:
    """On scanned pages the figure is the gap between the last wide text above and the caption."""
    caps = regions.filter("kind = 'figure'").join(scanned_pages(visuals), PAGE, "left_semi")
    b = blocks.select(*PAGE, *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y1")])
    wide = caps.join(b, PAGE).filter("b_y1 <= y0 - 4 AND b_y1 >= top AND b_x1 >= bx0 AND b_x0 <= bx1 AND b_x1 - b_x0 >= 0.45 * (bx1 - bx0)")
    floor = wide.groupBy(*PAGE, "elem_id").agg(F.max("b_y1").alias("floor"))
    j = _with_elements(caps, floor, "left").withColumns({
        "fx0": F.greatest(F.lit(0.0), F.col("bx0") + 6), "fy0": F.greatest(F.col("top"), F.coalesce("floor", "top")) + 4, "fx1": F.least("page_w", F.col("bx1") - 6), "fy1": F.least("page_h", F.col("y0") - 1),
        "has_raster": F.lit(True), "n_drawings": F.lit(0).cast("long"),
    }).drop("floor")
    return j.filter((F.col("fx1") - F.col("fx0") >= MIN_W) & (F.col("fy1") - F.col("fy0") >= MIN_H))


def page_lines(words: DataFrame) -> DataFrame:
    """Words to lines: union box, widest gap between neighbours, text from left to right."""
    line = [*PAGE, "block", "line"]
    gap = F.lead("x0").over(Window.partitionBy(*line).orderBy("x0", "word_no")) - F.col("x1")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_no", "word"))), lambda w: w["word"]), " ")
    return words.withColumn("gap", gap).groupBy(*line).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap"), text.alias("text"))


def page_rules(drawings: DataFrame) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return drawings.filter(((h <= 2.5) & (w >= 30)) | ((w <= 2.5) & (h >= 20)))


def fig_slug(num: Column) -> Column:
    return F.regexp_replace(num, "[^0-9A-Za-z.]+", "")


def assign_fig_ids(located: DataFrame) -> DataFrame:
    """The first located box of each page, kind and number, with its id."""
    rows = located.withColumn("slug", fig_slug(F.col("num")))
    nth = F.row_number().over(Window.partitionBy(*PAGE, "kind", "slug").orderBy("elem_id"))
    tag = F.when(F.col("kind") == "table", "__tab").otherwise("__fig")
    return rows.withColumn("_n", nth).filter("_n = 1").withColumn("fig_id", F.concat("paper_key", F.lit("__p"), F.col("page").cast("string"), tag, "slug")).drop("_n", "slug")


def rotation_of(figures: DataFrame, lines: DataFrame) -> DataFrame:
    """Degrees that make the text in a figure's box horizontal; figures has one row for each fig_id with its box, lines have dir_x and dir_y."""
    ln = lines.select(*[F.col(c).alias(f"l_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")], "dir_x", "dir_y", F.length(F.trim("text")).alias("chars"))
    inside = (F.col("paper_key") == F.col("l_paper_key")) & (F.col("page") == F.col("l_page")) & F.expr("chars >= 2 AND l_x0 < fx1 AND l_x1 > fx0 AND l_y0 < fy1 AND l_y1 > fy0")
    level = F.abs("dir_x") >= 0.5
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("chars"))), F.lit(0))
    boxes = figures.select(*PAGE, "fig_id", "fx0", "fy0", "fx1", "fy1").join(ln, inside, "left")
    sums = boxes.groupBy(*PAGE, "fig_id").agg(total(level).alias("horiz"), total(~level & (F.col("dir_y") < 0)).alias("up"), total(~level & (F.col("dir_y") >= 0)).alias("down"))
    vert = F.col("up") + F.col("down")
    angle = F.when((vert + F.col("horiz") < 20) | (vert <= 1.5 * F.col("horiz")), 0).when(F.col("up") >= F.col("down"), -90).otherwise(90)
    return sums.select("fig_id", angle.alias("rotated"))


def title_from_largest_text(lines: DataFrame) -> DataFrame:
    """Lines of nearly the largest size in the upper half of the first page, top to bottom, as one title."""
    usable = lines.filter((F.abs("dir_x") >= 0.9) & (F.col("y0") <= 0.5 * F.col("page_h")) & (F.length(F.trim("text")) >= 3) & ~F.col("text").rlike(L.ARXIV_STAMP))
    big = usable.withColumn("best", F.max("size").over(Window.partitionBy("paper_key"))).filter("size >= 0.85 * best")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "line_no", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    return big.groupBy("paper_key").agg(F.substring(F.trim(F.regexp_replace(joined, r"(?U)\s+", " ")), 1, 200).alias("title"))


def paper_meta(pages: DataFrame, largest: DataFrame | None = None) -> DataFrame:
    """arXiv id, venue, year and title from a paper's first page (paper_key, file_title, text)."""
    head = F.substring("text", 1, 3000)
    years = F.regexp_extract_all(head, F.lit(r"\b(20[0-3][0-9])\b"), F.lit(1))
    stamp = F.regexp_extract("text", L.STAMP_YEAR, 1)
    junk = F.col("file_title").rlike(r"(?i)\.(dvi|tex|pdf)$|untitled|^\s*$")
    rows = pages.join(largest.withColumnRenamed("title", "largest"), "paper_key", "left") if largest is not None else pages.withColumn("largest", F.lit(None).cast("string"))
    return rows.select(
        "paper_key", F.regexp_extract("text", L.ARXIV_STAMP, 1).alias("arxiv_id"), F.regexp_extract(head, L.VENUES_IN_TEXT, 1).alias("venue"),
        F.coalesce(C.blank_to_null(stamp), F.array_max(years), F.lit("")).alias("year"),
        F.coalesce(F.when(~junk, F.trim("file_title")), C.blank_to_null(F.col("largest")), F.col("paper_key")).alias("title"),
    )


def is_fresh(record: Column, mtime: Column, version: int, dpi: int) -> Column:
    """Whether a record (null if there is none) is a good one of the file of that time, of this version and resolution."""
    fresh = record["error"].isNull() & (F.abs(record["pdf_mtime"] - mtime) < 1) & (record["extractor_version"] == version) & (record["dpi"] == dpi)
    return F.coalesce(record.isNotNull() & fresh, F.lit(False))


def extract_plan(files: DataFrame, index: DataFrame, version: int = L.EXTRACTOR_VERSION, dpi: int = 300, force: bool = False) -> DataFrame:
    """Stored papers to process: no good record, another file time, another version or resolution."""
    j = files.join(index.select("paper_key", F.struct("error", "pdf_mtime", "extractor_version", "dpi").alias("_record")), "paper_key", "left")
    return j.filter(F.lit(force) | ~is_fresh(F.col("_record"), F.col("mtime"), version, dpi)).select(*files.columns)


def pdf_inventory(dirs: list[DataFrame]) -> DataFrame:
    """Files (paper_key, name, ...) of several directories; translated copies are skipped, the first of a key counts."""
    rows = None
    for i, d in enumerate(dirs):
        r = d.filter(~F.col("name").contains(".zh.")).withColumn("dir_seq", F.lit(i))
        rows = r if rows is None else rows.unionByName(r)
    nth = F.row_number().over(Window.partitionBy("paper_key").orderBy("dir_seq", "name"))
    return rows.withColumn("_n", nth).filter("_n = 1").drop("_n")


def carry_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Labels of old rows on new rows of the same page and number; panels only where the id is unchanged."""
    last = F.row_number().over(Window.partitionBy("paper_key", "page", "num").orderBy(F.desc("pos")))
    prev = old.filter("parent IS NULL").withColumn("_n", last).filter("_n = 1")
    prev = prev.select("paper_key", "page", "num", F.col("fig_id").alias("o_id"), F.col("v_category").alias("o_cat"), F.col("v_chart_type").alias("o_type"), F.col("v2_category").alias("o_v2"), F.col("panels").alias("o_panels"), *([F.col("v_tags").alias("o_tags")] if "v_tags" in new.columns else []))
    j = new.join(prev, ["paper_key", "page", "num"], "left")
    labelled = F.col("o_cat").isNotNull()
    same = F.col("o_panels").isNotNull() & (F.col("o_id") == F.col("fig_id"))
    kept = j.withColumns({"v_category": F.coalesce("o_cat", "v_category"), "v_chart_type": F.when(labelled, F.col("o_type")).otherwise(F.col("v_chart_type")), "v2_category": F.coalesce("o_v2", "v2_category"), "panels": F.when(same, F.col("o_panels")).otherwise(F.col("panels"))})
    if "v_tags" in new.columns:
        kept = kept.withColumn("v_tags", F.when(labelled, F.col("o_tags")).otherwise(F.col("v_tags")))
    # a new row's previous one is the row of its own id: known from the ids alone, without the labels' join
    parents = prev.filter("o_panels IS NOT NULL").select("paper_key", "page", "num", F.col("o_id").alias("fig_id")).join(new.select("paper_key", "page", "num", "fig_id"), ["paper_key", "page", "num", "fig_id"]).select(F.col("fig_id").alias("parent"))
    panels = old.filter("parent IS NOT NULL").join(parents, "parent", "left_semi")
    return kept.select(*new.columns).unionByName(panels.select(*new.columns))


def replace_tables(figures: DataFrame, tables: DataFrame) -> DataFrame:
    return figures.filter(~F.col("fig_id").contains("__tab")).unionByName(tables)


def refresh_meta(papers: DataFrame, meta: DataFrame) -> DataFrame:
    """New title, venue, year and id for good records that have them; the rest stay."""
    m = meta.select("paper_key", *[F.col(c).alias(f"m_{c}") for c in ("title", "arxiv_id", "venue", "year")])
    j = papers.join(m, "paper_key", "left")
    use = F.col("error").isNull() & F.col("m_title").isNotNull()
    pick = lambda new, old: F.when(use, F.col(new)).otherwise(F.col(old)).alias(old)
    return j.select("paper_key", pick("m_title", "pdf_title"), pick("m_arxiv_id", "pdf_arxiv_id"), pick("m_venue", "pdf_venue"), pick("m_year", "pdf_year"), "error")


def prune_plan(files: DataFrame, sidecars: DataFrame, index: DataFrame, version: int = L.EXTRACTOR_VERSION) -> DataFrame:
    """Files that may go: their figures were extracted from this very file by the current version."""
    good = index.filter((F.col("error").isNull()) & (F.col("extractor_version") == version)).select("paper_key", "pdf_mtime")
    return files.join(sidecars.select("paper_key"), "paper_key", "left_semi").join(good, "paper_key").filter("abs(pdf_mtime - mtime) < 1").select(*files.columns)
