"""Page tables stored by page: plans without exchanges, and the same rows however they lie."""

import re

import pytest

from vignetta.operators import boxes, layout
from vignetta.plans import registry
from vignetta.sources.page_store import stored_pages

SF = "/root/testdata/sf0.001"
CAPTION = "paper_key string, page int, elem_id long, kind string, num string, caption string, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double, left double, right double, col int, bx0 double, bx1 double"
VISUAL = "paper_key string, page int, elem_id long, elem_type string, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"
HEADER = "paper_key string, page int, header double"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    return len(re.findall(r"\bExchange \w+", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name", ["e7_region_top", "e8_locate_figure", "e9_grow_labels", "e10_locate_by_text_gap", "e13_locate_table", "e14_assign_fig_ids", "e15_rotation_of"])
def test_page_work_moves_no_rows(spark, no_broadcast, name):
    assert exchanges(registry.queries()[name](spark, SF)) == 0


def caption(elem_id, kind, y0, page=1, key="a"):
    return (key, page, elem_id, kind, str(elem_id), f"{kind} {elem_id}", 50.0, y0, 250.0, y0 + 10, 600.0, 800.0, 40.0, 560.0, -1, 8.0, 592.0)


def draw(elem_id, y0, y1, page=1, key="a", kind="draw"):
    return (key, page, elem_id, kind, 60.0, y0, 240.0, y1, 600.0, 800.0)


def tops(spark, captions, visuals, header=(), store=None):
    c, v, h = spark.createDataFrame(captions, CAPTION), spark.createDataFrame(visuals, VISUAL), spark.createDataFrame(list(header), HEADER)
    if store:
        c, v, h = (stored_pages(t, n, store) for t, n in ((c, "c"), (v, "v"), (h, "h")))
    regions = layout.region_top(c, v, h)
    found = layout.locate_figure(regions, v)
    return sorted((r.elem_id is None, r.elem_id or 0, r.page or 0, r.top) for r in regions.collect()), sorted(tuple(r) for r in found.select("elem_id", "page", "fx0", "fy0", "fx1", "fy1", "has_raster", "n_drawings").collect())


@pytest.mark.parametrize("store", [None, 1, 5])
def test_region_tops(spark, store):
    captions = [
        caption(1, "table", 100.0), caption(2, "figure", 400.0),  # drawings hang under the table: the region starts below them
        caption(1, "table", 100.0, 2), caption(2, "figure", 400.0, 2),  # the only drawing hangs too low: the table's own edge counts
        caption(2, "figure", 400.0, 3),  # alone: the header counts
        caption(None, "figure", 400.0, 4),  # no id: matches nothing
        caption(2, "figure", 400.0, None),  # no page: matches nothing
    ]
    visuals = [draw(7, 115.0, 150.0), draw(8, 160.0, 220.0), draw(9, 300.0, 395.0), draw(9, 300.0, 395.0, 2), draw(9, 300.0, 395.0, 4)]
    got, found = tops(spark, captions, visuals, [("a", 3, 33.0)], store)
    assert got == [(False, 1, 1, 0.0), (False, 1, 2, 0.0), (False, 2, 0, 0.0), (False, 2, 1, 220.0), (False, 2, 2, 110.0), (False, 2, 3, 33.0), (True, 0, 4, 0.0)]
    assert found == [(2, 1, 60.0, 300.0, 240.0, 395.0, False, 1), (2, 2, 60.0, 300.0, 240.0, 395.0, False, 1)]


@pytest.mark.parametrize("store", [None, 3])
def test_empty_pages(spark, store):
    assert tops(spark, [], [], (), store) == ([], [])
    assert tops(spark, [caption(1, "figure", 90.0)], [], (), store) == ([(False, 1, 1, 0.0)], [])


def test_scanned_page_without_text(spark):
    c = spark.createDataFrame([caption(1, "figure", 500.0), caption(2, "figure", 700.0, 2)], CAPTION)
    v = spark.createDataFrame([("a", 1, 5, "image", 0.0, 0.0, 600.0, 800.0, 600.0, 800.0)], VISUAL)
    regions = layout.region_top(c, v, spark.createDataFrame([], HEADER))
    words = spark.createDataFrame([("a", 1, 0.0, 300.0, 90.0)], "paper_key string, page int, x0 double, x1 double, y1 double")
    box = lambda blocks: [tuple(r) for r in layout.locate_by_text_gap(regions, blocks, v).select("elem_id", "fx0", "fy0", "fx1", "fy1").collect()]
    assert box(words) == [(1, 14.0, 94.0, 586.0, 499.0)]
    assert box(words.limit(0)) == [(1, 14.0, 4.0, 586.0, 499.0)]


def test_rotation_of_figures_with_and_without_text(spark):
    figs = spark.createDataFrame([("a", 1, "f1", 0.0, 0.0, 100.0, 100.0), ("a", 1, "f2", 200.0, 0.0, 300.0, 100.0), ("a", 2, "f3", 0.0, 0.0, 9.0, 9.0)], "paper_key string, page int, fig_id string, fx0 double, fy0 double, fx1 double, fy1 double")
    line = lambda x, dx, dy, text: ("a", 1, x, 10.0, x + 5, 20.0, dx, dy, text)
    lines = spark.createDataFrame([line(10.0, 0.0, -1.0, "x" * 30), line(210.0, 0.0, 1.0, "y" * 30), line(220.0, 1.0, 0.0, "z" * 10), line(50.0, 1.0, 0.0, None)], "paper_key string, page int, x0 double, y0 double, x1 double, y1 double, dir_x double, dir_y double, text string")
    assert sorted(tuple(r) for r in layout.rotation_of(figs, lines).collect()) == [("f1", -90), ("f2", 90), ("f3", 0)]


def test_stored_pages_hold_every_row(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), (None, 1, "y"), ("b", None, None)]
    df = spark.createDataFrame(rows, "paper_key string, page int, text string")
    for n in (1, 7):
        assert sorted(map(str, stored_pages(df, "rows", n).collect())) == sorted(map(str, df.collect()))
    assert stored_pages(df.limit(0), "none", 2).collect() == []
    assert boxes.PAGE == layout.PAGE
