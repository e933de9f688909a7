"""Operators on hand-written rows: the cases that are easy to get wrong."""

import collections
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vignetta.functions import columns as C
from vignetta.operators import boxes, build, candidates, chartmodel, labels, panels, seeds
from vignetta.sources import readers, writers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_seed_lines(spark):
    lines = [(0, 1, "2101.00001v2 # NeurIPS 2022 Best Paper: T # more"), (0, 2, "# note"), (0, 3, ""), (0, 4, "NOPDF # CHI 2020"), (0, 5, "https://arxiv.org/pdf/2101.00001 extra # 2023 x"), (0, 6, "no id # CHI 2021"), (1, 1, "see 2101.00001 # ICML 2024")]
    df = spark.createDataFrame(lines, "file_seq int, line_no long, line string")
    got = {(r["file_seq"], r["line_no"]): r for r in seeds.parse_seeds(df).collect()}
    assert set(got) == {(0, 1), (0, 5), (1, 1)}
    assert got[0, 1]["venue_hint"] == "NeurIPS" and got[0, 1]["year_hint"] == "2022" and got[0, 1]["note"].endswith("# more")
    assert got[0, 5]["key"] == "arxiv-2101.00001" and got[0, 5]["venue_hint"] == "" and got[0, 5]["year_hint"] == "2023"
    kept = {r["key"]: r["line_no"] for r in seeds.dedupe_seeds(seeds.parse_seeds(df)).collect()}
    assert kept == {"2101.00001": 1, "arxiv-2101.00001": 5}


def test_url_keys(spark):
    urls = {"https://openreview.net/pdf?id=Ab-1_c": "openreview-Ab-1_c", "https://www.usenix.org/a/b c.PDF": None, "https://dl.acm.org/doi/pdf/10.1/": "acm-10.1", "https://x.example.com/": "example-paper"}
    for url, want in urls.items():
        if want:
            assert spark.createDataFrame([(url,)], "u string").withColumns(C.url_parts(F.col("u"))).select(C.key_of_parts().alias("k")).first()["k"] == want


def test_areas(spark):
    for venue, area in {"Science Robotics": "preprint", "CSCW": "", "SIGGRAPH Asia 2023": "graphics", "Proc. ICDE": "db", "ICDEX": "", "": ""}.items():
        assert one(spark, build.area_of(F.col("v")), v=venue) == area


def test_caption_kind_order(spark):
    kind = C.caption_kind(F.col("c"), F.col("n"), F.col("p"), F.col("r"), F.col("d"))
    cases = [(("Prompt for x", "3", 4, False, 2), "prompt"), (("A view", "1", 1, False, 0), "teaser"), (("Accuracy", "1", 1, False, 0), "result"), (("Overview of accuracy", "2", 5, True, 0), "method"), (("Samples", "4", 5, True, 0), "example"), (("Nothing", "4", 5, False, 0), "other")]
    for values, want in cases:
        assert one(spark, kind, **dict(zip("cnprd", values))) == want


def test_labels(spark):
    replies = [("a", '```json{"category": "DATA", "chart_type": "sunburst", "tags": "A, ,b", "summary_zh": " s "}```'), ("b", '{"category": "weird", "chart_type": "bar", "tags": ["X", ""]}'), ("c", "no json")]
    got = {r["fig_id"]: r for r in labels.parse_labels(spark.createDataFrame(replies, "fig_id string, reply string")).collect()}
    assert (got["a"]["category"], got["a"]["chart_type"], got["a"]["tags"]) == ("data", "other", ["a", "b"])
    assert (got["b"]["category"], got["b"]["chart_type"], got["b"]["tags"]) == ("other", "", ["x"])


def test_label_function_fails_early(spark):
    import pytest

    def broken(batch):
        raise ValueError("no key")

    figs = spark.createDataFrame([("a", "c", "result", None, None, None)], "fig_id string, caption string, kind string, v_category string, v_chart_type string, v_tags array<string>")
    with pytest.raises(ValueError, match="no key"):
        labels.label_figures(figs, broken)
    assert labels.label_figures(figs).first()["v_category"] == "data"


def test_null_and_empty_panels(spark):
    rows = spark.createDataFrame([("a", None), ("b", []), ("c", ["c_s1", "c_s2"])], "fig_id string, panels array<string>")
    assert {r["fig_id"] for r in build.hide_composites(rows).collect()} == {"a", "b"}


def test_fold_prefers_file_name_order(spark):
    rows = spark.createDataFrame([("a-b", "T!", "local", 2), ("a", "t", "local", 2), ("z", "", "local", 1), ("y", "表", "seed", 1)], "paper_key string, title string, source string, n_figs int")
    assert {r["paper_key"] for r in build.fold_by_title(rows).collect()} == {"a-b", "z", "y"}


def test_pick_filters_before_keeping_the_first(spark):
    cands = spark.createDataFrame([("V", "T", 9, 2021, None, "https://dl.acm.org/x", 1), ("V", "t!", 8, 2021, "2101.00002", None, 2), ("V", "Old", 7, 2021, "2101.00003", None, 3)], "venue string, title string, citations long, year int, arxiv string, oa_url string, cand_id long")
    venues = spark.createDataFrame([("V", "v", 5)], "venue string, short string, want int")
    ids, titles = spark.createDataFrame([("2101.00003",)], "known_id string"), spark.createDataFrame([("zzz",)], "known_title string")
    assert [r["cand_id"] for r in candidates.pick_top_cited(cands, venues, ids, titles).collect()] == [2]


def test_label_growth_is_stable():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lo = rng.uniform(0, 500, (30, 2))
        blocks = np.concatenate([lo, lo + rng.uniform(5, 60, (30, 2))], axis=1)
        box = boxes.grow_box(np.array([200.0, 200, 300, 300]), blocks, (0, 600), 0, 590)
        assert (boxes.grow_box(box, blocks, (0, 600), 0, 590) == box).all()


def tables(spark, lines, rules=(), caps=((1, "table", "1", 50.0, 100.0, 300.0, 112.0),)):
    c = spark.createDataFrame([("p", 1, *x, 40.0, 310.0) for x in caps], "paper_key string, page int, elem_id int, kind string, num string, x0 double, y0 double, x1 double, y1 double, bx0 double, bx1 double")
    n = spark.createDataFrame([("p", 1, *x) for x in lines], "paper_key string, page int, x0 double, y0 double, x1 double, y1 double, max_gap double, text string")
    r = spark.createDataFrame([("p", 1, *x) for x in rules], "paper_key string, page int, x0 double, y0 double, x1 double, y1 double")
    return [tuple(b[k] for k in ("elem_id", "fx0", "fy0", "fx1", "fy1")) for b in boxes.locate_table(c, n, r).orderBy("elem_id").collect()]


def test_table_bodies(spark):
    cells = lambda y, n=5, gap=20.0, text="a 1": [(50.0, y + 12 * i, 300.0, y + 10 + 12 * i, gap, text) for i in range(n)]
    far = [(50.0, 400.0, 300.0, 410.0, 20.0, "far 2")]
    assert tables(spark, cells(120.0) + far) == [(1, 47.0, 117.0, 303.0, 181.0)]
    assert tables(spark, cells(120.0, 1) + far) == [] and tables(spark, far * 0) == []
    # more lines above the caption than below it
    assert tables(spark, cells(120.0, 2) + cells(20.0, 6)) == [(1, 47.0, 17.0, 303.0, 93.0)]
    # plain prose ends a body unless rules hug it; a rule with clear space after it ends one too
    prose = [(50.0, 144.0, 300.0, 154.0, 3.0, "running text"), (50.0, 156.0, 300.0, 166.0, 20.0, "b 2")]
    assert tables(spark, cells(120.0, 2) + prose) == [(1, 47.0, 117.0, 303.0, 145.0)]
    assert tables(spark, cells(120.0, 2) + prose, [(45.0, 143.0, 305.0, 143.5), (45.0, 155.0, 305.0, 155.5)]) == [(1, 42.0, 117.0, 308.0, 169.0)]
    assert tables(spark, cells(120.0, 2) + cells(160.0, 3), [(45.0, 145.0, 305.0, 145.5)]) == [(1, 42.0, 117.0, 308.0, 148.5)]
    # the line of another caption ends a body, as does another caption's box
    assert tables(spark, cells(120.0, 2) + cells(144.0, 3, text="Table 2 x")) == [(1, 47.0, 117.0, 303.0, 145.0)]
    other = [(1, "table", "1", 50.0, 100.0, 300.0, 112.0), (2, "figure", "2", 50.0, 146.0, 300.0, 150.0)]
    assert tables(spark, cells(120.0), caps=other) == [(1, 47.0, 117.0, 303.0, 145.0)]


def picture(rows, cols, side=260, gap=40):
    img = np.full((rows * side + (rows + 1) * gap, cols * side + (cols + 1) * gap), 255, np.uint8)
    for r in range(rows):
        for c in range(cols):
            img[gap + r * (side + gap) : gap + r * (side + gap) + side, gap + c * (side + gap) : gap + c * (side + gap) + side] = 10
    return img


def test_panel_cuts():
    assert len(panels.find_panels(picture(1, 3))) == 3
    assert len(panels.find_panels(picture(2, 2))) == 4
    assert panels.find_panels(picture(1, 1)) == []
    assert panels.find_panels(np.full((600, 600), 255, np.uint8)) == []
    assert panels.find_panels(picture(3, 3, gap=12)) == []
    for x0, y0, x1, y1 in panels.find_panels(picture(1, 2)):
        assert 0 <= x0 < x1 <= picture(1, 2).shape[1] and 0 <= y0 < y1 <= picture(1, 2).shape[0]


def png(img):
    raw = b"".join(b"\0" + row.tobytes() for row in img)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_to_panels(spark, tmp_path):
    (tmp_path / "row.png").write_bytes(png(picture(1, 3)))
    (tmp_path / "one.png").write_bytes(png(picture(1, 1)))
    got = {r["name"]: len(r["boxes"]) for r in panels.split_panels(readers.read_images(spark, str(tmp_path))).collect()}
    assert got == {"row.png": 3, "one.png": 0}
    names = {r["name"]: r["bytes"] for r in readers.file_inventory(spark, str(tmp_path), "*.png").collect()}
    assert set(names) == {"row.png", "one.png"} and all(names.values())


def test_index_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"paper_key": "a",\n "meta": {"title": "T"}, "figures": [{"fig_id": "a__p1__fig1", "num": "1"}]}')
    (tmp_path / "b.json").write_text('{"error": "broken", "pdf": "b.pdf"}')
    (tmp_path / "c.json").write_text("{not json")
    papers, figures = readers.read_index(spark, str(tmp_path))
    assert [r["paper_key"] for r in papers.collect()] == ["a"] and figures.first()["fig_id"] == "a__p1__fig1"
    assert {r["paper_key"] for r in readers.read_sidecars(spark, str(tmp_path)).select("paper_key").collect()} == {"a", "b"}


def test_safe_json(spark):
    got = writers.embed_safe_json(spark.createDataFrame([("<a & b>",)], "t string")).first()["json"]
    assert got == '{"t":"\\u003ca \\u0026 b\\u003e"}'


def softmax_fit(x, y, w, k, penalty, steps=8000):
    """Weighted multinomial logistic regression by plain gradient steps; intercepts aren't penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    coef, move = np.zeros((k, x.shape[1])), 0.0
    for _ in range(steps):
        z = x @ coef.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = (w[:, None] * (p - np.eye(k)[y])).T @ x / w.sum()
        grad[:, :-1] += penalty * coef[:, :-1]
        move = 0.9 * move - 0.5 * grad
        coef = coef + move
    return coef


def test_chart_model_equals_plain_fit(spark):
    rng = np.random.default_rng(5)
    y = np.repeat([0, 1, 2], [60, 40, 20])
    x = rng.normal(size=(120, 4)) + 0.8 * np.eye(3, 4)[y]
    rows = spark.createDataFrame([(i, [float(v) for v in a], "abc"[c]) for i, (a, c) in enumerate(zip(x, y))], "vec_id long, embedding array<double>, label string")
    weighted = chartmodel.class_weights(rows)
    assert {r["label"]: round(r["w"], 9) for r in weighted.groupBy("label").agg(F.max("weight").alias("w")).collect()} == {"a": round(120 / 180, 9), "b": 1.0, "c": 2.0}
    model, classes = chartmodel.fit_chart_model(weighted)
    coef = softmax_fit(x, y, np.array([120 / 180, 1.0, 2.0])[y], 3, 1 / (chartmodel.PENALTY * 120))
    z = np.hstack([x, np.ones((120, 1))]) @ coef.T
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    got = {r["vec_id"]: r for r in chartmodel.probabilities(model, classes, rows).collect()}
    assert classes == ["a", "b", "c"] and np.allclose([got[i]["pred_p"] for i in range(120)], p.max(axis=1), atol=0.02)
    assert np.mean([got[i]["pred_label"] == classes[c] for i, c in enumerate(p.argmax(axis=1))]) > 0.98
    for r in chartmodel.predict_charts(model, classes, rows, min_p=0.6).collect():
        full = got[r["vec_id"]]
        assert (r["pred_label"], r["pred_p"]) == ((full["pred_label"], round(full["pred_p"], 3)) if full["pred_p"] >= 0.6 else (None, None))


def test_folds_are_stratified_and_unseen(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(61)], "vec_id long, label string")
    counts = {}
    for r in chartmodel.with_folds(rows, "vec_id", 5).collect():
        counts[r["label"], r["fold"]] = counts.get((r["label"], r["fold"]), 0) + 1
    assert len(counts) == 15 and all(n in (4, 5) for n in counts.values())
    # the label of a row is its own and no other's: a model that hadn't seen the row can't know it
    rng = np.random.default_rng(6)
    noise = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=40)], "ab"[i % 2], 1.0) for i in range(40)], "vec_id long, embedding array<double>, label string, weight double")
    oof = chartmodel.cross_validate(noise, "vec_id").collect()
    assert len(oof) == 40 and np.mean([r["label"] == r["pred_label"] for r in oof]) < 0.85


def test_last_label_of_an_id_counts(spark):
    figs = spark.createDataFrame([("a", None, None, None), ("b", "data", "bar", ["x"])], "fig_id string, v_category string, v_chart_type string, v_tags array<string>")
    got = spark.createDataFrame([("a", "data", "bar", ["u"], 2), ("a", "method", "", ["v"], 9), ("a", "table", "", ["w"], 3)], "fig_id string, category string, chart_type string, tags array<string>, seq int")
    assert [tuple(r) for r in labels.write_back(figs, got).orderBy("fig_id").collect()] == [("a", "method", "", ["v"]), ("b", "data", "bar", ["x"])]
    assert labels.write_back(figs, got.drop("seq")).count() == 2


def test_slim_index_needs_all_columns(spark):
    papers = spark.createDataFrame([("p", None, None)], "paper_key string, authors array<string>, dpi int")
    names = [*build.SLIM_FIELDS, *build.SLIM_EXTRA, *[f"v_{c}" for c in build.SLIM_LABEL]]
    figs = spark.createDataFrame([("p", 2), ("p", 1)], "paper_key string, pos int").select("*", *[F.lit("c" if n in ("fig_id", "v_category") else None).cast("int" if n in build.SLIM_EXTRA else "string").alias(n) for n in names])
    row = build.slim_index(papers, figs).first().asDict(recursive=True)
    assert row["authors"] == [] and row["figures"][0]["extra"] == dict.fromkeys(build.SLIM_EXTRA, 0) | {"dpi": build.OLD_DPI} and len(row["figures"][0]["vision"]) == 5
    assert build.slim_index(papers, figs.limit(0)).first()["figures"] == []
    with pytest.raises(Exception, match="density"):
        build.slim_index(papers, figs.drop("density"))


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_written_pictures_are_read_again(spark, tmp_path, channels):
    data = np.random.default_rng(channels).integers(0, 256, (5, 7, channels), np.uint8).tobytes()
    images = spark.createDataFrame([("a", 5, 7, channels, bytearray(data))], "name string, height int, width int, channels int, data binary")
    for _ in range(2):  # a task may run twice
        writers.write_images(images, str(tmp_path / "p"))
    got = readers.read_images(spark, str(tmp_path / "p")).collect()
    assert [(r["name"], r["height"], r["width"], r["channels"], bytes(r["data"])) for r in got] == [("a.png", 5, 7, channels, data)]


def test_column_scores_equal_the_transformer(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, f"c{i % 3}", (rng.normal(size=4) + np.eye(4)[i % 3]).tolist()) for i in range(90)], "vec_id long, label string, embedding array<double>")
    model, classes = chartmodel.fit_chart_model(chartmodel.class_weights(rows))
    theirs = {r["vec_id"]: r for r in chartmodel.probabilities(model, classes, rows).collect()}
    for r in chartmodel.score_columns(rows, *chartmodel.linear_model(model, classes)).collect():
        assert r["pred_label"] == theirs[r["vec_id"]]["pred_label"] and r["pred_p"] == pytest.approx(theirs[r["vec_id"]]["pred_p"])
    assert all(r["gradient"] < 1e-5 for r in chartmodel.optimality(model, classes, chartmodel.class_weights(rows)).collect())


def test_folds_of_a_class_over_many_partitions(spark):
    rows = spark.createDataFrame([(i, "big" if i % 10 else None if i % 20 else "small") for i in range(500)], "vec_id long, label string")
    got = collections.Counter((r["label"], r["fold"]) for r in chartmodel.with_folds(rows, "vec_id", 5).collect())
    assert got == {("big", f): 90 for f in range(5)} | {(c, f): 5 for c in (None, "small") for f in range(5)}
