"""What keeps the queries' work in proportion to their tables."""

import random

from pyspark.sql import functions as F

from vignetta.functions import columns as C
from vignetta.functions import lookups as L
from vignetta.operators import build, candidates, chartmodel, labels, layout, panels
from vignetta.plans import q_build, q_labels, q_layout, q_rest, registry
from vignetta.streaming import levels, visits

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(spark, df):
    """How many tasks of a shuffled join get rows."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        return df().select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# F2


def test_chart_hints_are_in_every_match(spark):
    texts = [w for _, p in L.CHART_WORDS for w in p.replace("?", "").replace("\\b", "").replace("(", "|").replace(")", "|").split("|")]
    texts += ["heat map", "attention weights matrix", "attention weight visuali", "pca plot", "pca visuali", "t-sne", "tsne", "point range plot", "dot plot", "level set", "cdf", "xcdf", "bar graph", "a", ""]
    texts += ["radar plot", "spider chart", "pie chart", "donut chart", "line graph", "learning curve", "roc curves", "cumulative distribution", "scatterplot", "pareto front", "area chart", "boxplot", "box-and-whisker"]
    out = None
    for name, words in L.CHART_WORDS:
        out = F.when(F.col("t").rlike(words), name) if out is None else out.when(F.col("t").rlike(words), name)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", out.alias("want"), C.chart_in(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def test_labels_are_made_once(spark):
    made = plan(registry.queries()["m6_class_weights"](spark, SF))
    assert "confusion matri" not in made and "lineitem" not in made


def test_class_weights_count_rows_once(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_returnflag").alias("label"))
    weighted = chartmodel.class_weights(rows)
    assert plan(weighted).count("FileScan") == 2
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert all(abs(r["weight"] - sum(sizes.values()) / len(sizes) / sizes[r["label"]]) < 1e-12 for r in weighted.distinct().collect())


# F3


def test_replies_are_parsed_once(spark):
    assert "from_json" not in plan(registry.queries()["c5_write_back"](spark, SF))


# F4, F5


def test_pictures_are_drawn_by_several_tasks(spark):
    assert q_rest.pictures(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 1


# F7, F8


def test_rows_without_a_parent_are_dealt_out(spark):
    n = F.col("id").cast("string")
    null = F.lit(None).cast("string")
    figs = spark.range(200).select(n.alias("fig_id"), null.alias("parent"), null.alias("v_category"), null.alias("v_chart_type"), null.alias("v2_category"))
    over = spark.createDataFrame([("3", "data", "bar")], "fig_id string, category string, chart_type string")
    assert dealt(spark, lambda: labels.apply_overrides(figs, over)) > 1
    counts = spark.createDataFrame([("3", 2)], "fig_id string, n_new int")
    assert dealt(spark, lambda: panels.drop_stale_panels(figs, counts)) > 1


# F10


def test_word_patterns_by_letter_find_the_same(spark):
    words = "result results accuracy comparing compares vs vs. f1 trade-off tradeoff trajectories trajectory x-axis log scale per-item win rate Overview block diagram flowchart structure of case study case studies prompts system messages instruction template samples sample xresult ratee _loss LOSS"
    texts = [w for w in words.split(" ")] + ["log scale", "win rate", "block diagram", "structure of it", "case studies", "system messages", "instruction templates", "as a function of x", "", "a per- b", "time step", "İrate", "ſcores"]
    for p in (L.RESULT_WORDS, L.METHOD_WORDS, L.EXAMPLE_WORDS, L.PROMPT_WORDS):
        df = spark.createDataFrame([(f"{a}{t}{b}",) for t in texts for a in ("", "an ", "-", "é") for b in ("", "s", ".", " x")], "t string")
        assert C.by_letter(p) != p and df.filter(F.col("t").rlike(p) != F.col("t").rlike(C.by_letter(p))).count() == 0


# F11


def test_carry_labels_stores_what_it_needs(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(q_layout, "saved", lambda df, name: kept.append(df.columns) or df)
    q_layout.e21(spark, SF)
    assert len(kept) == 1 and not {"kind", "pred_label", "n_drawings"} & set(kept[0])


# F12, F13, F16


def test_elements_are_stored_once(spark, monkeypatch):
    asked, real = [], q_layout.view
    monkeypatch.setattr(q_layout, "view", lambda s, sf, name: asked.append(name) or real(s, sf, name))
    for name, query in (("e10", q_layout.e10), ("e13", q_layout.e13), ("e15", q_layout.e15)):
        asked.clear()
        query(spark, SF)
        assert [a for a in asked if a != "fx_words"] == ["fx_elements"], name


# F17


def test_catalog_is_met_last(spark):
    side = spark.createDataFrame([("a", "A long title", ["x"], 1, "", "2020"), ("b", "B", [], 2, "2021", "2020"), ("c", "C", [], 3, "", "2020")], "paper_key string, title string, authors array<string>, citations bigint, year_hint string, s2_year string")
    need = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "")], "paper_key string, arxiv_id string")
    cat = spark.createDataFrame([(1, "1", "One title", 7, 2024, "V", ["p", ""]), (2, "1", "Two title", None, None, None, ["q"]), (3, "", "None", 1, 1, "W", ["r"])], "cand_id bigint, arxiv string, title string, citations bigint, year int, venue string, authors array<string>")
    hits = candidates.enrich_by_arxiv(need, cat).join(cat.select("cand_id", F.col("authors").alias("cat_authors")), "cand_id").select("paper_key", "cat_title", "cat_citations", "cat_year", "cat_venue", "cat_authors")
    want = candidates.apply_enrichment(side, hits)
    got = candidates.apply_by_arxiv(side, need, cat)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5


# F18


def test_originals_are_counted_in_one_pass(spark):
    rows = [("p", "f1", None), ("p", "f2_s1", "f2"), ("p", "f2_s2", "f2"), ("p", "f1_s1", "f1"), (None, "g", None), (None, "g_s1", "g"), ("q", "f2", "f9"), ("q", None, None), ("q", "z", "f2")]
    figs = spark.createDataFrame(rows, "paper_key string, fig_id string, parent string")
    # whole: f1, g and the one without id; composites: f2 of p, g of the null paper, f9 of q
    assert build.n_originals(figs).collect()[0][0] == 6 and build.n_originals(figs.limit(0)).collect()[0][0] == 0
    on_file = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_orderkey").alias("paper_key"), F.col("l_returnflag").alias("fig_id"), F.col("l_linestatus").alias("parent"))
    assert plan(build.n_originals(on_file)).count("FileScan") == 1


# F1


def test_waves_of_events_read_the_figures_once(spark, monkeypatch):
    asked, real = [], q_rest.view
    monkeypatch.setattr(q_rest, "view", lambda s, sf, name: asked.append(name) or real(s, sf, name))
    waves = q_rest.record_events(spark, SF)
    assert asked.count("fx_figures") == 1 and len(waves) == 3 and all("lineitem" not in plan(w) for w in waves)


# F15


def test_index_records_are_written_compressed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(q_rest, "shared_path", lambda s, name: str(tmp_path / name))
    q_rest.s2(spark, SF)
    names = [p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)


# F14


def test_figures_move_before_paths_are_made(spark):
    lines = plan(registry.queries()["b18_slim_index"](spark, SF)).splitlines()
    moved = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(paper_key" in line and "REPARTITION_BY_COL" in line]
    made = [i for i, line in enumerate(lines) if "figs/" in line]
    assert moved and made and max(made) < max(moved)


# F9


def test_only_figures_of_papers_that_stay_are_stored(spark, monkeypatch):
    stored, real = {}, build.saved
    monkeypatch.setattr(build, "saved", lambda df, name: stored.setdefault(name, (plan(df), real(df, name)))[1])
    papers, _ = q_build._index(spark, SF)
    n = papers.count()
    assert n < spark.read.parquet(f"{SF}/orders.parquet").count() / 5
    assert all(df.select("paper_key").distinct().count() == n for _, df in stored.values())
    assert "(?i)" not in stored["gallery-chosen"][0] and "marr prize" not in stored["gallery-chosen"][0]


def gallery_rows(spark):
    """Odd papers, sidecars and figures: keys twice and missing, blank titles, broken papers, panels, hashes twice and missing."""
    papers = spark.createDataFrame(
        [("a", "One", "", "CVPR", "2020", None, 300), ("a", "Two", "", "ICML", "2021", None, 300), ("b", "one!", None, None, None, None, None), ("c", "ONE", "2101.00001", "", "", None, 170), ("d", "x", "", "", "", "broken", 1),
         (None, "One", "", "", "", None, 1), ("e", "!!!", "", "", "", None, 1), ("f", None, "", "", "", None, 1), ("g", "two", "", "", "", None, 1), ("h", "None of it", "", "", "", None, 1)],
        "paper_key string, pdf_title string, pdf_arxiv_id string, pdf_venue string, pdf_year string, error string, dpi int",
    )
    side = spark.createDataFrame(
        [("b", "", "2020-01-01", "nips", "", "2019", "Best paper", "u", ["A"], 3), ("c", None, None, None, None, None, None, None, None, None), ("g", "Two", "", "", "", "", "", "u", [], 1), ("g", "Three", "", "", "", "", "Oral", "u", [], 2),
         (None, "One", "", "", "", "", "", "", [], 0), ("z", "One", "", "", "", "", "", "", [], 0)],
        "paper_key string, title string, published string, venue_hint string, year_hint string, s2_year string, note string, url string, authors array<string>, citations long",
    )
    rows = []
    for paper, hashes in (("a", ["m", "m", None, "n"]), ("b", [None, None, "m"]), ("c", ["m", "m", "m"]), ("d", ["m"]), (None, ["m", None]), ("e", [None]), ("f", ["q", "q"]), ("g", ["m", "o", "p"])):
        rows += [(paper, i, 1 + i, str(i), f"{paper}_f{i}", "Accuracy of it", i % 2 == 0, i, None, None, None, None, None, h, 10, 10, 99, "result", "x:method" if i == 1 else "bar", None, [] if i else None) for i, h in enumerate(hashes)]
        rows += [(paper, 9, 1, "9", f"{paper}_f9", "Split", True, 1, "data", "other", None, None, ["x"], "s", 10, 10, 99, "result", None, None, [f"{paper}_f9_s1", f"{paper}_f9_s2"])]
        rows += [(paper, 9, 1, "9", f"{paper}_f9_s{k}", f"Split [子图 {k}/2]", True, 1, None, None, "data", None, None, None, 10, 10, 99, "result", "line", f"{paper}_f9", None) for k in (1, 2)]
    figs = spark.createDataFrame(
        rows, "paper_key string, pos int, page int, num string, fig_id string, caption string, has_raster boolean, n_drawings int, v_category string, v_chart_type string, v2_category string, v2_chart_type string, "
        "v_tags array<string>, thumb_md5 string, tw int, th int, thumb_bytes long, kind string, pred_label string, parent string, panels array<string>",
    )
    files = spark.createDataFrame([("a_f0", True, "png"), ("b_f0", False, "png"), ("b_f0", False, "webp")], "fig_id string, is_thumb boolean, ext string")
    return papers, side, figs, files


def whole_index(papers, sidecars, figures, files):
    """load_index step by step over all rows."""
    meta = build.resolve_meta(papers, sidecars)
    figs = build.dedupe_images(build.hide_composites(figures.join(meta.select("paper_key"), "paper_key", "left_semi")))
    meta = meta.join(figs.groupBy("paper_key").agg(F.count("*").alias("n_figs")), "paper_key")
    kept = meta.join(build.fold_by_title(meta).select("paper_key"), "paper_key", "left_semi")
    figs = figs.join(kept.select("paper_key"), "paper_key", "left_semi")
    return kept, build.asset_urls(build.chart_guess(build.rewrite_panel_captions(build.reconcile_kind(build.overlay_second_opinion(figs)))), files)


def test_index_of_chosen_papers_is_the_whole_index(spark):
    tables = papers, side, figs, files = gallery_rows(spark)
    text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).collect())
    want = [text(df) for df in whole_index(*tables)]
    assert [text(df) for df in build.load_index(*tables)] == want and all(want)
    some = lambda keys: figs.join(keys, "paper_key", "left_semi")
    assert [text(df) for df in build.load_index(*tables, figures_of=some)] == want
    assert [df.count() for df in build.load_index(papers, side, figs.limit(0), files)] == [0, 0]


def test_pictures_are_counted_as_they_are_deduplicated(spark):
    _, _, figs, _ = gallery_rows(spark)
    got = {r["paper_key"]: r["n_figs"] for r in build.count_images(figs).collect()}
    assert got == {r["paper_key"]: r["count"] for r in build.dedupe_images(figs).groupBy("paper_key").count().collect()}


def test_figures_of_some_papers_are_as_among_all(spark):
    keys = spark.createDataFrame([("o1",), ("o7",), ("none",)], "paper_key string")
    rows = lambda df: sorted(map(str, df.collect()))
    all_ = q_build.figures(spark, SF)
    some = rows(q_build.figures(spark, SF, keys))
    assert some and some == rows(all_.join(keys, "paper_key", "left_semi"))


# F1 of round 4


def joined_records(events, current, version=5, dpi=300):
    """merged_records by the operators over rows of figures, joined and gathered again."""
    newest = F.max_by(F.struct("seq", "mtime", "extractor_version", "dpi", "error", "figures"), "seq").alias("e")
    arrived = events.filter(F.col("kind") == visits.EXTRACTED).groupBy("paper_key").agg(newest).select("paper_key", "e.*")
    todo = layout.extract_plan(arrived.withColumnsRenamed({"dpi": "e_dpi", "extractor_version": "e_version", "error": "e_error"}), current, version, dpi)
    said = events.filter(F.col("kind") == visits.LABELLED).select("paper_key", "seq", F.inline("labels"))
    when = said.join(todo.select("paper_key", F.col("seq").alias("_at")), "paper_key", "left")
    old = labels.write_back(visits.index_figures(current), when.filter("_at IS NULL OR seq < _at").drop("_at", "paper_key"))
    found = todo.filter("e_error IS NULL").select("paper_key", F.inline("figures"))
    carried = layout.carry_labels(old.join(todo, "paper_key", "left_semi").select(*found.columns), found)
    fresh = labels.write_back(carried, when.filter("seq > _at").drop("_at", "paper_key"))
    kept = old.join(todo, "paper_key", "left_anti")
    nested = fresh.select(*found.columns).unionByName(kept.select(*found.columns)).groupBy("paper_key").agg(F.sort_array(F.collect_list(F.struct(*found.columns[1:]))).alias("figures"))
    heads = todo.select("paper_key", F.col("mtime").alias("pdf_mtime"), F.col("e_version").alias("extractor_version"), F.col("e_dpi").alias("dpi"), F.col("e_error").alias("error"))
    stay = current.join(todo, "paper_key", "left_anti").join(said, "paper_key", "left_semi").drop("figures")
    out = heads.unionByName(stay).join(nested, "paper_key", "left")
    return out.select(*heads.columns, F.coalesce("figures", F.array().cast(f"array<{visits._FIGURE}>")).alias("figures"))


def record_rows(spark, rng, papers=60):
    """Odd records and events: figures without id, page or number, twice, with panels; labels twice, without seq, of unknown figures; papers twice, broken, unknown."""
    some = lambda *xs: rng.choice(xs)

    def figures(p, seen):
        out = []
        for i in range(rng.randrange(6)):
            name = some(None, f"{p}f{i}", f"{p}f{i}", f"{p}f{i}x")
            panels = [f"{name}_s1", f"{name}_s2"] if name and seen and rng.random() < 0.4 else None
            out.append((i, name, some(None, 1, 1, 2), some(None, "1", "1", "2"), some(None, "data", "method"), some(None, "bar"), some(None, ["a"]), some(None, "table"), None, panels))
            out += [(i, s, out[-1][2], out[-1][3], some(None, "data"), None, None, None, name, None) for s in panels or []]
        return out

    current = [(f"p{i}", float(some(1, 9)), some(4, 5, 5), 300, some(None, None, "broken"), figures(f"p{i}", True)) for i in range(papers) if i % 4]
    events = []
    for i in range(papers):
        p, seqs = f"p{i}", rng.sample(range(1, 50), 8)
        for s in seqs[: rng.randrange(3)]:
            events.append((p, s, visits.EXTRACTED, float(some(1, 9)), 5, 300, some(None, None, None, "gone"), some(None, figures(p, False), figures(p, False)), None))
        for s in seqs[3 : 3 + rng.randrange(4)]:
            said = [(f"{p}f{rng.randrange(7)}{some('', '', 'x', '_s1', '_s2')}", some("data", "other", None), some("", "bar", None), some(["t"], None)) for _ in range(rng.randrange(4))]
            events.append((p, some(s, s, s, None), visits.LABELLED, None, None, None, None, None, some(said, said, said + said[:1])))
    return spark.createDataFrame(events, visits.EVENT_SCHEMA), spark.createDataFrame(current, visits._RECORD)


def test_records_are_merged_as_by_rows(spark):
    text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct("*"))).collect())
    for seed in range(3):
        events, current = (df.localCheckpoint() for df in record_rows(spark, random.Random(seed)))
        # of figures on one page and number the last counts: without equal places there is one
        assert text(visits.merged_records(events, current)) == text(joined_records(events, current))


def test_a_batch_moves_once_and_meets_its_records_where_they_lie(spark, monkeypatch, tmp_path):
    plans, put = [], levels.put
    monkeypatch.setattr(levels, "put", lambda rows, *args, **kw: plans.append(plan(rows)) or put(rows, *args, **kw))
    monkeypatch.setattr(q_rest, "shared_path", lambda s, name: str(tmp_path / name))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        made = plan(registry.queries()["v4_maintain_index"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [p.count("Exchange ") for p in plans] == [1, 1, 1] and "Exchange " not in made
    # figures and events are gone once they have been gathered or merged
    assert {p.name for p in tmp_path.iterdir()} == {"index", "index-state"}


def test_a_paper_of_many_figures_is_merged_in_place(spark):
    n = 20_000
    fig = lambda x: F.struct(x.alias("pos"), F.concat(F.lit("f"), x).alias("fig_id"), x.alias("page"), x.cast("string").alias("num"), *[F.lit(None).alias(c) for c in ("v_category", "v_chart_type", "v_tags", "v2_category", "parent", "panels")])
    label = lambda x: F.struct(F.concat(F.lit("f"), x).alias("fig_id"), F.lit("data").alias("category"), F.lit("").alias("chart_type"), F.lit(None).cast("array<string>").alias("tags"))
    ids = F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))
    figs = F.transform(ids, fig).cast(f"array<{visits._FIGURE}>")
    one = spark.range(1)
    current = one.select(F.lit("p").alias("paper_key"), F.lit(1.0).alias("pdf_mtime"), F.lit(4).alias("extractor_version"), F.lit(300).alias("dpi"), F.lit(None).cast("string").alias("error"), figs.alias("figures"))
    said = one.select(F.lit("p").alias("paper_key"), F.lit(1).alias("seq"), F.lit(visits.LABELLED).alias("kind"), F.transform(F.filter(ids, lambda x: x % 2 == 0), label).alias("labels"))
    again = one.select(F.lit("p").alias("paper_key"), F.lit(2).alias("seq"), F.lit(visits.EXTRACTED).alias("kind"), F.lit(2.0).alias("mtime"), F.lit(5).alias("extractor_version"), F.lit(300).alias("dpi"), figs.alias("figures"))
    events = visits.as_events(said.unionByName(again, allowMissingColumns=True))
    got = visits.index_figures(visits.merged_records(events, current))
    assert got.agg(F.count("*"), F.count_if(F.col("v_category") == "data"), F.count_if((F.col("v_category") == "data") & (F.col("pos") % 2 == 0))).first() == (n, n // 2, n // 2)


def test_records_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(q_rest, "shared_path", lambda s, name: str(tmp_path / name))
    monkeypatch.setattr(q_rest, "PAPERS_A_TASK", 150)
    n = -(-spark.read.parquet(f"{SF}/orders.parquet").count() // 150)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    registry.queries()["v4_maintain_index"](spark, SF)
    assert len(list((tmp_path / "index/level=0/batch=0").glob("*.parquet"))) == n
