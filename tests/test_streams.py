"""Streams: restarts, late and repeated rows, killed batches, merged levels."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vignetta.streaming import levels, visits

START = datetime(2024, 1, 1)
VISIT = "event_id long, user_id long, ts timestamp, cookie string"


def add_files(spark, path, rows, n=1):
    spark.createDataFrame([(i, u, START + timedelta(days=d), "") for i, u, d in rows], VISIT).repartition(n).write.mode("append").parquet(path)


def test_first_visits_survive_restarts_and_late_rows(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: visits.run_first_visits(visits.watch(spark, source, VISIT), table, state).awaitTermination()
    rng = random.Random(1)
    rows = [(i, rng.randrange(30), rng.uniform(0, 300)) for i in range(400)]
    seen = []
    for lo in range(0, 400, 50):  # eight runs, each from the checkpoint of the one before
        seen += rows[lo : lo + 50]
        add_files(spark, source, rows[lo : lo + 50] + rng.sample(seen, 10), 3)
        run()
        want = {}
        for i, u, d in seen:
            want[u] = min(want.get(u, (1e9, 0)), (d, i))
        assert {(r["user_id"], r["event_id"]) for r in levels.newest(spark, table, "user_id").collect()} == {(u, i) for u, (_, i) in want.items()}
    assert len(levels.folders(spark, table)) < 8
    add_files(spark, source, [(1000, 5, -900.0)])  # years late
    run()
    assert levels.newest(spark, table, "user_id").filter("user_id = 5").first()["event_id"] == 1000


def test_new_browsers_come_once_and_late_rows_are_dropped(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: visits.run_new_browsers(visits.watch(spark, source, VISIT), out, state).awaitTermination()
    found = lambda: sorted((r["user_id"], r["event_id"]) for r in spark.read.parquet(out).collect())
    add_files(spark, source, [(1, 1, 0), (2, 2, 1)])
    run()
    add_files(spark, source, [(3, 1, 100), (2, 2, 1), (4, 3, 101)])
    run()
    assert found() == [(1, 1), (2, 2), (3, 4)]
    add_files(spark, source, [(5, 4, 800)])  # the watermark moves on, both cookies have ended
    run()
    add_files(spark, source, [(6, 1, 700), (7, 5, 10)])  # back after more than a year; too late to be judged
    run()
    assert found() == [(1, 1), (1, 6), (2, 2), (3, 4), (4, 5)]


def figure(pos, page=1, name=None):
    return (pos, name or f"f{pos}", page, str(pos), None, None, None, None, None, None)


def extracted(key, seq, figures, mtime=1.0, version=5, dpi=300, error=None):
    return (key, seq, visits.EXTRACTED, mtime, version, dpi, error, figures, None)


def labelled(key, seq, labels):
    return (key, seq, visits.LABELLED, None, None, None, None, None, [(f, c, "", ["t"]) for f, c in labels])


WAVES = [
    [extracted("p", 1, [figure(1), figure(2)], version=4), extracted("q", 1, [figure(3)]), extracted("r", 1, [], error="broken")],
    [labelled("p", 2, [("f1", "data"), ("f1", "method"), ("f9", "data")]), labelled("q", 3, [("f3", "table")]), labelled("r", 3, [("f5", "table")])],
    [extracted("q", 4, [figure(3, page=7)]), extracted("p", 4, [figure(1), figure(2, page=3, name="f2x")]), extracted("r", 4, [figure(5)])],
    [labelled("p", 5, [("f2x", "example"), ("f2", "data")]), labelled("p", 6, [("f2x", "other")])],
    [extracted("p", 7, [], error="gone", mtime=9.0)],
]
#: (paper, figure, page, category) after each wave; q's second extraction is of the same file, so it isn't needed.
AFTER = [
    {("p", "f1", 1, None), ("p", "f2", 1, None), ("q", "f3", 1, None)},
    {("p", "f1", 1, "method"), ("p", "f2", 1, None), ("q", "f3", 1, "table")},
    {("p", "f1", 1, "method"), ("p", "f2x", 3, None), ("q", "f3", 1, "table"), ("r", "f5", 1, None)},
    {("p", "f1", 1, "method"), ("p", "f2x", 3, "other"), ("q", "f3", 1, "table"), ("r", "f5", 1, None)},
    {("q", "f3", 1, "table"), ("r", "f5", 1, None)},
]


def figures_of(spark, table):
    return {(r["paper_key"], r["fig_id"], r["page"], r["v_category"]) for r in visits.index_figures(levels.newest(spark, table, "paper_key")).collect()}


@pytest.mark.parametrize("kill", [None, "before", "after"])
def test_index_is_kept_through_waves_and_killed_batches(spark, tmp_path, monkeypatch, kill):
    source, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: visits.maintain_index(visits.watch(spark, source, visits.EVENT_SCHEMA), table, state).awaitTermination()
    put = levels.put
    for wave, want in zip(WAVES, AFTER):
        spark.createDataFrame(wave, visits.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if kill:

            def dying(*args, **kw):
                if kill == "after":
                    put(*args, **kw)
                raise RuntimeError("killed")

            monkeypatch.setattr(levels, "put", dying)
            with pytest.raises(Exception, match="killed"):
                run()
            monkeypatch.setattr(levels, "put", put)
        run()
        assert figures_of(spark, table) == want
    assert len(levels.folders(spark, table)) <= 2  # four of the five batches have been merged


def test_waves_in_one_batch(spark):
    events = spark.createDataFrame(WAVES[0] + WAVES[1], visits.EVENT_SCHEMA)
    none = spark.createDataFrame([], visits._RECORD)
    got = visits.index_figures(visits.merged_records(events, none))
    # labels from after the extraction go to its figures
    assert {(r["paper_key"], r["fig_id"], r["page"], r["v_category"]) for r in got.collect()} == {("p", "f1", 1, "method"), ("p", "f2", 1, None), ("q", "f3", 1, "table")}
    assert visits.merged_records(events.limit(0), none).count() == 0


def test_levels_keep_the_newest_and_pass_over_unfinished_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda n: spark.createDataFrame([(k, n) for k in range(n % 3 + 1)], "k long, v long")
    want = {}
    for n in range(23):
        levels.put(row(n), path, n, "k")
        levels.put(row(n + 1), path, n, "k")  # the same batch again
        want |= {k: n for k in range(n % 3 + 1)}
        assert {r["k"]: r["v"] for r in levels.newest(spark, path, "k").collect()} == want
    assert len(levels.folders(spark, path)) <= 3 * levels.FANOUT
    row(99).write.parquet(f"{path}/level=3/batch=99")
    (tmp_path / "t/level=3/batch=99/_SUCCESS").unlink()
    assert {r["k"]: r["v"] for r in levels.newest(spark, path, "k").collect()} == want


def test_levels_in_buckets_are_the_same_known_or_not(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda n: spark.createDataFrame([(f"k{k}", n) for k in range(n % 3 + 1)], "k string, v long").repartition(3, "k")
    found = lambda df: {r["k"]: r["v"] for r in df.collect()}
    asked = spark.createDataFrame([("k0",), ("k2",), ("none",)], "k string")
    want = {}
    for n in range(11):
        row(50 + n).limit(2).write.parquet(f"{path}/level=0/batch={n}")  # a write that was killed
        (tmp_path / f"t/level=0/batch={n}/_SUCCESS").unlink()
        levels.put(row(n), path, n, "k", buckets=3)
        levels.put(row(n + 1), path, n, "k", buckets=3)  # the same batch again
        want |= {f"k{k}": n for k in range(n % 3 + 1)}
        if n % 4 == 1:  # as in another application
            spark.sql(f"DROP TABLE {levels._table(path, 0, n)}")
        assert found(levels.newest(spark, path, "k")) == want
        got = levels.with_newest(asked, path, "k", "at", row(0).select("v").schema)
        assert {r["k"]: r["at"] and r["at"]["v"] for r in got.collect()} == {k: want.get(k) for k in ("k0", "k2", "none")}
    assert len(levels.folders(spark, path)) <= 2 * levels.FANOUT
