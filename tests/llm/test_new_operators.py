"""Spelling variants, conversation repair and the vector join against brute force, and on nulls, ties, repeats, long texts, empty tables and clashing columns."""

import collections
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vignetta.llm import queries, spelling, turn_repair, vector_join

SF = "/root/testdata/sf0.001"

# op11


def plain_words(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, near=None):
    near = near or {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in form.items() if words[v] >= 2 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def test_spelling_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    words = plain_words(rows)
    by_cut = collections.defaultdict(set)
    for w in words:
        for cut in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_cut[cut].add(w)
    near = {w: [] for w in words}
    for a, b in {tuple(sorted(p)) for group in by_cut.values() for p in itertools.combinations(group, 2)}:
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    got = queries.queries()["op11_spelling_variants"](spark, SF).collect()
    assert len(got) == len(words) and {tuple(r) for r in got} == plain_variants(words, near)


@pytest.mark.parametrize("words_a_part", [3, 1000])
def test_spelling_variants_equal_brute_force(spark, monkeypatch, words_a_part):
    monkeypatch.setattr(spelling, "WORDS_A_PART", words_a_part)
    rng = random.Random(5)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 6))): rng.randint(1, 40) for _ in range(150)} | {"aaab" * 3000: 9, "aaab" * 3000 + "b": 3, "x": 7}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n int")).collect()
    assert len(got) == len(words) and {tuple(r) for r in got} == plain_variants(words)


def test_spelling_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "Étude étude étudE " * 2), (3, "abcde ABCDE abcde abcdef"), (3, "abcde ABCDE abcde abcdef"), (4, "abcdef" * 50_000 + " ") , (5, "1 2 _ ß-x÷y ")]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    assert {tuple(r) for r in spelling.variants(spelling.word_counts(df)).collect()} == plain_variants(plain_words(rows))
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0


def test_spelling_ties_go_to_the_smaller_word(spark):
    got = {r["word"]: r["form"] for r in spelling.variants(spark.createDataFrame([("abcd", 2), ("abce", 9), ("abcé", 9)], "word string, n int")).collect()}
    assert got == {"abcd": "abce", "abce": None, "abcé": None}


# op12


def damaged(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest())) for c, r in out.items()}


def plain_repair(turns):
    """Everything the query returns for a conversation; the cheapest edits by Dijkstra over (cost, audit)."""
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    faults, seen = [], set()
    for _, role, text in turns:
        bare = text.strip(space)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ".")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = "" if not roles else roles[-1]
        if i == len(turns) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}
        heapq.heappush(heap, (cost + 2, audit + "I", i, roles + after, (*lines, f"{name[after]}:")))
        if i < len(turns):
            _, role, text = turns[i]
            more = faults[i] == "t"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, lines))
            if faults[i] in "t.":
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + after, (*lines, f"{name[after]}:{text}")))
                if role[:1] == after or (role[:1] == "s" and not roles):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair_query_equals_brute_force(spark):
    want = {c: plain_repair(t) for c, t in damaged(spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()).items()}
    got = queries.queries()["op12_conversation_repair"](spark, SF).collect()
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want


def some_turns(seed, n, conversations):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "u"]
    texts = ["a.", "b!", "c", "", " \n", None, "d?  ", "e", "f.", "g. ", "h.", "i."]
    return [(rng.choice(conversations), rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for _ in range(n)]


@pytest.mark.parametrize("segment", [2, 1024])
def test_repair_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    rows = some_turns(segment, 500, [None, *range(40)])
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string").repartition(7)
    want = {c: plain_repair(t) for c, t in damaged(rows).items()}
    got = turn_repair.report(df, turn_repair.damage(df)).collect()
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want


def test_long_conversation_is_cut_in_segments(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"{i}." if i % 5 else f"{i}") for i in range(6000)] + [(2, 1, "user", "x" * 500_000 + "."), (3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string").repartition(3)
    want = {c: plain_repair(t) for c, t in damaged(rows).items()}
    assert {r[0]: tuple(r)[1:] for r in turn_repair.report(df, turn_repair.damage(df)).collect()} == want
    assert turn_repair.report(df.limit(0), df.limit(0)).count() == 0


def test_repaired_turns_are_what_the_plan_says(spark):
    df = spark.createDataFrame([("c", 1, "assistant", "hi."), ("c", 2, "user", "ok"), ("c", 3, "user", "ok")], "conv_id string, turn long, role string, text string")
    rows = turn_repair.repair(df)[2].orderBy("place").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in rows if r["edit"] != "D"] in ([("R", "user", "hi."), ("R", "assistant", "ok")], [("I", "user", ""), ("K", "assistant", "hi.")])
    assert sum(r["edit"] == "D" for r in rows) >= 1


@pytest.mark.parametrize("n", [1, 3, 9, 40])
def test_segment_costs_join_to_the_whole(n):
    rng = random.Random(n)
    for _ in range(20):
        signs = "".join(rng.choice("sua-") + rng.choice("bdt...") for _ in range(n))
        cut = 2 * rng.randint(0, n)
        tables = [turn_repair.costs_through(s) for s in (signs[:cut], signs[cut:] + "E.") if s]
        ahead = turn_repair.exit_costs(tables)
        assert min(tables[0][0][s] + ahead[0][s] for s in range(4)) == turn_repair.repair_signs(signs)[0]


# op13


def plain_links(rows, min_cosine=0.98):
    ok = lambda v, label: label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    rows = list(rows)
    links = collections.defaultdict(set)
    for (i, (_, v, k)), (j, (_, w, m)) in itertools.combinations(enumerate(rows), 2):
        if ok(v, k) and ok(w, m) and k == m and len(v) == len(w):
            x, y = np.array(v, np.float64), np.array(w, np.float64)
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= min_cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(links[i]), component, vec_id == component))
    return sorted(out, key=str)


def test_vector_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.queries()["op13_vector_join"](spark, SF).collect()), key=str) == plain_links(rows)


@pytest.mark.parametrize("cell, dims", [(16, 2), (16, 3), (32, 20), (2048, 3)])
def test_vector_cells_and_blocks_equal_brute_force(spark, monkeypatch, cell, dims):
    monkeypatch.setattr(vector_join, "CELL", cell)
    rng = np.random.default_rng(dims)
    points = rng.normal(size=(260, dims))
    points[:60] = points[0] + rng.normal(size=(60, dims)) * 0.05  # a crowd
    points[100:110] = points[99]  # copies
    points[110] = points[99] * 7
    rows = [(int(i), p.tolist(), int(i % 5 == 0)) for i, p in enumerate(points)]
    df = spark.createDataFrame([(*r, 3, "c") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, cell string")
    assert sorted(map(tuple, vector_join.near_vectors(df).collect()), key=str) == plain_links(rows)


def test_cells_are_parted_where_that_helps(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "CELL", 64)
    angles = np.random.default_rng(1).uniform(0, 2 * math.pi, 2000)
    vectors = spark.createDataFrame([("c", i, 1, np.array([math.cos(a), math.sin(a)]).tobytes()) for i, a in enumerate(angles)], "cell string, node long, many long, unit binary")
    got = vector_join.cells(vectors, 0.005)  # far less than the width of a cell
    assert got.select("cell").distinct().count() > 30 and got.agg(F.max("chunks")).first()[0] == 1 and got.count() < 2 * 2000


def test_vector_edge_cases(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [math.nan, 1.0], 1), (6, [math.inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (None, [0.0, -3.0], 1), (9, [1e300, 1e298], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, -0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r[0], r[1], r[2], r[3]) for r in vector_join.near_vectors(df).collect()}
    assert got == {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10)} | {(8, 4, 8, True), (None, 4, 8, False), (None, 0, None, True), (9, 4, 8, False), (11, 4, 8, False)}
    assert vector_join.near_vectors(df.limit(0)).count() == 0


# earlier operators: what they used to miss


def phrase_text(rng, n=2200):
    """Half a repeated phrase, half words of its own."""
    own = [f"w{rng.randrange(10**6)}" for _ in range(n // 2)]
    return " ".join(["one two three four five six seven"] * (n // 14) + own)


def test_equal_fingerprints_of_different_texts_stay_apart(spark):
    from vignetta.llm import near_texts

    rng = random.Random(2)
    texts = [phrase_text(rng) for _ in range(60)]
    twin = texts[0].split()
    twin[-50] = "changed"
    assert len({tuple(near_texts.simhash(t.encode(), 2)) for t in texts}) < 60  # boilerplate alone decides
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(twin)])), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_texts.drop_near(docs).collect()) == list(range(60))


def test_clusters_in_a_bucket_over_the_block_size(spark):
    from vignetta.llm import near_texts

    rng = random.Random(4)
    phrase = ["one two three four five six seven"] * 40
    texts, want = [], []
    for k in range(450):  # families of three that all share one phrase, so that they crowd the same buckets
        own = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for copy in range(3):
            words = list(own)
            words[rng.randrange(120)] = f"x{copy}"
            texts.append(" ".join(phrase + words))
            want.append(3 * k)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["best"]["doc_id"] for r in near_texts.near_groups(docs).collect()}
    assert all(want[got[i]] == want[i] for i in got)  # no family is mixed with another
    assert np.mean([got[i] == want[i] for i in got]) >= 0.9


def test_stages_keep_columns_of_any_name(spark):
    from vignetta.llm import exact_dedup, near_texts

    rows = [(1, "a b c d e f", 5, "k", 2, "n"), (2, "a b c d e f", 6, "k", 1, "n"), (2, "a b c d e f", 6, "k", 1, "n"), (3, "x", 7, "l", 3, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _key string, _rank int, node string")
    for stage in (exact_dedup.drop_copies, near_texts.drop_near):
        got = stage(docs)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[3]]


def test_languages_of_repeated_rows_are_learned(spark):
    from vignetta.llm import crf_langid

    for german in (7, 13):
        rows = [(i, f"the and of that with {i} " * 9, "en") for i in range(300)] + [(german, "der die und nicht ist " * 9, "de")] * 3000
        assert crf_langid.fit_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=20).languages == ["de", "en"]


def test_long_texts_are_drawn_from_as_a_whole(spark):
    from vignetta.llm import crf_langid

    late = "the and of that with " * 40_000 + "der die und nicht ist " * 40_000
    import pyarrow as pa

    got = crf_langid._windows(pa.RecordBatch.from_arrays([pa.array([late] * 20), pa.array(range(20), pa.int64())], ["text", "_hash"]))[0].to_pylist()
    words = [w for r in got for p in r for w in p.split()]
    assert len(words) == 20 * crf_langid.WINDOWS * crf_langid.WINDOW and 0.3 < np.mean([w in b"der die und nicht ist".split() for w in words]) < 0.7


def test_tiers_gaps_and_step_groups():
    from vignetta.llm import packing

    rng = random.Random(3)
    sizes = [min(9000, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(6000)]
    packer = packing.Packer()
    for i, n in enumerate(sizes):
        packer.add(i, n)
        if i % 50 == 0:
            packer.pack()
    packer.pack()
    waiting = sum(packer.tokens)
    windows, groups = collections.defaultdict(list), collections.Counter()
    for doc, start, n, seq, offset, tier, group in packer.out:
        windows[seq, tier].append((offset, n, doc, start))
        groups[tier, group] += n
    assert waiting < sum(packing.TIERS)  # less than a window for each tier
    assert sum(map(len, windows.values())) == len(packer.out) and all(sum(p[1] for p in w) == tier for (_, tier), w in windows.items())  # no padding
    # a window is opened by a document of its tier: longer than the next tier, or a whole stretch, or the rest of a cut one
    lower = dict(zip(packing.TIERS, [*packing.TIERS[1:], 0]))
    first = [(tier, *min(w)) for (_, tier), w in windows.items()]
    assert all(lower[tier] < n <= tier for tier, _, n, _, _ in first)
    # gaps are filled from shorter tiers
    assert sum(len(w) > 1 and all(n <= lower[tier] for _, n, _, _ in sorted(w)[1:]) for (_, tier), w in windows.items() if tier > 512) > 100
    # step groups are balanced: all but a tier's last hold the same number of tokens
    for tier in packing.TIERS:
        mine = sorted((g, n) for (t, g), n in groups.items() if t == tier)
        assert all(n == packing.STEP_TOKENS for _, n in mine[:-1]) and [g for g, _ in mine] == list(range(len(mine)))
    packer.pack(to_end=True)
    assert sum(p[2] for p in packer.out) == sum(sizes)


def test_long_chunks_are_not_kept():
    from vignetta.llm import packing

    path = queries.tokenizer_path()
    encode = packing._encoder(path)
    texts = [("漢字" * 3000 + str(i)).encode() for i in range(20)] + [b"plain words"]
    assert encode(texts) == encode(texts)
    assert all(len(c) <= packing.MEMO_BYTES for c in packing._LIBRARY[path][1])


def test_packing_null_ids_and_repeats(spark):
    from vignetta.llm import packing

    docs = spark.createDataFrame([(None, "a b"), (None, None), (1, "c"), (1, "c")], "doc_id long, text string")
    got = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    assert collections.Counter(r["doc_id"] for r in got if r["start"] == 0) == {None: 2, 1: 2}
