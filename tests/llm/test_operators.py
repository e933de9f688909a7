"""Every operator against a brute-force version, and on nulls, empty texts, repeats, ties, empty tables and clashing columns."""

import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vignetta.llm import bpe, crf_langid, ctw, exact_dedup, line_dedup, near_texts, packing, quality, queries, simhash, tool_calls, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score double, kept boolean, size int, lang string"


def frame(spark, texts, ids=None):
    """Documents with columns that clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 9.0, False, 1, "en") for i, t in zip(ids, texts)], DOCS)


EDGE = [None, "", "   \n\t", "a", "one two", "one two", "word " * 9000, "x" * 70000, "é ü 漢字\x00 z"]


@pytest.fixture(scope="module")
def corpus(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


# op1


def ctw_brute(train, texts):
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    counts, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def steps(t):
        buf = b"\xfe" * 8 + t.encode().lower() + b"\xff"
        for i in range(8, len(buf)):
            for j in range(8):
                yield buf[i - ctw.DEPTH : i], (1 << j) | (buf[i] >> (8 - j)), (buf[i] >> (7 - j)) & 1

    for t in train:
        for ctx, node, bit in steps(t):
            for d in range(ctw.DEPTH + 1):
                key = (d, ctx[len(ctx) - d :], node)
                counts[key][bit] += 1
                if d:
                    kids[d - 1, key[1][1:], node].add(key)
    memo = {}

    def weight(key):
        if key not in memo:
            own = kt(*counts[key])
            memo[key] = own if key[0] == ctw.DEPTH else math.log(0.5) + np.logaddexp(own, sum(weight(k) for k in kids[key]))
        return memo[key]

    def one(ctx, node, d=0):
        key = (d, ctx[len(ctx) - d :], node)
        if key not in counts:
            return 0.5
        a, b = counts[key]
        p = (b + 0.5) / (a + b + 1)
        if d == ctw.DEPTH:
            return p
        w = 1 / (1 + math.exp(sum(weight(k) for k in kids[key]) - kt(a, b)))
        return w * p + (1 - w) * one(ctx, node, d + 1)

    return [sum(math.log10(p if bit else 1 - p) for ctx, node, bit in steps(t) for p in [one(ctx, node)]) for t in texts]


def test_ctw_equals_brute_force(spark):
    texts = ["abracadabra banana", "the cat", "é no", "", None, "the cat", "A banana cat xyz"]
    got = ctw.score_corpus(frame(spark, texts), F.col("doc_id") == 6).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    for r, want in zip(got, ctw_brute(plain[:6], plain)):
        assert r["score"] == pytest.approx(want, abs=1e-4)
    words = [w for t in plain[:6] for w in [*t.lower().encode().split(), b""]]
    c = collections.Counter(words)
    for r, t in zip(got, plain):
        mine = [*t.lower().encode().split(), b""]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (len(words) + len(c) + 1)) for w in mine))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine), sum(c[w] > 0 for w in mine), len(words))


@pytest.mark.parametrize("most", [0, 5, 40])
def test_ctw_scores_do_not_depend_on_the_table(spark, most):
    texts = ["abracadabra banana", "the cat", "é no", "", None, "the cat", "A banana cat xyz", "zq zq"]
    got = ctw.score_corpus(frame(spark, texts), F.col("doc_id") >= 6, table_grams=most).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    assert [r["score"] for r in got] == pytest.approx(ctw_brute(plain[:6], plain), abs=1e-7)


def test_ctw_without_training_and_empty(spark):
    got = ctw.score_corpus(frame(spark, ["ab"]), F.lit(True)).first()
    assert got["score"] == pytest.approx(24 * math.log10(0.5)) and got["n_known"] == 0
    assert ctw.score_corpus(frame(spark, []), F.lit(False)).count() == 0


def test_ctw_beats_words_on_held_out(spark):
    rows = [r for r in run(spark, "op1_ctw_score") if r["held_out"]]
    assert rows and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


# op2


def test_language_on_held_out(spark, corpus):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in run(spark, "op2_crf_langid") if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_code_switched_words():
    model = crf_langid.fit([b"the and of that with " * 30, b"der die und nicht ist " * 30], ["en", "de"])
    words = b"the and of that der die und nicht ist with of the".split()
    post = crf_langid.forward_backward(crf_langid.emissions(words, model.weights), np.array([0, len(words)]), model.trans)[0]
    assert "".join(model.languages[i][0] for i in post.argmax(axis=1)) == "eeeedddddeee"


@pytest.mark.parametrize("n", [1, 31, 32, 33, 150])
def test_forward_backward_equals_plain(n):
    rng = np.random.default_rng(n)
    e, t = rng.normal(size=(n + 5, 3)), rng.normal(size=(3, 3))
    got = crf_langid.forward_backward(e, np.array([0, 5, n + 5]), t)[0][5:]
    a = [np.full(3, 1 / 3) @ np.exp(t) * np.exp(e[5])]
    for x in e[6:]:
        a.append(a[-1] @ np.exp(t) * np.exp(x) / a[-1].sum())
    b = [np.ones(3)]
    for x in e[:5:-1]:
        b.append(np.exp(t) @ (np.exp(x) * b[-1]) / b[-1].sum())
    want = np.array(a) * np.array(b[::-1])
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_language_edges(spark):
    model = crf_langid.fit([b"the and of " * 30, b"der die und " * 30], ["en", "de"])
    rows = crf_langid.label(frame(spark, [*EDGE, "12 34 !"]), model, spans=True).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows][:3] == ["und"] * 3 and rows[-1]["lang_pred"] == "und"
    assert all(r["lang_pred"] in ("en", "de") for r in rows[3:-1]) and rows[4]["lang_pred"] == rows[5]["lang_pred"]
    assert sum(s["words"] for s in rows[6]["spans"]) == 9000
    nothing = crf_langid.fit_sample(frame(spark, ["a"]).withColumn("lang", F.lit(None).cast("string")))
    assert crf_langid.label(frame(spark, ["abc"]), nothing).first()["lang_pred"] == "und"
    assert crf_langid.label(frame(spark, []), model).count() == 0


def test_rare_and_wordless_labels_are_learned_from(spark):
    assert crf_langid.fit([b"the and of " * 30, b"der die und " * 30, b" \n"], ["en", "de", "xx"]).languages == ["de", "en"]
    rows = [(i, "the and of that with " * 9, "en") for i in range(3000)] + [(i, "der die und nicht ist " * 9, "de") for i in range(9000, 9002)] + [(9009, " \n", "xx"), (9010, "", "xx")]
    model = crf_langid.fit_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=20)
    long = spark.createDataFrame([(0, "the and of " * 30, "en"), (1, "der die und " * 5000, "de")], "doc_id long, text string, lang string")
    assert crf_langid.fit_sample(long).languages == ["de", "en"]
    got = crf_langid.label(frame(spark, ["the and of that", "der die und nicht"]), model).orderBy("doc_id").collect()
    assert model.languages == ["de", "en"] and [r["lang_pred"] for r in got] == ["en", "de"] and all(r["score"] > 0.8 for r in got)


# op3


def test_exact_copies(spark):
    texts = ["a b", "ab", "a  b", None, "", " \n", "c", "c", "É"]
    rows = exact_dedup.exact_dedup(frame(spark, texts, [5, 1, 7, 3, 2, 9, 4, 4, 8])).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len(rows) == 9 and by[1][0]["keep_id"] == 7 and by[5][0]["group_size"] == 3 and by[7][0]["kept"]
    assert by[3][0]["keep_id"] == 9 and by[9][0]["kept"] and by[2][0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert sorted(r["kept"] for r in by[4]) == [False, True] and by[8][0]["text_sha256"] == hashlib.sha256("É".encode()).hexdigest()
    assert exact_dedup.drop_copies(frame(spark, texts, [5, 1, 7, 3, 2, 9, 4, 4, 8])).count() == 4
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_tree_over_many_runs(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 40).cast("string")).alias("text")).repartition(90)
    rows = exact_dedup.exact_dedup(docs).collect()
    assert all(r["group_size"] == 75 and r["keep_id"] == r["doc_id"] % 40 for r in rows) and sum(r["kept"] for r in rows) == 40


def test_merge_pass_over_batches():
    import pyarrow as pa

    fields = [pa.field("grp", pa.int32(), False), pa.field("digest", pa.binary()), pa.field("check", pa.int64()), pa.field("norm_bytes", pa.int64()), pa.field("n_points", pa.int64()), pa.field("doc_id", pa.int64()), pa.field("row_id", pa.int64(), False), pa.field("size", pa.int64(), False)]
    rng = random.Random(4)
    rows = sorted((0, bytes([rng.randrange(9)]), 1, 1, 5, i, i, rng.randrange(1, 4)) for i in range(60))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 7]), fields)], schema=pa.schema(fields)) for i in range(0, 60, 7)]
    got = [r for b in exact_dedup._first_of_equal(iter(batches)) for r in b.to_pylist()]
    want = collections.Counter()
    for r in rows:
        want[r[1]] += r[7]
    assert [(r["digest"], r["size"]) for r in got] == sorted(want.items()) and [r["row_id"] for r in got] == [next(r[6] for r in rows if r[1] == d) for d in sorted(want)]


# op4


def test_base_counts_equal_plain():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", "é", "b "]) for _ in range(rng.randrange(60)))
        words = text.encode().split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = {w for w in windows if windows.count(w) > 1}
        lines = [x for x in text.split("\n") if x.split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len({i + k for i, w in enumerate(windows) if w in many for k in range(3)}))
        assert quality.base_stats(text.encode(), words) == want


def quality_plain(texts, trusted):
    """Mean log ratio of each text's n-grams, by dictionaries over the whole corpus."""
    target, raw, grams = collections.Counter(), collections.Counter(), {}
    for i, t in texts.items():
        joined = (" " + " ".join(t.split()) + " ").encode() if t.split() else b""
        padded = joined.ljust(quality.N, b"\0") if joined else b""
        codes = [int.from_bytes(padded[k : k + quality.N], "big") for k in range(len(padded) - quality.N + 1)]
        grams[i] = [(c * 0x9E3779B97F4A7C15 % 2**64) // (2**64 // quality.BUCKETS) for c in codes]
        raw.update(grams[i])
        if i in trusted:
            target.update(grams[i])
    n, m, b = sum(target.values()), sum(raw.values()), quality.BUCKETS
    value = {g: math.log((target[g] + 1) / (n + b)) - math.log((raw[g] + 1) / (m + b)) if n else 0.0 for g in raw}
    return {i: sum(value[g] for g in gs) / len(gs) if gs else 0.0 for i, gs in grams.items()}


def test_quality_scores_equal_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    want = quality_plain({r["doc_id"]: r["text"] or "" for r in docs.collect()}, trusted)
    got = {r["doc_id"]: r for r in run(spark, "op4_quality")}
    assert all(got[i]["score"] == pytest.approx(w, abs=1e-9) and got[i]["kept"] == (not got[i]["base_failed"] and got[i]["score"] >= quality.THRESHOLD) for i, w in want.items())
    # no trusted document: every score is 0 and kept
    none = quality.quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in none} == {0.0} and all(r["kept"] != r["base_failed"] for r in none)


def test_quality_verdicts(spark):
    good, bad = "the cat sat on the mat and " * 3, "## $$ %% && ** ||"
    rng = random.Random(1)
    pool = "alpha beta gamma delta omega sigma kappa theta".split()
    texts = [" ".join(rng.choice(pool) + str(rng.randrange(99)) for _ in range(80)) for _ in range(40)] + [" ".join("#$%&" + str(rng.randrange(99)) for _ in range(80)) for _ in range(20)]
    docs = frame(spark, [*texts, *EDGE, good, bad])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.quality(docs, labels.filter("doc_id IS NOT NULL")).collect()}
    assert all(rows[i]["kept"] for i in range(40)) and not any(rows[i]["kept"] for i in range(40, 60))
    assert rows[60]["base_failed"] and rows[60]["n_words"] == 0 and rows[66]["base_failed"] and rows[66]["n_repeat_words"] == 9000
    assert quality.quality(frame(spark, []), labels).count() == 0


# op5


def test_lines_equal_plain(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["Foo", " foo\t", "bar", "", "u%d" % rng.randrange(9), "É", "é"]) for _ in range(rng.randrange(6))) for _ in range(60)] + EDGE
    key = lambda x: x.strip(" \t\n\v\f\r").translate({i: i + 32 for i in range(65, 91)})
    df = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    rows = line_dedup.dedup_lines(frame(spark, texts), min_docs=10).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if df[key(x)] < 10]
        assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_perfect_hash_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(1)
    hi, lo = (rng.integers(0, 2**64, 5000, np.uint64) for _ in range(2))
    hi[:2000] = hi[0]  # halves may repeat, keys don't
    ph = line_dedup.PerfectHash.load(*line_dedup.PerfectHash.build(hi, lo).dump())
    assert sorted(ph.index(hi, lo)) == list(range(len(hi)))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "BLOCK_BITS", 1)
    texts = ["\n".join(f"line {i}" for i in range(12)) + f"\nown {k}" for k in range(10)]
    assert {(r["n_dropped"], r["kept_text"][:3]) for r in line_dedup.dedup_lines(frame(spark, texts)).collect()} == {(12, "own")}


# op6 and op8


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def library_ids(lib, text):
    return np.array(lib.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_packing_holds_every_id_once(spark):
    lib = library()
    texts = EDGE + ["many words here " * n for n in (1, 7, 100, 900, 5000)]
    pieces = packing.pack_documents(frame(spark, texts).repartition(3), queries.tokenizer_path()).collect()
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append((p["start"], p["length"], bytes(p["ids"])))
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, t in enumerate(texts):
        want = np.append(library_ids(lib, t), 2).astype("<u4").tobytes()
        assert b"".join(x[2] for x in sorted(docs[i])) == want and sum(x[1] for x in docs[i]) * 4 == len(want)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack_documents(frame(spark, []), queries.tokenizer_path()).count() == 0


def test_chunks_parted_from_marks_encode_as_the_library():
    lib, rng = library(), random.Random(8)
    signs = [*"abXY09éÉ×÷ßñ.,'\"!*#<|>()-_` \n\t", "'s", "'ll", "\u0301", "\u0338", "Σ", "中", "½", "\u00a0", "İ", "\x00", "\x85", "<|endoftext|>", "<|"]
    texts = ["".join(rng.choice(signs[: len(signs) - 2 * plain]) for _ in range(rng.randint(0, 30))) for plain in (0, 1) for _ in range(4000)]
    encode = packing._encoder(queries.tokenizer_path())
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        for t, ids in zip(some, encode([t.encode() for t in some])):
            assert ids == library_ids(lib, t).tobytes(), t


def test_bpe_equals_library(spark):
    lib, rng = library(), random.Random(4)
    texts = EDGE + ["It's <|endoftext|>A<|startoftext|> x<|END", "ΑΣ Σας İ ½²Ⅷ x y z á", "🙂🙂 don't"] + ["".join(rng.choice(rng.choice(["ab", "theranios", "#$%", "ー日é"])) for _ in range(n)) for n in (3, 600, 1500, 3000)]
    rows = bpe.encode_documents(frame(spark, texts), queries.tokenizer_path()).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        want = library_ids(lib, t)
        assert bytes(r["ids"]) == want.tobytes() and r["decoded"] == lib.decode(want.tolist(), skip_special_tokens=False)
    tok = bpe.tokenizer(queries.tokenizer_path())
    decoder = bpe.Decoder(tok.strings)
    assert "".join([*(decoder.feed(np.array([i], "<u4").tobytes()) for i in (320, 1125)), decoder.close()]) == lib.decode([320, 1125], skip_special_tokens=False)
    assert tok.lookahead < bpe.BLOCK and bpe.encode_documents(frame(spark, []), queries.tokenizer_path()).count() == 0


def test_a_word_of_megabytes_streams_in_fixed_memory(monkeypatch):
    import tracemalloc

    tok, rng = bpe.tokenizer(queries.tokenizer_path()), random.Random(7)
    word = "".join(rng.choice("theraniosg") for _ in range(2_000_000))
    text, most = word.encode(), 0
    tracemalloc.start()
    head = b""
    for i, block in enumerate(tok._pieces(text)):
        head += block if len(head) < 4000 else b""
        if i == 3:
            tracemalloc.reset_peak()
            before = tracemalloc.get_traced_memory()[0]
        if i == 60:
            most = tracemalloc.get_traced_memory()[1] - before
            break
    tracemalloc.stop()
    assert 0 < most < 2_000_000  # the whole word's symbols and ids would take tens of megabytes
    lib = library()
    want = library_ids(lib, word[:60_000])
    monkeypatch.setattr(bpe, "LONG_TEXT", 0)
    ids, decoded = tok.round_trip(text[:60_000] + b" a " + "é".encode() * 300)
    assert ids[: len(want) * 4] == want.tobytes() and decoded.decode() == lib.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_long_words_stream_like_whole_ones():
    tok, rng = bpe.tokenizer(queries.tokenizer_path()), random.Random(5)
    for alphabet in ("ab", "theraniosg", "abcdefghijklmnopqrstuvwxyz"):
        ids = [tok.plain[ord(c)] for c in (rng.choice(alphabet) for _ in range(4000))]
        assert [t for block in tok.stream_word(ids) for t in block] == tok.merge(list(ids))


# op7


def simhash_plain(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups_plain(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(frame(spark, EDGE, range(-9, 0)).select("doc_id", "text"))
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [simhash_plain(t) for _, t in texts]
    want = [texts[i][0] for i in groups_plain(fps)]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect())
    assert got == [(i, f"{f:016x}", w) for (i, _), f, w in zip(texts, fps, want)]
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_stages_drop_rows_not_ids(spark):
    texts, ids = ["a b c", "ab c", "x y", "c d", "e f g", "e  f g", "x y", "q r", "q r"], [1, None, None, 5, 5, 4, None, 7, 7]
    left = sorted((r["text"], r["doc_id"] or 0) for r in exact_dedup.drop_copies(frame(spark, texts, ids)).collect())
    assert left == [("a b c", 1), ("c d", 5), ("e  f g", 4), ("q r", 7), ("x y", 0)]
    texts[1] = "A b c"
    left = sorted((r["text"], r["doc_id"] or 0) for r in near_texts.drop_near(frame(spark, texts, ids)).collect())
    assert left == [("a b c", 1), ("c d", 5), ("e  f g", 4), ("q r", 7), ("x y", 0)]


def near_plain(texts):
    """Least index of each text's group, links being texts of similarity 0.8 or more."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 0.8 <= len(x) / len(y) <= 1.25 and len(x & y) >= 0.8 * len(x | y):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for k in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for edits in (0, 1, 4, 6, 12, 40):  # similarities from 1 down to about 0.4
            words = list(base)
            for p in rng.sample(range(400), edits):
                words[p] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(words))
    texts += ["", " \n", None, "one two", "One  two"]
    got = {r["doc_id"]: r["best"]["doc_id"] for r in near_texts.near_groups(frame(spark, texts)).collect()}
    want = near_plain([t or "" for t in texts])
    # no wrong link; candidates are a matter of probability
    assert all(want[got[i]] == want[i] for i in got) and np.mean([got[i] == want[i] for i in got]) > 0.95
    assert sorted(r["doc_id"] for r in near_texts.drop_near(frame(spark, texts)).collect()) == sorted(set(got.values()))
    assert near_texts.drop_near(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [5, 1024])
def test_large_near_groups(spark, monkeypatch, block):
    # in Spark's workers the module is read anew, so blocks are tested here and a large group there
    monkeypatch.setattr(near_texts, "BLOCK", block)
    rng = np.random.default_rng(3)
    f = np.stack([np.full(60, 77, np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)), np.zeros(60, np.uint64)], axis=1).view(np.int64)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(20, 5)), pa.array(np.arange(i, i + 20)), pa.array(f[i : i + 20, 0]), pa.array(f[i : i + 20, 1])], ["key", "node", "f0", "f1"]) for i in (0, 20, 40)]
    links = [x for b in near_texts._candidates(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
    tied = [x for x in links if x[2] == near_texts.TIED]  # a large bucket's members are also tied to its first
    assert len(set(tied)) == (0 if block == 1024 else 59)
    links = [x for x in links if x not in tied]
    ends = {x for a, b, _ in links for x in (a, b)}
    assert ends == set(range(60)) and 59 <= len(links) <= 75 and all(d <= 2 for *_, d in links)
    if block == 1024:
        words = [f"w{i}" for i in range(120)]
        texts = [" ".join([*words[:60], f"own{i}", *words[60:]]) for i in range(400)]
        assert [r["doc_id"] for r in near_texts.drop_near(frame(spark, texts)).collect()] == [0]


def test_ball_hashing_finds_every_link(spark):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(30)} | {0}
    for f in list(fps):
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in found]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    index, parent = {f: i for i, f in enumerate(fps)}, list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(index[a]), root(index[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(fps))] == groups_plain(fps)


def test_large_buckets_link_alike(monkeypatch):
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**12, 300).astype(np.uint64) << np.uint64(20))
    count = lambda x: len({tuple(p) for p in zip(*x)})
    few = simhash.spanning_links(fps)
    monkeypatch.setattr(simhash, "ROW_LIMIT", 10)
    many = simhash.spanning_links(fps)
    assert count(few) == count(many) == len(fps) - len(set(groups_plain(fps.tolist())))


# op9


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "search", '{"query": "q", "limit": 3}', []), (1, 2, "b", "lookup", '{"strict": 1, "key": "k"}', ["a"]), (1, 2, "b", "lookup", '{"key": "k"}', []), (1, 4, "c", "search", "nope", ["d"]),
        (1, 4, "d", "other", "[1]", []), (2, 0, None, "search", None, None), (2, 1, "x", "search", '{"limit": 1}', ["y"]), (2, 1, "y", "search", '{"query": "q", "limit": 1, "zz": 0}', ["x"]),
    ]
    results = [(1, 1, "a", "ok"), (1, 3, "b", None), (1, 3, "lost", "r"), (1, 9, "a", "late"), (1, 0, "c", "early"), (2, 5, None, "n")]
    c = spark.createDataFrame(calls, "conv_id long, turn int, call_id string, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn int, call_id string, content string")
    rows = tool_calls.link_calls(c, r).collect()
    by = {(x["call_id"], x["status"]): x for x in rows}
    assert len(rows) == 9 and by["a", "linked"]["problem"] is None and by["a", "linked"]["json"] == '{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search","result":"ok"}'
    assert by["b", "linked"]["problem"] == "type of strict" and ("b", "duplicate") in by and by["c", "result_first"]["problem"] == "not JSON" and by["c", "result_first"]["round"] == 1
    assert by["d", "no_result"]["problem"] == "not an object" and (None, "no_id") in by and ("x", "cycle") in by and by["y", "cycle"]["problem"] == "unexpected zz" and ("lost", "orphan_result") in by
    for x in rows:
        json.loads(x["json"])
    assert tool_calls.link_calls(c.limit(0), r.limit(0)).count() == 0


def link_plain(calls, results):
    """(conv_id, turn, call_id, status, round, result) of every call and lone result."""
    first, answer = {}, {}
    for i, (conv, turn, cid, *_) in enumerate(calls):
        if cid is not None:
            first[conv, cid] = min(first.get((conv, cid), (turn, i)), (turn, i))
    for i, (conv, turn, cid, content) in enumerate(results):
        if cid is not None:
            answer[conv, cid] = min(answer.get((conv, cid), (turn, i, content)), (turn, i, content))
    deps = {(conv, cid): {(conv, d) for d in calls[i][5] or [] if (conv, d) in first} for (conv, cid), (_, i) in first.items()}
    held = {k for k, ds in deps.items() if any(first[d][0] >= first[k][0] for d in ds)}
    while more := {k for k, ds in deps.items() if k not in held and ds & held}:
        held |= more
    level, r = {}, 1
    while free := {k for k in held - level.keys() if not deps[k] & (held - level.keys())}:
        level |= dict.fromkeys(free, r)
        r += 1
    out = []
    for i, (conv, turn, cid, *_) in enumerate(calls):
        k = (conv, cid)
        if cid is None or first[k][1] != i:
            out.append((conv, turn, cid, "no_id" if cid is None else "duplicate", 0, None))
            continue
        got, n = answer.get(k), level.get(k, -1) if k in held else 0
        status = "cycle" if n == -1 else "no_result" if got is None else "result_first" if got[0] < turn else "linked"
        out.append((conv, turn, cid, status, n, got and got[2]))
    return out + [(k[0], a[0], k[1], "orphan_result", 0, a[2]) for k, a in answer.items() if k not in first]


@pytest.mark.parametrize("group", [20_000, 0])
def test_tool_calls_equal_brute_force(spark, group):
    rng = random.Random(11)
    ids = [f"call_{i}" for i in range(9)]
    calls = [(rng.choice([1, 2, 3, None]), rng.randrange(6), rng.choice([*ids, None]), "search", None, rng.sample(ids, rng.choice([0, 0, 1, 1, 2]))) for _ in range(60)]
    calls += [(7, 50 - i, f"c{i}", "lookup", None, [f"c{i - 1}"]) for i in range(1, 5)]  # a chain against the turns
    results = [(rng.choice([1, 2, 3, None]), rng.randrange(9), rng.choice([*ids, "lost", None]), f"r{i}") for i in range(40)] + [(7, 60, "c1", "x")]
    # one row a file keeps the order of rows
    c = spark.createDataFrame(calls, "conv_id long, turn int, call_id string, name string, arguments string, after array<string>").coalesce(1)
    r = spark.createDataFrame(results, "conv_id long, turn int, call_id string, content string").coalesce(1)
    linked = tool_calls.link_calls(c.withColumn("key", F.lit("clash")).withColumn("at", F.lit(0)), r, group_calls=group)
    got = [(x["conv_id"], x["turn"], x["call_id"], x["status"], x["round"], json.loads(x["json"])["result"]) for x in linked.collect()]
    assert sorted(got, key=str) == sorted(link_plain(calls, results), key=str)
    plan = linked._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


# op10


def test_url_verdicts(spark):
    urls = ["http://A.Example.org/es/x?q#f", "https://x.org", "https://x.org/", None, "no scheme", "http://www.bad.net/p/", "http://m.bad.net/p.html?x", "http://bad.net/P", "http://notcom/fr/", "http://a.com/fr/", "http://a.com/de/1", "http://b.example.org/en/19"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("listed", F.lit(1))
    listed = spark.createDataFrame([("bad.net/p",), (None,), ("bad.net/p",)], "canon string")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, listed).collect()}
    want = [("a.example.org", "/es/x", "example.org/es/", "block"), ("x.org", "", None, "allow"), ("x.org", "/", "org/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.bad.net", "/p/", None, "block"), ("m.bad.net", "/p.html", None, "block"), ("bad.net", "/P", None, "allow"), ("notcom", "/fr/", None, "allow"), ("a.com", "/fr/", "com/fr/", "allow"), ("a.com", "/de/1", "com/de/", "block"), ("b.example.org", "/en/19", "example.org/en/1", "block")]
    assert rows == dict(enumerate(want))
    assert {r["verdict"] for r in url_filter.judge_urls(pages.filter("page_id = 5"), listed.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0


def test_crc_split_matches_the_text_form(spark):
    from vignetta.llm.common import split_of

    rows = spark.range(50).select("id", split_of("id", 7).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in rows)


def test_pipeline_equals_plain_stages(spark, corpus):
    """What each stage keeps of sf0.001, held against plain versions over the rows it was given."""
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen[name] = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(seen[name], docs.schema)
    kept = {n: {r["doc_id"] for r in rows} for n, rows in seen.items()}
    texts = {i: t or "" for i, t in corpus.items()}
    langs = {r["doc_id"]: r for r in run(spark, "op2_crf_langid")}
    assert kept["language_id"] == {i for i in texts if langs[i]["lang_pred"] != "und" and langs[i]["score"] >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    score = quality_plain({i: texts[i] for i in kept["language_id"]}, {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()})
    verdict = {}
    for i in kept["language_id"]:
        s = quality.base_stats(texts[i].encode(), texts[i].encode().split())
        verdict[i] = s[0] >= 50 and 100 * s[4] <= 50 * s[0] and score[i] >= quality.THRESHOLD
    assert kept["quality_rules"] == {i for i, ok in verdict.items() if ok}
    best = {}
    for i in sorted(kept["quality_rules"]):
        k = "".join(texts[i].split())
        if k not in best or len(texts[i]) > len(texts[best[k]]):
            best[k] = i
    assert kept["exact_dedup"] == set(best.values())
    ids = sorted(kept["exact_dedup"])
    assert kept["near_dedup"] == {ids[k] for k in near_plain([texts[i] for i in ids])}
    lib, total = library(), collections.Counter()
    for p in seen["packing"]:
        total[p["doc_id"]] += p["length"]
    assert total == {i: len(library_ids(lib, texts[i])) + 1 for i in kept["near_dedup"]}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == kept["near_dedup"]


def test_stages_on_null_shared_and_no_rows(spark):
    import corpus_pipeline

    rng = random.Random(12)
    texts = [" ".join(rng.choice(["the", "and", "of"]) + str(rng.randrange(999)) for _ in range(90)) for _ in range(12)]
    ids = [1, None, None, 5, 5, 4, 7, 7, 8, 9, 10, 11]
    # rows 0 and 1: copies with a null id; 2: null id of its own; 3, 4: one id, two texts; 6, 7: repeated row
    texts[1], texts[7] = texts[0].replace(" ", "  "), texts[6]
    docs = frame(spark, texts, ids)
    want = sorted(t for i, t in enumerate(texts) if i not in (0, 7))
    for name in ("exact_dedup", "near_dedup"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        left = sorted(" ".join(r["text"].split()) for r in out.collect())
        assert left == sorted(" ".join(t.split()) for t in want) and out.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_filtering_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "and", "of"]) + str(rng.randrange(999)) for _ in range(90)) for _ in range(30)] + ["12 34"]
    docs = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    out = corpus_pipeline.language_id(spark, docs, SF)
    assert out.columns == docs.columns and {(r["score"], r["kept"], r["size"]) for r in out.collect()} == {(9.0, False, 1)} and out.count() == 30
    assert corpus_pipeline.quality_rules(spark, docs, SF).columns == docs.columns


def bucket_members(rng, block, key, n):
    """Members of key's bucket: any value of the block, at most one bit of the others off; and a few of another block's emission."""
    keep, flips = ~(0xFFFF << 16 * block) % 2**64, [0, *(1 << i for i in range(64) if i // 16 != block)]
    return {(key & keep) ^ rng.choice(flips) ^ (rng.getrandbits(16) << 16 * block) for _ in range(n)}


@pytest.mark.parametrize("block, n", [(0, 400), (1, 3000), (3, 12000)])
def test_links_of_a_large_bucket(block, n):
    rng = random.Random(block)
    key = rng.getrandbits(64) & ~(0xFFFF << 16 * block) % 2**64 | (block + 1) << 16 * block
    fps = np.array(sorted(bucket_members(rng, block, key, n)), np.uint64)
    x, y = simhash.grid_links(fps, key)
    assert (np.bitwise_count(x ^ y) <= 3).all() and len(x) < len(fps)

    def trees(a, b):
        tree = {f: f for f in fps.tolist()}

        def root(f):
            while tree[f] != f:
                tree[f] = f = tree[tree[f]]
            return f

        for p, q in zip(a.tolist(), b.tolist()):
            p, q = root(p), root(q)
            tree[max(p, q)] = min(p, q)
        return [root(f) for f in fps.tolist()]

    want = trees(*simhash.spanning_links(fps))
    assert trees(x, y) == want
    assert len(x) == len(fps) - len(set(want))


def test_large_buckets_in_the_shuffled_links(monkeypatch):
    """Every link lies in some bucket however large: rows of one key pass through the same path as on a cluster."""
    rng = random.Random(8)
    key = (rng.getrandbits(64) & ~0xFFFF | 1) % 2**64
    fps = sorted(bucket_members(rng, 0, key, 300))
    rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), key, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64))], ["key", "fp"])
    few = sum(b.num_rows for b in simhash._links(iter([rows])))
    monkeypatch.setattr(simhash, "ROW_LIMIT", 10)
    many = sum(b.num_rows for b in simhash._links(iter([rows.slice(0, 100), rows.slice(100)])))
    assert few == many > 0


def test_false_hits_of_the_filter_are_removed(spark, monkeypatch):
    """One block for 400 listed URLs is so full that most other URLs pass it; the exact join decides."""
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    listed = spark.createDataFrame([(f"bad{i}.net/x",) for i in range(400)] + [(None,)], "canon string")
    urls = [f"http://bad{i}.net/x" for i in range(0, 400, 40)] + [f"http://good{i}.net/x" for i in range(60)] + [None, "no host"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    canon = url_filter.canonical(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    block = url_filter.bloom_blocks(listed.filter("canon IS NOT NULL"), 1)
    bits = [F.col(f"w{i}").bitwiseAND(b) == b for i, b in enumerate(url_filter._bits(canon.alias("canon")))]
    hit = bits[0]
    for b in bits[1:]:
        hit = hit & b
    assert pages.filter("url LIKE 'http://good%'").join(F.broadcast(block), F.lit(True)).filter(hit).count() >= 10
    got = {r["page_id"]: (r["listed"], r["verdict"]) for r in url_filter.judge_urls(pages, listed).collect()}
    assert got == {i: (True, "block") if (u or "").startswith("http://bad") else (False, "allow") for i, u in enumerate(urls)}
