"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, and each of the 255 decision nodes has a context tree over the preceding bytes, of
depth DEPTH. Every node keeps a Krichevsky-Trofimov estimate; node weights mix it with what the deeper contexts
say, half and half before any data, so all depths take part:

    Pw(s) = 1/2 Pkt(s) + 1/2 prod Pw(children)        (at the deepest level Pw = Pkt)

Training is exact and distributed: tasks count the (DEPTH + 1)-byte strings of all training texts, sums are shuffled, and
the trees are folded level by level with group-bys, deepest first, each child adding its counts and log Pw to its
parent. A second walk from the root down turns the posterior weights into the probability of a 1 at every deepest node.

Strings that only held-out texts have go into the trees with count zero. Such nodes have Pw = 1 and change no other
node, and their probability is that of a known context whose deeper ones have no data (1/2); so every string to be
scored has its eight deepest nodes, and one join gives its log probability. The TABLE_GRAMS commonest strings
travel as a table; the others of each text are looked up by a join on the string, with the same values.

The word unigram base beside it uses counts of all training words: those frequent enough that at most FREQUENT
of them can exist (N / FREQUENT occurrences) are looked up in a broadcast table, all others by a join on the word.

Defined results: a null text is empty and scores its end symbol alone; without training texts every bit has
probability 1/2 and the base probability is 1 for each token; repeated rows get equal answers; a null doc_id counts as the
empty id in the split; an empty table gives no row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH = 5
TABLE_GRAMS = 1 << 21
FREQUENT = 1 << 20
MEMO_BITS = 20
FLUSH_WORDS = 200_000
FLUSH_GRAMS = 1_000_000
BATCH_ROWS = 250
END_WORD = b""
_PAD, _END = b"\xfe" * 8, b"\xff"
_K = np.uint64(0x9E3779B97F4A7C15)
ABSENT = 1.0  # no log probability is positive


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every scored byte with its DEPTH predecessors as one integer, and the first position of each text."""
    lowered = [t.lower() for t in texts]
    raw = b"".join(x for t in lowered for x in (_PAD, t, _END))
    window = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))
    scored = np.frombuffer(raw, np.uint8)[7:] != 0xFE
    code = window[scored].astype(np.uint64) & np.uint64((1 << (8 * DEPTH + 8)) - 1)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    return code, np.cumsum(sizes) - sizes


def count_corpus(docs: DataFrame) -> DataFrame:
    """(gram, word, n, seen): byte strings (word null) of all texts with their counts in training and in all texts, and training words (gram null); the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        names = ["gram", "word", "n", "seen"]

        def word_rows() -> pa.RecordBatch:
            n, counts = len(words), pa.array(list(words.values()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(list(words), pa.binary()), counts, counts], names)

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([g[0] for g in grams]), return_inverse=True)
            n, seen = (np.bincount(at, np.concatenate([g[i] for g in grams])).astype(np.int64) for i in (1, 2))
            return key, n, seen

        def gram_rows(key: np.ndarray, n: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.nulls(len(key), pa.binary()), pa.array(n), pa.array(seen)], names)

        for b in batches:
            texts, out = common.text_bytes(b.column("text")), b.column("held_out").to_pylist()
            train = [t for t, h in zip(texts, out) if h is False]
            for part, learned in ((train, True), ([t for t, h in zip(texts, out) if h is not False], False)):
                if part:
                    key, seen = np.unique(codes(part)[0], return_counts=True)
                    grams.append((key, seen if learned else np.zeros_like(seen), seen))
                    held += len(key)
            for t in train:
                words.update(t.lower().split())
            if train:
                words[END_WORD] += len(train)
            if len(words) > FLUSH_WORDS:
                yield word_rows()
                words = Counter()
            if held > FLUSH_GRAMS:
                grams = [merged()]
                held = len(grams[0][0])
                if held > FLUSH_GRAMS // 2:
                    yield gram_rows(*grams[0])
                    grams, held = [], 0
        if words:
            yield word_rows()
        if grams:
            yield gram_rows(*merged())

    counted = common.map_batches(docs.select("text", "held_out"), run, "gram bigint, word binary, n bigint, seen bigint")
    return counted.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _lgamma(x: Column) -> Column:
    y = x + 6
    down = F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - down


def _log_kt(n0: Column, n1: Column) -> Column:
    """Natural log of the Krichevsky-Trofimov block probability; exactly 0 without data."""
    return F.when(n0 + n1 == 0, F.lit(0.0)).otherwise(_lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi))


def _bits(grams: DataFrame, *more: str) -> DataFrame:
    """The eight deepest nodes of each gram: key (context bytes and decision node) and the bit taken there."""
    j = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")
    return grams.select("gram", *more, j).selectExpr(
        "gram", *more,
        "shiftleft(shiftright(gram, 8), 8) | (shiftleft(1L, j) | shiftright(gram & 255L, 8 - j)) AS key",
        "shiftright(gram & 255L, 7 - j) & 1L AS bit",
    )


def fold_trees(grams: DataFrame) -> list[DataFrame]:
    """Nodes by depth 0 .. DEPTH: key, n0, n1, weight of the node's own estimate."""
    bits = _bits(grams, "n").selectExpr("key", "n * (1 - bit) AS n0", "n * bit AS n1")
    leaf = bits.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    leaf = leaf.withColumn("log_pw", _log_kt(F.col("n0"), F.col("n1"))).withColumn("weight", F.lit(1.0))
    levels = [common.saved(leaf, f"ctw-up-{DEPTH}")]
    for d in range(DEPTH - 1, -1, -1):
        parent = levels[0].select(F.col("key").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1)).alias("key"), "n0", "n1", "log_pw")
        node = parent.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_pw").alias("below"))
        own = _log_kt(F.col("n0"), F.col("n1"))
        node = node.withColumn("own", own).select(
            "key", "n0", "n1",
            (math.log(0.5) + F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below"))))).alias("log_pw"),
            (1 / (1 + F.exp(F.least(F.col("below") - F.col("own"), F.lit(700.0))))).alias("weight"),
        )
        levels.insert(0, common.saved(node, f"ctw-up-{d}"))
    return levels


def predictions(levels: list[DataFrame]) -> DataFrame:
    """(key, p1): the probability of a 1 at every deepest node."""
    above = None
    for d, level in enumerate(levels):
        k1 = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
        if above is None:
            here = level.withColumn("up_mix", F.lit(0.0)).withColumn("up_rest", F.lit(1.0))
        else:
            up = above.select(F.col("key").alias("up"), F.col("mix").alias("up_mix"), F.col("rest").alias("up_rest"))
            here = level.withColumn("up", F.col("key").bitwiseAND(F.lit((1 << (8 * d)) - 1))).join(up, "up").drop("up")
        here = here.select("key", (F.col("up_mix") + F.col("up_rest") * F.col("weight") * k1).alias("mix"), (F.col("up_rest") * (1 - F.col("weight"))).alias("rest"))
        above = common.saved(here, f"ctw-down-{d}")
    return above.select("key", F.col("mix").alias("p1"))


def gram_scores(grams: DataFrame) -> DataFrame:
    """(gram, seen, value): log10 probability of each gram's last byte after the bytes before it."""
    nodes = predictions(fold_trees(grams))
    of = _bits(grams, "seen").join(nodes, "key")
    return of.groupBy("gram").agg(F.first("seen").alias("seen"), F.sum(F.log10(F.when(F.col("bit") == 1, F.col("p1")).otherwise(1 - F.col("p1")))).alias("value"))


class GramTable:
    """Look-up of grams: keys in hash order with the first entry of every hash value."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, len(keys).bit_length())
        h = ((keys * _K) >> np.uint64(64 - self.bits)).astype(np.uint32)
        self.first = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(h, minlength=1 << self.bits), out=self.first[1:])
        order = np.argsort(h, kind="stable")
        del h
        self.keys, self.values = keys[order], values[order]
        self.deepest = int(np.diff(self.first).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key or -1."""
        h = ((keys * _K) >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[h], self.first[h + 1]
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.deepest):
            open_ = open_[at[open_] < end[open_]]
            if not len(open_):
                break
            same = self.keys[at[open_]] == keys[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        return out

    def log10(self, code: np.ndarray) -> np.ndarray:
        """Log probability of each code's last byte after the bytes before it; ABSENT for those the table doesn't hold."""
        at = self.find(code)
        ok = at >= 0
        out = np.full(len(code), ABSENT)
        out[ok] = self.values[at[ok]]
        return out


def gram_table(scores: DataFrame, most: int) -> tuple[GramTable, int]:
    """The grams seen at least as often as the returned limit, which leaves at most `most` of them."""
    step = F.when(F.col("seen") <= 1024, F.col("seen")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("seen")))).cast("long")
    hist = sorted(((r["c"], r["k"]) for r in scores.groupBy(step.alias("c")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for c, k in hist:
        total += k
        if total > most:
            break
        least = c
    rows = scores.filter(F.col("seen") >= least).select("gram", "value").toArrow()
    return GramTable(rows["gram"].to_numpy().view(np.uint64), rows["value"].to_numpy()), least


def score_texts(docs: DataFrame, table: GramTable, frequent: dict[bytes, int], n_tokens: int, n_words: int) -> tuple[DataFrame, Broadcast]:
    """docs with n_tokens, the score over the table's grams and the base over frequent words, each with the list of all others; and what is sent to the tasks."""
    low = math.log10(n_tokens + n_words + 1)
    sent = docs.sparkSession.sparkContext.broadcast((table, {w: math.log10(c + 1) - low for w, c in frequent.items()}))

    @common.per_task
    def start():
        table, value = sent.value
        memo_key, memo = np.full(1 << MEMO_BITS, 2**64 - 1, np.uint64), np.zeros(1 << MEMO_BITS, np.float64)

        def log10(code: np.ndarray) -> np.ndarray:
            slot = ((code * _K) >> np.uint64(64 - MEMO_BITS)).astype(np.int32)
            miss = np.flatnonzero(memo_key[slot] != code)
            out = memo[slot]
            if len(miss):
                new, back = np.unique(code[miss], return_inverse=True)
                got = table.log10(new)
                out[miss] = got[back]
                s = ((new * _K) >> np.uint64(64 - MEMO_BITS)).astype(np.int32)
                memo_key[s], memo[s] = new, got
                memo_key[s[memo[s] != got]] = 2**64 - 1  # two new codes on one slot
            return out

        def work(b: pa.RecordBatch) -> list[pa.Array]:
            texts = common.text_bytes(b.column("text"))
            code, first = codes(texts)
            value_of = log10(code)
            absent = np.flatnonzero(value_of == ABSENT)
            value_of[absent] = 0.0
            score = np.add.reduceat(value_of, first)
            cuts = np.append(np.searchsorted(absent, first), len(absent)).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(cuts), pa.array(code[absent].astype(np.int64)))
            tokens, known, base, rare = [], [], [], []
            for t in texts:
                words = t.lower().split()
                words.append(END_WORD)
                got = list(map(value.get, words))
                none = got.count(None)
                tokens.append(len(words))
                known.append(len(words) - none)
                rare.append([w for w, v in zip(words, got) if v is None] if none else [])
                base.append(math.fsum(filter(None, got)))
            return [pa.array(score), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, pa.list_(pa.binary())), others]

        return work

    return common.add_columns(docs, "score double, n_tokens bigint, known bigint, part double, rare array<binary>, rare_grams array<bigint>", start).drop("text"), sent


def score_corpus(docs: DataFrame, held_out: Column, table_grams: int = TABLE_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows held out aren't learned from."""
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    counts = common.saved(count_corpus(docs), "ctw-counts")
    words = counts.filter("gram IS NULL").select("word", F.col("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    limit = max(1, -(-total // FREQUENT))  # at most FREQUENT words can occur so often
    often = words.filter(F.col("c") >= limit).toArrow()
    frequent = dict(zip(often["word"].to_pylist(), often["c"].to_pylist()))
    del often
    scores = common.saved(gram_scores(counts.filter("gram IS NOT NULL").select("gram", "n", "seen")), "ctw-grams")
    table, least = gram_table(scores, table_grams)
    scored, sent = score_texts(docs, table, frequent, total, distinct)
    scored = common.saved(scored.withColumn("row_id", F.monotonically_increasing_id()), "ctw-scored")
    sent.destroy()
    low = F.lit(math.log10(total + distinct + 1))
    asked = scored.select("row_id", F.explode("rare").alias("word"))
    others = common.saved(words.filter(F.col("c") < limit), "rare-words")
    found = asked.join(others, "word", "left").groupBy("row_id").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1) - low).alias("more"), F.count("c").alias("more_known")
    )
    left = scored.select("row_id", F.explode("rare_grams").alias("gram")).join(scores.filter(F.col("seen") < least), "gram")
    rest = left.groupBy("row_id").agg(F.sum("value").alias("rest"))
    return scored.drop("rare", "rare_grams").join(found, "row_id", "left").join(rest, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
