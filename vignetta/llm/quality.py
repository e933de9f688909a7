"""Quality rules: a hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Byte n-grams of the white-space-normalised text fall into BUCKETS hash buckets. Two multinomials with add-one
smoothing are counted over them: one over the documents labelled good (at most TRUST_ROWS of them, those
with the least hashes of their id), one over all documents. A document's score is the mean log ratio of its
n-grams, so length doesn't count; documents whose score is under THRESHOLD are rejected. Nothing is drawn at random: the
verdict of a text depends on the text and the two tables only. The tables have a fixed size and travel as one small broadcast.

Defined results: null, empty and blank texts have no words, all counts zero and fail the base rules; an n-gram table without any
trusted document gives every text the score 0, which is kept; repeated rows get equal answers; an empty table gives no row;
columns other than those named are ignored or passed through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N = 5
BUCKETS = 1 << 16
TRUST_ROWS = 20_000
THRESHOLD = -0.3
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_POINTS = _SPACE + bytes(range(0x80, 0xC0))


def base_stats(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    n = len(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()] if b"\n" in text else []
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = {w for w, c in Counter(windows).items() if c > 1}
        until = 0
        for i, w in enumerate(windows):
            if w in often:
                repeat += i + 3 - max(until, i)
                until = i + 3
    return n, len(text.translate(None, _NOT_POINTS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat


def buckets(words: list[bytes], n: int = N) -> np.ndarray:
    """Hash buckets of the byte n-grams of the words joined by blanks, with a blank at both ends."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    if not words:
        return np.zeros(0, np.int64)
    if len(raw) < n:
        raw = np.pad(raw, (0, n - len(raw)))
    m = len(raw) - n + 1
    code = np.zeros(m, np.uint64)
    for i in range(n):
        code = (code << np.uint64(8)) | raw[i : i + m]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def trusted_ids(labels: DataFrame, rows: int = TRUST_ROWS) -> np.ndarray:
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    found = good.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows).collect()
    return np.array(sorted(r["doc_id"] for r in found), np.int64)


def log_ratios(docs: DataFrame, trusted: np.ndarray) -> np.ndarray:
    """log(trusted / raw) by bucket, counted over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(set(trusted.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), common.text_bytes(b.column("text"))):
                c = np.bincount(buckets(t.split()), minlength=BUCKETS) if len(t) > BUCKETS else None
                if c is None:
                    at, k = np.unique(buckets(t.split()), return_counts=True)
                    counts[1, at] += k
                    if i in sent.value:
                        counts[0, at] += k
                else:
                    counts[1] += c
                    if i in sent.value:
                        counts[0] += c
        at = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "target", "raw"])

    got = common.map_batches(docs.select("doc_id", "text"), run, "bucket bigint, target bigint, raw bigint")
    rows = got.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()  # at most BUCKETS rows
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    target[rows["bucket"]], raw[rows["bucket"]] = rows["target"], rows["raw"]
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the counts, score and verdict of every row appended."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    @common.per_task
    def start():
        weights = sent.value

        def work(b: pa.RecordBatch) -> list[pa.Array]:
            stats, failed, scores, kept = [], [], [], []
            for t in common.text_bytes(b.column("text")):
                words = t.split()
                s = base_stats(t, words)
                score = float(weights[buckets(words)].mean()) if words else 0.0
                bad = s[0] < MIN_WORDS or 100 * s[4] > 50 * s[0]
                stats.append(s)
                failed.append(bad)
                scores.append(score)
                kept.append(not bad and score >= threshold)
            return [*(pa.array(c, pa.int64()) for c in zip(*stats)), pa.array(failed), pa.array(scores, pa.float64()), pa.array(kept)]

        return work

    return common.add_columns(docs, FIELDS, start)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit the two multinomials and judge every document."""
    return judge(docs, log_ratios(docs, trusted_ids(labels)))
