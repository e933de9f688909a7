"""Word-level language labels by a linear-chain conditional random field.

A word's features are the byte trigrams of the blank-padded word, its prefix and suffix and the word itself
(the lexicon), hashed into one table of weights by language; transitions between neighbouring words' languages are
learned with them. The field is fitted on code-switched sequences that are put together from runs of labelled
documents (at most FIT_ROWS of them, an equal share for each language; WINDOWS stretches of WINDOW words at random places of each whole text), by gradient steps on the log-likelihood. Forward-backward gives
every word's posterior; a document's language has the largest mean posterior, which is its score.

Long documents cost no more per word than short ones: words fall into segments of SEGMENT words whose
transfer matrices are multiplied for all segments at once, then segments are chained within each document.

Defined results: a text that is null or has no letter is `und` with score 0; without labelled documents all
are; one learned language labels everything else; repeated rows get equal answers; an empty table gives no row;
doc_id, lang and source of a row never enter its prediction.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FIT_ROWS = 2_000
#: A sequence has WINDOW words; so many places of a sampled text are drawn from.
WINDOWS, WINDOW = 8, 64
TABLE_BITS = 17
SEGMENT = 32
UNKNOWN = "und"
_LETTER = re.compile(rb"[A-Za-z]")
_K = np.uint64(0x9E3779B97F4A7C15)


def _slot(x: np.ndarray, family: int) -> np.ndarray:
    """Rows 1 .. 2^TABLE_BITS - 1 of the weight table; row 0 stays zero."""
    h = ((x + np.uint64(family * 0x632BE59BD9B4E019 % 2**64)) * _K) >> np.uint64(64 - TABLE_BITS)
    return np.maximum(h, np.uint64(1)).astype(np.int32)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram rows of the joined words, the first trigram of each word, and (words, 5) affix and lexicon rows."""
    pad = b"\0" * 8
    joined = b" ".join(words)
    raw = np.frombuffer(pad + b" " + joined + b" " + pad, np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    start = 9 + np.cumsum(sizes + 1) - sizes - 1
    end = start + sizes
    x = raw[: 9 + len(joined) + 1].astype(np.uint32)
    code = (x[7:-2] << 16) | (x[8:-1] << 8) | x[9:]  # ends at byte 9, 10, ...
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(32 - TABLE_BITS)
    tri = np.maximum(code, np.uint32(1)).astype(np.int32)
    tri[start - 9] = 0  # windows that lie across two words
    eight = np.ndarray((len(raw) - 7,), ">u8", raw.tobytes(), 0, (1,))
    short = np.minimum(sizes, 8).astype(np.uint64)
    head = eight[start].astype(np.uint64) >> ((np.uint64(8) - short) * np.uint64(8))
    tail = eight[end - 8].astype(np.uint64)
    keep = lambda v, k: v & ((np.uint64(1) << (np.minimum(short, np.uint64(k)) * np.uint64(8))) - np.uint64(1))
    first4 = head >> (np.maximum(short, np.uint64(4)) - np.uint64(4)) * np.uint64(8)
    whole = keep(tail, 7) * _K ^ head ^ (sizes.astype(np.uint64) << np.uint64(56))
    fixed = np.stack([_slot(first4, 2), _slot(keep(tail, 4), 3), _slot(keep(tail, 2), 4), _slot(first4 >> np.uint64(16), 5), _slot(whole, 6)], axis=1)
    return tri[1:], start - 9, fixed


def _potentials(tri: np.ndarray, first: np.ndarray, fixed: np.ndarray, weights: np.ndarray) -> np.ndarray:
    emit = np.add.reduceat(np.take(weights, tri, axis=0), first, axis=0)
    for c in range(fixed.shape[1]):
        emit += np.take(weights, fixed[:, c], axis=0)
    return emit


def emissions(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Log potentials (words, languages)."""
    return _potentials(*features(words), weights)


def forward_backward(emit: np.ndarray, offsets: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, scaled alphas and betas, and word potentials; offsets bound the documents, none of them empty."""
    k = emit.shape[1]
    pot = np.exp(emit - emit.max(axis=1, keepdims=True))
    step = np.exp(trans).astype(pot.dtype)
    lens = np.diff(offsets)
    n_segs = -(-lens // SEGMENT)
    first_seg = np.concatenate(([0], np.cumsum(n_segs)[:-1]))
    doc = np.repeat(np.arange(len(lens)), n_segs)
    start = offsets[doc] + SEGMENT * (np.arange(len(doc)) - first_seg[doc])
    size = np.minimum(SEGMENT, offsets[doc + 1] - start)
    order = np.argsort(-size, kind="stable")
    by_size, active = start[order], [int(np.searchsorted(-size[order], -t, side="left")) for t in range(SEGMENT + 1)]

    m = np.tile(np.eye(k, dtype=pot.dtype), (len(doc), 1, 1))
    for t in range(SEGMENT):
        a = active[t]
        if not a:
            break
        x = (m[:a].reshape(-1, k) @ step).reshape(a, k, k)
        x *= pot[by_size[:a] + t][:, None, :]
        if t % 4 == 3:
            x /= x.reshape(a, -1).max(axis=1)[:, None, None]
        m[:a] = x
    transfer = np.empty_like(m)
    transfer[order] = m

    into, out = np.full((len(doc), k), 1.0 / k, pot.dtype), np.ones((len(doc), k), pot.dtype)
    by_count = np.argsort(-n_segs, kind="stable")
    most = int(n_segs.max(initial=0))
    many = [int(np.searchsorted(-n_segs[by_count], -i, side="left")) for i in range(most + 1)]
    for i in range(most - 1):
        s = first_seg[by_count[: many[i + 1]]] + i
        v = np.einsum("si,sij->sj", into[s], transfer[s])
        into[s + 1] = v / v.sum(axis=1, keepdims=True)
    last_seg = first_seg + n_segs - 1
    for i in range(most - 1):
        s = last_seg[by_count[: many[i + 1]]] - i
        v = np.einsum("sij,sj->si", transfer[s], out[s])
        out[s - 1] = v / v.sum(axis=1, keepdims=True)

    alpha, beta = np.empty_like(pot), np.empty_like(pot)
    v = into[order]
    for t in range(SEGMENT):
        a = active[t]
        if not a:
            break
        x = v[:a] @ step
        x *= pot[by_size[:a] + t]
        if t % 4 == 3:
            x /= x.max(axis=1)[:, None]
        v[:a] = x
        alpha[by_size[:a] + t] = x
    v = out[order]
    for t in range(SEGMENT - 1, -1, -1):
        a = active[t]
        if not a:
            continue
        beta[by_size[:a] + t] = v[:a]
        x = (v[:a] * pot[by_size[:a] + t]) @ step.T
        v[:a] = x / x.max(axis=1)[:, None] if t % 4 == 0 else x
    post = alpha * beta
    post /= post.sum(axis=1)[:, None]
    return post, alpha, beta, pot


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, trans: np.ndarray):
        self.languages, self.weights, self.trans = languages, weights, trans


def fit(texts: list[bytes], labels: list[str], sequences: int = 2_000, length: int = WINDOW, mean_run: int = 12, batch: int = 100, epochs: int = 3, rate: float = 0.3, l2: float = 1e-5) -> Model:
    """Fit weights and transitions on sequences made of runs of words of the labelled texts."""
    words = [t.lower().split() for t in texts]
    languages = sorted({x for w, x in zip(words, labels) if w})
    k = len(languages)
    weights, trans = np.zeros((1 << TABLE_BITS, k), np.float32), np.zeros((k, k))
    pools = [[w for w, x in zip(words, labels) if x == lang and w] for lang in languages]
    if k < 2:
        return Model(languages, weights, trans)
    rng = np.random.default_rng(7)
    data = []
    for _ in range(sequences):
        seq, y = [], []
        while len(seq) < length:
            lang = int(rng.integers(k))
            doc = pools[lang][int(rng.integers(len(pools[lang])))]
            run = min(int(rng.geometric(1 / mean_run)), length - len(seq))
            at = int(rng.integers(max(1, len(doc) - run + 1)))
            got = doc[at : at + run]
            seq += got
            y += [lang] * len(got)
        data.append((seq, y))
    seen_w, seen_t = np.full_like(weights, 1e-2), np.full_like(trans, 1e-2)
    for _ in range(epochs):
        for i in range(0, len(data), batch):
            part = data[i : i + batch]
            flat = [w for s, _ in part for w in s]
            y = np.concatenate([np.array(c) for _, c in part])
            offsets = np.concatenate(([0], np.cumsum([len(s) for s, _ in part])))
            tri, first, fixed = features(flat)
            emit = _potentials(tri, first, fixed, weights)
            post, alpha, beta, pot = forward_backward(emit.astype(np.float64), offsets, trans)
            rest = post.copy()
            rest[np.arange(len(y)), y] -= 1
            word_of = np.repeat(np.arange(len(flat)), np.diff(np.append(first, len(tri))))
            rows = np.concatenate([tri, *fixed.T])
            of = np.concatenate([word_of, *[np.arange(len(flat))] * fixed.shape[1]])
            grad = np.stack([np.bincount(rows, rest[of, c], 1 << TABLE_BITS) for c in range(k)], axis=1).astype(np.float32) / len(part)
            grad[0] = 0
            inner = np.ones(len(flat), bool)
            inner[offsets[:-1]] = False
            at = np.flatnonzero(inner)
            pair = alpha[at - 1][:, :, None] * np.exp(trans)[None] * (pot[at] * beta[at])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            grad_t = pair.sum(axis=0)
            np.subtract.at(grad_t, (y[at - 1], y[at]), 1)
            grad_t /= len(part)
            grad += l2 * weights
            seen_w += grad**2
            weights -= rate * grad / np.sqrt(seen_w)
            seen_t += grad_t**2
            trans -= rate * grad_t / np.sqrt(seen_t)
    return Model(languages, weights, trans)


def _windows(b: pa.RecordBatch) -> list[pa.Array]:
    """Stretches of a text at places that its hash draws; all of a short text."""
    out = []
    for text, place in zip(common.text_bytes(b.column("text")), b.column("_hash").to_pylist()):
        words = text.split()
        at = np.random.default_rng(place).integers(0, max(1, len(words) - WINDOW + 1), WINDOWS)
        out.append([b" ".join(words[i : i + WINDOW]) for i in at.tolist()])
    return [pa.array(out, pa.list_(pa.binary()))]


def fit_sample(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most `rows` labelled documents that have words, an equal share for each language, those of the least hashes.

    Rows repeated wholly are one document. A language with more documents than its share draws twice the share and 50 more on average, so
    none that has words is left out. What comes to the driver is bounded by rows, WINDOWS and WINDOW.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("text", "lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("_hash"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("_hash", 0.02).alias("n")).collect()}
    if not sizes:
        return fit([], [])
    share = max(1, rows // len(sizes))
    # more than enough of each language pass the limit, so that ranking them costs no more than the sample
    limits = docs.sparkSession.createDataFrame([(x, int(min(1.0, (2 * share + 50) / max(1, n)) * (1 << 40))) for x, n in sizes.items()], "lang string, most long")
    drawn = usable.join(F.broadcast(limits), "lang").filter("_hash < most").drop("most")
    pieces = common.add_columns(drawn, "pieces array<binary>", _windows).drop("text").groupBy("lang", "_hash").agg(F.min("pieces").alias("pieces"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    few = pieces.withColumn("_rank", rank).filter(F.col("_rank") <= share).select("lang", "_rank", "pieces").collect()
    few.sort(key=lambda r: (r["lang"], r["_rank"]))
    return fit([bytes(p) for r in few for p in r["pieces"]], [r["lang"] for r in few for _ in r["pieces"]])


def _has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def label(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs with lang_pred, score, n_words, n_switches, and with `spans` the runs of equal labels, appended."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = "lang_pred string, score double, n_words bigint, n_switches bigint"
    if spans:
        fields += ", spans array<struct<first:bigint,words:bigint,lang:string>>"

    @common.per_task
    def start():
        model = sent.value

        def work(b: pa.RecordBatch) -> list[pa.Array]:
            texts = common.text_bytes(b.column("text"))
            words = [t.lower().split() for t in texts]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            pred, score, switches = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
            runs: list[list] = [[] for _ in texts]
            full = np.flatnonzero(sizes)
            if len(full) and model.languages:
                offsets = np.concatenate(([0], np.cumsum(sizes[full])))
                post = forward_backward(emissions([w for d in words for w in d], model.weights), offsets, model.trans)[0]
                mean = np.add.reduceat(post, offsets[:-1], axis=0) / sizes[full][:, None]
                best = post.argmax(axis=1)
                turn = np.concatenate(([0], np.cumsum(best[1:] != best[:-1])))
                for j, i in enumerate(full):
                    a, z = offsets[j], offsets[j + 1]
                    if _has_letter(texts[i]):
                        c = int(mean[j].argmax())
                        pred[i], score[i] = model.languages[c], float(min(1.0, mean[j, c]))
                        switches[i] = int(turn[z - 1] - turn[a])
                        if spans:
                            cuts = np.flatnonzero(np.concatenate(([True], best[a + 1 : z] != best[a : z - 1])))
                            runs[i] = [{"first": int(p), "words": int(q - p), "lang": model.languages[best[a + p]]} for p, q in zip(cuts, [*cuts[1:], z - a])]
            out = [pa.array(pred), pa.array(score, pa.float64()), pa.array(sizes), pa.array(switches, pa.int64())]
            if spans:
                out.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
            return out

        return work

    return common.add_columns(docs, fields, start)
