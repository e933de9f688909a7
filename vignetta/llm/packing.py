"""Hierarchical multi-length packing.

Documents are tokenised and routed by length to context-size tiers (512 to 4,096 tokens, each a power of two).
Full 4,096-token stretches of long documents are sequences of their own. Every tier from the longest down
opens windows for its documents; the gap that a document leaves is filled from the shorter tiers, whole
documents first (best fit) and then one cut to the exact gap, so a closed window never holds padding. A window
is opened only while enough tokens wait to fill it; what waits when a task ends becomes sequences at the
powers of two of its length, so nothing is padded. Step groups hold the same number of tokens each:
STEP_TOKENS of one tier.

Packing is local to a task: it shuffles nothing, holds a batch of documents and less than one window for
each tier, and a retried task gives the same sequences. sequence_id has the task's number in its leading bits.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each; rows with
one doc_id are told apart by nothing but their order; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

TIERS = (4096, 2048, 1024, 512)
STEP_TOKENS = 65_536
CLOSE_ID = 2
#: A task keeps the ids of so many chunks of at most so many bytes; longer ones (text without blanks) are encoded anew.
MEMO, MEMO_BYTES = 800_000, 64
_SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint, ids binary"
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_IS_ALNUM = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_IS_MARK = np.isin(np.arange(256), [c for c in range(33, 127) if not chr(c).isalnum()])
_LIBRARY: dict[str, tuple] = {}


def _encoder(path: str):
    """Ids of texts by the tokenizers library; white-space chunks are independent and memoised."""
    if path not in _LIBRARY:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LIBRARY[path] = (tok, {})
    tok, memo = _LIBRARY[path]
    marks = [(i, t.content) for i, t in tok.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.normalized)]

    def look_up(chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks; many share one call, parted by a special token, which the library splits at first."""
        found: dict[bytes, bytes] = {}
        alone = [c for c in chunks if not marks or b"<" in c or len(c) > 200]
        shared = [c for c in chunks if marks and b"<" not in c and len(c) <= 200]
        for i in range(0, len(alone), 5_000):
            some = alone[i : i + 5_000]
            for c, e in zip(some, tok.encode_batch_fast([c.decode() for c in some], add_special_tokens=False)):
                found[c] = array("I", e.ids).tobytes()
        for i in range(0, len(shared), 2_000):
            some = shared[i : i + 2_000]
            ids = np.array(tok.encode_batch_fast([marks[0][1].join([c.decode() for c in some])], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == marks[0][0])
            raw, at = ids.tobytes(), 0
            for c, cut in zip(some, [*(4 * cuts).tolist(), len(raw)]):
                found[c] = raw[at:cut]
                at = cut + 4
        return found

    def ids_of(chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks, from the memo or the library."""
        coded = list(map(memo.get, chunks))
        new = [c for c, ids in zip(chunks, coded) if ids is None]
        if not new:
            return coded
        if len(memo) + len(new) > MEMO:
            memo.clear()
        found = look_up(new)
        memo.update((c, ids) for c, ids in found.items() if len(c) <= MEMO_BYTES)
        return [found[c] if ids is None else ids for c, ids in zip(chunks, coded)]

    def encode(texts: list[bytes]) -> list[bytes]:
        # the tokenizer lower-cases and parts marks from words; doing so first only joins chunks, but special tokens are matched before it
        special = [b"<|" in t for t in texts]
        which, chunks, ends = distinct_chunks([t if s else t.lower() for t, s in zip(texts, special)], not any(special))
        coded = ids_of(chunks)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), "<u4")
        per = size[which]
        to = np.cumsum(per)
        at = np.arange(int(to[-1]) if len(to) else 0) + np.repeat((np.cumsum(size) - size)[which] - (to - per), per)
        raw = flat[at].tobytes()
        cut = [0, *(4 * np.concatenate(([0], to))[ends]).tolist()]
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    return encode


def distinct_chunks(texts: list[bytes], part_marks: bool = False) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """White-space chunks of texts: the number of each one's distinct chunk, the distinct chunks, and chunks up to each text's end.

    With part_marks a chunk also ends where an ASCII mark follows a letter or digit (ASCII or Latin-1).
    Chunks of up to 16 bytes are told apart by their first and last 8 bytes and length in one vectorised
    pass (a hash orders them, equality is checked); longer ones go through a dictionary.
    """
    joined = b"\0" * 8 + b" ".join([*texts, b""]) + b"\0" * 8
    raw = np.frombuffer(joined, np.uint8)
    space = np.concatenate(([True], _IS_SPACE[raw[8:-8]], [True]))
    start, end = 8 + np.flatnonzero(space[:-1] & ~space[1:]), 8 + np.flatnonzero(~space[:-1] & space[1:])
    if part_marks:
        latin = (raw[6:-9] == 0xC3) & (raw[7:-8] >= 0x80) & (raw[7:-8] != 0x97) & (raw[7:-8] != 0xB7)
        inner = 8 + np.flatnonzero((_IS_ALNUM[raw[7:-8]] | latin) & _IS_MARK[raw[8:-7]])
        inner = inner[inner < len(raw) - 8]
        start, end = np.sort(np.concatenate((start, inner))), np.sort(np.concatenate((end, inner)))
    text_end = 8 + np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    ends = np.searchsorted(start, text_end)
    size = end - start
    window = np.ndarray((len(raw) - 7,), ">u8", joined, 0, (1,))
    short = np.minimum(size, 8).astype(np.uint64) * np.uint64(8)
    head = window[start].astype(np.uint64) >> (np.uint64(64) - short)
    tail = window[end - 8].astype(np.uint64) & (np.uint64(2**64 - 1) >> (np.uint64(64) - short))
    key = (head * np.uint64(0x9E3779B97F4A7C15)) ^ (tail * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64))
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    rep = first[which]
    same = (head[rep] == head) & (tail[rep] == tail) & (size[rep] == size) & (size <= 16)
    chunks = [joined[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
    own: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        c = joined[start[i] : end[i]]
        if c not in own:
            own[c] = len(chunks)
            chunks.append(c)
        which[i] = own[c]
    return which, chunks, ends


class Packer:
    """Places documents of one task; `out` gets (doc, start, length, sequence, offset, tier, group)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step = tiers, step_tokens
        self.wait: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (tokens left, document, start) by tier, sorted
        self.tokens = [0] * len(tiers)
        self.next_id = 0
        self.filled = dict.fromkeys(tiers, 0)
        self.out: list[tuple] = []

    def _route(self, left: int, doc: int, start: int) -> None:
        k = max(i for i, t in enumerate(self.tiers) if left <= t)
        insort(self.wait[k], (left, doc, start))
        self.tokens[k] += left

    def add(self, doc: int, n: int) -> None:
        at, top = 0, self.tiers[0]
        while n - at >= top:
            self._close([(doc, at, top)], top)
            at += top
        if n > at:
            self._route(n - at, doc, at)

    def _close(self, pieces: list[tuple[int, int, int]], size: int) -> None:
        tier = size if size in self.filled else 0
        done = self.filled.get(tier, 0)
        self.filled[tier] = done + size
        offset = 0
        for doc, start, n in pieces:
            self.out.append((doc, start, n, self.next_id, offset, size, done // self.step))
            offset += n
        self.next_id += 1

    def _take(self, k: int, i: int) -> tuple[int, int, int]:
        got = self.wait[k].pop(i)
        self.tokens[k] -= got[0]
        return got

    def _fill(self, k: int, gap: int) -> Iterator[tuple[int, int, int]]:
        """Pieces that fill gap exactly: the best-fitting whole documents, then a cut one; shorter tiers first."""
        while gap:
            best = None
            for j in [*range(k + 1, len(self.tiers)), k]:
                i = bisect_right(self.wait[j], (gap, 1 << 62, 0)) - 1
                if i >= 0:
                    best = (j, i)
                    break
            if best:
                left, doc, start = self._take(*best)
                yield doc, start, left
                gap -= left
                continue
            j = next(j for j in [*range(k + 1, len(self.tiers)), k] if self.wait[j])
            left, doc, start = self._take(j, 0)
            yield doc, start, gap
            self._route(left - gap, doc, start + gap)
            gap = 0

    def pack(self, to_end: bool = False) -> None:
        for k, size in enumerate(self.tiers):
            while self.wait[k] and sum(self.tokens[k:]) >= size:
                left, doc, start = self._take(k, len(self.wait[k]) - 1)
                self._close([(doc, start, left), *self._fill(k, size - left)], size)
        if to_end:
            rest = [w for tier in self.wait for w in reversed(tier)]
            total = sum(w[0] for w in rest)
            while total:
                size = min(1 << (total.bit_length() - 1), self.tiers[0])
                gap, pieces = size, []
                while gap:
                    left, doc, start = rest[0]
                    n = min(left, gap)
                    pieces.append((doc, start, n))
                    rest[0] = (left - n, doc, start + n)
                    if left == n:
                        rest.pop(0)
                    gap -= n
                self._close(pieces, size)
                total -= size
            self.wait, self.tokens = [[] for _ in self.tiers], [0] * len(self.tiers)


def pack_documents(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, close_id: int = CLOSE_ID) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, its tier, step group and ids."""
    close = np.array([close_id], "<u4").tobytes()
    fields = [f.strip().split()[0] for f in _SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base = _encoder(path), Packer(tiers, step_tokens), TaskContext.get().partitionId() << 32
        held: dict[int, tuple] = {}  # documents with tokens that wait
        count = 0

        def rows() -> pa.RecordBatch:
            cols = [[] for _ in fields]
            for doc, start, n, seq, offset, tier, group in packer.out:
                doc_id, ids = held[doc]
                for c, v in zip(cols, (doc_id, start, n, len(ids) // 4, base + seq, offset, tier, base + group, ids[4 * start : 4 * (start + n)])):
                    c.append(v)
            packer.out = []
            waiting = {w[1] for t in packer.wait for w in t}
            for d in [d for d in held if d not in waiting]:
                del held[d]
            types = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], fields)

        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(common.text_bytes(b.column("text")))):
                held[count] = (doc_id, ids + close)
                packer.add(count, len(ids) // 4 + 1)
                count += 1
            packer.pack()
            yield rows()
        packer.pack(to_end=True)
        yield rows()

    return common.map_batches(docs.select("doc_id", "text"), run, _SCHEMA)
