"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

The merge list fixes how far to the right a token's fate can depend on the text: a token that is about to be
merged to its left may be taken by an earlier merge to its right, whose right part in turn may be taken
earlier still. `sufficient_lookahead` follows these chains in merge order and returns the longest one
in symbols. The transducer keeps a buffer of BLOCK symbols and that lookahead, merges inside the buffer,
and emits the tokens that end before the lookahead begins: they can't change any more. Words of 64 characters or more go through it symbol by symbol; shorter ones
end before the first buffer is full, so the buffer's merge alone gives their ids and nothing of them is emitted early. Texts under LONG_TEXT bytes whose chunks
are short are decoded as one block. Blocks of stable tokens are decoded as they come, so beside a document's text, ids and decoded
text, which are the operator's input and output, only buffers of fixed size are held. Words come as white-space chunks; short chunks' and
words' results are memoised in dictionaries of bounded size.

Normalising, splitting and byte symbols follow the tokenizer file: special tokens first, NFC, runs of white
space, lower case, the split pattern, then byte symbols with a word-end mark on the last. Decoding joins the
tokens' own strings by blanks where the file names no decoder.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows repeat; a
text without white space is one chunk; an empty table gives no row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

BLOCK = 512
LONG_TEXT = 1 << 20
CHUNK_CACHE = 800_000
WORD_CACHE = 400_000
_CHUNK = re.compile(rb"[^\x09-\x0d ]+")
_WHITE = "\u0009-\u000d \u0085   -     　"


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Symbols past a token's end that can still decide its fate; merges are (left, right, result) in order."""
    need: dict[int, int] = {}
    for a, b, ab in merges:
        beyond = need.get(b, 0)
        need[ab] = max(need.get(ab, 0), beyond)
        need[a] = max(need.get(a, 0), size[b] + beyond)
    return max(need.values(), default=0) + max(size.values(), default=1)


class _Bounded(dict):
    """A memo that starts anew when it is full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Tokenizer:
    """One tokenizer file: encode chunks of text to ids, decode ids to text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", _WHITE))
        self.white = re.compile(f"[{_WHITE}]+")
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.plain = [vocab.get(s) for s in byte_symbols()]
        self.last = [vocab.get(s + self.end) for s in byte_symbols()]
        self.rank: dict[int, tuple[int, int]] = {}
        size = {i: 1 for i in [*self.plain, *self.last] if i is not None}
        steps = []
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            self.rank[a << 32 | b] = (r, ab)
            size[ab] = size[a] + size[b]
            steps.append((a, b, ab))
        self.lookahead = sufficient_lookahead(steps, size)
        self.size = size
        n = max([*vocab.values(), *self.specials.values()]) + 1
        self.strings = [b""] * n
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.strings[i] = s.encode()
        self.words = _Bounded(self._word, WORD_CACHE)
        self.chunks = _Bounded(self._chunk, CHUNK_CACHE)

    # encoding

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges in rank order, leftmost first."""
        if len(ids) > 48:
            return self._merge_long(ids)
        rank = self.rank
        ranks = [rank.get(a << 32 | b) for a, b in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get(ids[at - 1] << 32 | ids[at])
            if at < len(ranks):
                ranks[at] = rank.get(ids[at] << 32 | ids[at + 1])

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1]))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank.get(ids[x] << 32 | ids[y])):
                    heapq.heappush(heap, (r[0], x, r[1], ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def stream_word(self, symbols: Iterable[int]) -> Iterator[list[int]]:
        """Transduce one word's symbols; a block of tokens comes out as soon as nothing can change it."""
        buffer: list[int] = []
        room = BLOCK + self.lookahead
        for s in symbols:
            buffer.append(s)
            if len(buffer) > room:
                tokens, stable, out = self.merge(list(buffer)), len(buffer) - self.lookahead, []
                at = 0
                for t in tokens:
                    if at + self.size[t] > stable:
                        break
                    at += self.size[t]
                    out.append(t)
                yield out
                buffer = buffer[at:]
        if buffer:
            yield self.merge(buffer)

    def _symbols(self, word: str) -> Iterator[int]:
        """Ids of a word's byte symbols, one at a time; the last one has the word-end mark."""
        before = None
        for c in word:
            for x in c.encode():
                if before is not None and self.plain[before] is not None:
                    yield self.plain[before]
                before = x
        if before is not None and self.last[before] is not None:
            yield self.last[before]

    def _word(self, word: str) -> bytes:
        """Ids of a short word: it ends before the transducer's first buffer is full, so the buffer's merge is all there is."""
        raw = word.encode()
        ids = [self.plain[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return np.array(self.merge([i for i in ids if i is not None]), "<u4").tobytes()

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def _plain(self, text: str) -> Iterator[bytes]:
        for m in self.split.finditer(self._normal(text)):
            if m.end() - m.start() < 64:
                yield self.words[m[0]]
            else:
                yield from (np.array(x, "<u4").tobytes() for x in self.stream_word(self._symbols(m[0])))

    def _pieces(self, chunk: bytes) -> Iterator[bytes]:
        """Ids of a white-space chunk as they become stable."""
        text = chunk.decode()
        if self.special is None or not self.special.search(text):
            yield from self._plain(text)
            return
        at = 0
        for m in self.special.finditer(text):
            yield from self._plain(text[at : m.start()])
            yield np.array([self.specials[m[0]]], "<u4").tobytes()
            at = m.end()
        yield from self._plain(text[at:])

    def _chunk(self, chunk: bytes) -> bytes:
        if len(chunk) < 64 and (self.special is None or not self.special.search(chunk.decode())):
            return b"".join([self.words[w] for w in self.split.findall(self._normal(chunk.decode()))])
        return b"".join(self._pieces(chunk))

    def encode_stream(self, text: bytes) -> Iterator[bytes]:
        """Blocks of ids of a text in UTF-8, each as soon as nothing that follows can change it."""
        for m in _CHUNK.finditer(text):
            c = m[0] if b"<|" in m[0] else m[0].lower()
            if len(c) < 256:  # longer chunks aren't kept
                yield self.chunks[c]
            else:
                yield from self._pieces(c)

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text in UTF-8 as little-endian unsigned 32-bit integers."""
        return b"".join(self.encode_stream(text))

    def round_trip(self, text: bytes) -> tuple[bytes, bytes]:
        """Ids and decoded text in one pass: what is stable is decoded at once, so beside both results only the buffers are held."""
        if len(text) < LONG_TEXT:  # all chunks are short: the same in fewer steps
            # lower-casing first only joins memo entries; special tokens are matched before the tokenizer lower-cases
            parts = (text if b"<|" in text else text.lower()).split()
            if max(map(len, parts), default=0) < 256:
                ids = b"".join(map(self.chunks.__getitem__, parts))
                return ids, self.decode(ids)
        ids, out, decoder = bytearray(), bytearray(), Decoder(self.strings)
        for block in self.encode_stream(text):
            ids += block
            out += decoder.feed(block).encode()
        out += decoder.close().encode()
        return bytes(ids), bytes(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text."""
        decoder = Decoder(self.strings)
        out = [decoder.feed(ids[i : i + 32_768]) for i in range(0, len(ids), 32_768)]
        return "".join([*out, decoder.close()]).encode()


class Decoder:
    """Text of ids as it becomes known: the tokens' bytes go through a UTF-8 state machine."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.machine, self.first = strings, codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, ids: bytes) -> str:
        if not ids:
            return ""
        block = b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        block, self.first = block if self.first else b" " + block, False
        return self.machine.decode(block)

    def close(self) -> str:
        return self.machine.decode(b"", True)


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One per worker process; its memo outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id with ids (little-endian unsigned 32-bit) and the decoded text of every row."""

    @common.per_task
    def start():
        tok = tokenizer(path)

        def work(b: pa.RecordBatch) -> list[pa.Array]:
            both = [tok.round_trip(t) for t in common.text_bytes(b.column("text"))]
            return [pa.array([x for x, _ in both], pa.binary()), pa.array([y for _, y in both], pa.binary()).cast(pa.string())]

        return work

    return common.add_columns(docs.select("doc_id", "text"), "ids binary, decoded string", start).drop("text")
