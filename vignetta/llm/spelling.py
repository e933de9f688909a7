"""Spelling variants by a dictionary of trie-node pairs.

Every word is a path in a trie of all words and, read backwards, in a second one. Nodes of both tries are numbered, so a
prefix or suffix of any length is one integer. A word of L code points enters the dictionary under

* (prefix node of i points, suffix node of L - i): the word parted at i, and
* (prefix node of i points, suffix node of L - 1 - i): the word with its point i skipped.

Words that meet with a skipped point on both sides differ by one replacement; a skipped point on one side and a parting on the other is
one deletion or insertion. Equal numbers are equal strings, so nothing has to be verified. All words skipped under one pair have different
points there and the same length: they are each other's neighbours, which a pair's counts and two best words give without listing
pairs. A pair thus holds one word for each letter of the alphabet at most, and one more. A deletion inside a run of equal points counts
at the run's first point only, so no link is counted twice.

Nodes are numbered in sort order: words are sorted over range partitions, and each task walks its words with the numbers of the last
path. Nodes whose words lie in several partitions are exactly the common prefixes at the partitions' borders; these few are numbered on the
driver from each partition's first and last word (one short string for WORDS_A_PART words).

Defined results: null and empty texts have no words; a null doc_id is written as the empty text; repeated rows count
as often as they stand there; ties of n go to the smaller word in code-point order; words without neighbours have n_near 0, no form, and themselves
as root; an empty table gives no row; other columns are ignored. Words may have any length: numbering and dictionary take time in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_POINTS, MIN_COUNT, RATIO = 5, 3, 2
#: One of so many runs of a document loses a point, as the query's contract wants.
DAMAGE = 97
WORDS_A_PART = 16_384
_PART_BITS = 40


def word_counts(docs: DataFrame, damage: int | None = DAMAGE, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the letter runs of whole texts; with `damage`, runs whose hash it divides lose one code point."""
    texts = docs.select("doc_id", F.translate("text", UPPER, LOWER).alias("text"))
    runs = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    if damage:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        runs = runs.withColumn("h", h)
        at = (F.col("h") % F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        runs = runs.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("run"))
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter((F.char_length("word") >= min_points) & (F.col("n") >= min_count))


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] doesn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def border_paths(ends: list[tuple[str, str]]) -> list[tuple[str, list[int]]]:
    """Left and right border of every partition: the prefix common to both sides and the negative numbers of its nodes (0: the root)."""
    paths, last = [("", [0])], 0
    for (_, before), (after, _) in pairwise(ends):
        path = after[: shared(before, after)]
        same = shared(paths[-1][0], path)
        paths.append((path, paths[-1][1][: same + 1] + [-last - i for i in range(1, len(path) - same + 1)]))
        last += len(path) - same
    return [*paths, ("", [0])]


def numbered_paths(words: DataFrame, key: str, ordered: bool, parts: int) -> DataFrame:
    """words (string column `key`, distinct) with `path`, the numbers of its trie nodes from the root on; `ordered` adds `id`, increasing in sort order, and `starts`, true where a run of equal points starts."""
    dealt = words.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id())
    rows = common.saved(dealt, "spelling-order")
    ends = sorted((r["part"], r["first"], r["last"]) for r in rows.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect())
    place = {part: i for i, (part, _, _) in enumerate(ends)}
    borders = border_paths([(first, last) for _, first, last in ends])
    keep = [c for c in rows.columns if c != "part"]
    names = [*keep, "path", *(["id", "starts"] if ordered else [])]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, path, nodes, count = None, "", [0], 0, 0
        for b in batches:
            paths, ids, starts = [], [], []
            for part, word in zip(b.column("part").to_pylist(), b.column(key).to_pylist()):
                if part != now:
                    now, before, path, nodes, count = part, "", [0], 0, 0
                    left, right = borders[place[part]], borders[place[part] + 1]
                    high = part + 1 << _PART_BITS
                path = path[: shared(before, word) + 1]
                for border, numbers in (left, right):
                    if (known := shared(border, word) + 1) > len(path):
                        path += numbers[len(path) : known]
                new = len(word) + 1 - len(path)
                path = path + list(range(high + nodes, high + nodes + new))
                nodes, before = nodes + new, word
                paths.append(path)
                if ordered:
                    ids.append(high + count)
                    count += 1
                    starts.append([x != y for x, y in zip(word, " " + word)])
            got = [pa.array(paths, pa.list_(pa.int64()))] + ([pa.array(ids, pa.int64()), pa.array(starts, pa.list_(pa.bool_()))] if ordered else [])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + got, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "part") + ", path array<bigint>" + (", id bigint, starts array<boolean>" if ordered else "")
    return common.map_batches(rows.repartition("part").sortWithinPartitions("part", key), walk, schema)


def pair_entries(words: DataFrame) -> DataFrame:
    """Dictionary rows (prefix, suffix, n, low, kind) of words (id, n, path, back, starts); low is -id, kind 0 a parting, 2 a skipped point at the start of a run, 1 another."""
    parted = F.expr("transform(path, (x, i) -> named_struct('prefix', x, 'suffix', back[size(path) - 1 - i], 'kind', 0))")
    skipped = F.expr("transform(starts, (x, i) -> named_struct('prefix', path[i], 'suffix', back[size(path) - 2 - i], 'kind', if(x, 2, 1)))")
    return words.select("id", "n", F.inline(F.concat(parted, skipped))).select("prefix", "suffix", "n", (-F.col("id")).alias("low"), "kind")


def near_words(entries: DataFrame) -> DataFrame:
    """(id, n_near, best): for each word with neighbours their number and the best, a struct of n and -id."""
    word = F.struct("n", "low", "kind")
    pairs = entries.groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(word), asc=False).alias("all")).filter("size(all) > 1").select("all")
    named = pairs.select("all", F.filter("all", lambda x: x["kind"] > 0).alias("skips"), F.filter("all", lambda x: x["kind"] == 2).alias("firsts"), F.filter("all", lambda x: x["kind"] == 0).alias("whole"))
    each = named.select("skips", "firsts", "whole", F.explode("all").alias("w"))
    value = lambda x: F.when(x.isNotNull(), F.struct(x["n"].alias("n"), x["low"].alias("low")))
    top, second = F.get("skips", F.lit(0)), F.get("skips", F.lit(1))
    other = value(F.when(top["low"] == F.col("w.low"), second).otherwise(top))
    met = F.when(F.col("w.kind") == 2, value(F.get("whole", F.lit(0))))
    is_whole = F.col("w.kind") == 0
    count = F.when(is_whole, F.size("firsts")).otherwise(F.size("skips") - 1 + F.when(F.col("w.kind") == 2, F.size("whole")).otherwise(0))
    best = F.when(is_whole, value(F.get("firsts", F.lit(0)))).otherwise(F.greatest(other, met))
    found = each.select((-F.col("w.low")).alias("id"), count.cast("long").alias("count"), best.alias("best")).filter("count > 0")
    return found.groupBy("id").agg(F.sum("count").alias("n_near"), F.max("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(id, root) for rows (id, form): forms followed to the last by doubling; a form is commoner than its word, so there is no circle."""
    now = common.saved(forms.select("id", F.col("form").alias("root")), "spelling-forms")
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        new = common.saved(now.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        done = new.filter("moved").isEmpty()
        common.discard(now)
        now = new.select("id", "root")
        now._saved_at = new._saved_at
        if done:
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n).

    A word's form is its commonest neighbour at one edit, if that is at least `ratio` (2 or more) times as common.
    """
    vocabulary = common.saved(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    parts = max(1, ceil(vocabulary.count() / WORDS_A_PART))
    ahead = common.saved(numbered_paths(vocabulary, "word", True, parts), "spelling-ahead")
    back = numbered_paths(ahead.select("id", F.reverse("word").alias("drow")), "drow", False, parts).select("id", F.col("path").alias("back"))
    near = near_words(pair_entries(ahead.select("id", "n", "path", "starts").join(back, "id")))
    judged = ahead.select("id", "word", "n").join(near, "id", "left")
    fits = F.col("best.n") >= ratio * F.col("n")
    judged = common.saved(judged.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, -F.col("best.low")).alias("form"), F.when(fits, F.col("best.n")).alias("form_n")), "spelling-judged")
    named = judged.filter("form is not null").select("id", "form").join(last_forms(judged.filter("form is not null")), "id")
    text = lambda c: judged.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    spelled = named.join(text("form"), "form").join(text("root"), "root").select("id", "form_word", "root_word")
    return judged.join(spelled, "id", "left").select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
