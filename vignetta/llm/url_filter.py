"""URL filter: rules by longest fit, and for the rest a blocked Bloom filter in front of an exact join.

Listed URLs are brought to a canonical form and set eight bits each, one in every 64-bit word of one 512-bit
block. The filter has at most MAX_BLOCKS blocks (8 MB), so its broadcast is bounded whatever the list's
length. Only URLs whose eight bits are all set go to the exact hash join on the canonical URL, which removes
the false positives. Everything is built of DataFrame functions.

Defined results: a null URL and one without "://" have empty host and path, fit no rule and are never listed;
rows repeat as they come; an empty list blocks nothing; rule ties in length go to block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 8
MAX_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Host labels whose pages make up the registered query's list.
LISTED_LABELS = ("casino-win", "free-bets", "cheap-pills", "ads-track")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., m. or blog., path without a closing slash or .html; null without a host."""
    bare = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html|/)$", "")))


def _best_rule(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block"))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(value(r))) for r in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block, from six-bit pieces of a second hash."""
    h = F.xxhash64(key, F.lit(1))
    pieces = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in pieces]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w7): at most n_blocks rows."""
    bits = _bits(F.col("canon"))
    marked = listed.select(F.pmod(F.xxhash64("canon"), F.lit(n_blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every page; `listed` has the column canon."""
    listed = common.saved(listed.select("canon").filter("canon IS NOT NULL").distinct(), "listed-urls")
    n, n_blocks = listed.count(), 1
    while n_blocks < MAX_BLOCKS and n_blocks * KEYS_PER_BLOCK < n:
        n_blocks *= 2
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("canon", canonical(F.col("host"), F.col("path")))
    blocks = F.broadcast(bloom_blocks(listed, n_blocks))  # at most MAX_BLOCKS rows of 72 bytes
    tested = parts.withColumn("block", F.pmod(F.xxhash64("canon"), F.lit(n_blocks))).join(blocks, "block", "left")
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("canon"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) == b)
    tested = tested.select("page_id", "host", "path", "canon", F.coalesce(hit & F.col("canon").isNotNull(), F.lit(False)).alias("possible"))
    passed = tested.filter("possible").join(listed.withColumn("listed", F.lit(True)), "canon", "left").select("page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed"))
    clear = tested.filter(~F.col("possible")).select("page_id", "host", "path", F.lit(False).alias("listed"))
    both = passed.unionByName(clear)
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(_best_rule(host, path, rules, lambda r: r.verdict), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return both.select("page_id", "host", "path", _best_rule(host, path, rules, lambda r: r.name).alias("rule"), verdict.alias("verdict"), "listed")


def labelled_hosts(pages: DataFrame, labels: tuple[str, ...] = LISTED_LABELS) -> DataFrame:
    """Canonical URLs of the pages with one of the labels in their host."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.filter(F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(x) for x in labels]))).select(canonical(host, path).alias("canon"))
