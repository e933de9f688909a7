"""Column functions shared by the operators; all stay inside generated code."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L


def blank_to_null(c: Column) -> Column:
    """Empty strings count as missing in every precedence chain."""
    return F.nullif(c, F.lit(""))


def arxiv_id(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d{4}\.\d{4,5})(v\d+)?", 1)


def mapped(c: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(otherwise)


#: All white space of Unicode.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def once(c: Column) -> Column:
    """A generator of one row: later filters don't copy the expression under it, so it is worked out once a row."""
    return F.explode(F.array(c))


def last_of(xs: Column, holds: Callable[[Column], Column]) -> Column:
    """The last element of an array that a condition holds for, null if there is none; it must hold for a first part of the array, whose end is found by halving."""
    step = lambda k: F.call_function("shiftleft", F.lit(1), k)
    at = F.aggregate(F.sequence(F.length(F.bin(F.size(xs))), F.lit(0), F.lit(-1)), F.lit(0), lambda n, k: F.when((n + step(k) <= F.size(xs)) & holds(F.get(xs, n + step(k) - 1)), n + step(k)).otherwise(n))
    return F.get(xs, at - 1)


def same_or_spread(key: Column, own: Column, other: Column) -> Column:
    """The join condition key = other, under which rows without a key, which match nothing, are dealt by `own` and not all to one task."""
    return (key == other) & (F.coalesce(key, own) == other)


def url_parts(url: Column) -> dict[str, Column]:
    """What key_of_parts needs of a URL; kept as columns of their own, each part is parsed once."""
    part = lambda *p: F.try_parse_url(url, *map(F.lit, p))
    return {"url_host": F.lower(F.coalesce(part("HOST"), F.lit(""))), "url_path": F.coalesce(part("PATH"), F.lit("")), "url_id": F.when(F.lower(url).contains("openreview"), part("QUERY", "id"))}


def key_of_parts() -> Column:
    """Stable paper key of a PDF URL: a tag of the host and the last piece of the path."""
    host = F.col("url_host")
    labels = F.split(host, r"\.")
    other = F.when(F.size(labels) > 1, F.try_element_at(labels, F.size(labels) - 1)).otherwise(host)
    last = F.regexp_replace(F.substring_index(F.rtrim("url_path", F.lit("/")), "/", -1), r"(?i)\.pdf$", "")
    last = F.coalesce(blank_to_null(F.substring(F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_"), 1, 60)), F.lit("paper"))
    review = F.regexp_replace(F.coalesce("url_id", F.lit("x")), "[^A-Za-z0-9_-]", "")
    return F.when(host.contains("openreview"), F.concat(F.lit("openreview-"), review)).otherwise(F.concat(mapped(host, L.HOST_TAGS, other), F.lit("-"), last))


def chart_in(low: Column) -> Column:
    """First chart class whose words occur in a lower-cased text, null when none does; a pattern runs only where one of its hints is found."""
    out = None
    for name, words in L.CHART_WORDS:
        hit = reduce(or_, map(low.contains, L.CHART_HINTS[name])) & low.rlike(words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def chart_texts(tags: Column, caption: Column) -> dict[str, Column]:
    """What chart_of_texts needs; kept as columns of their own, each text is lower-cased once."""
    return {"low_tags": F.lower(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ; ")), "low_caption": F.lower(F.coalesce(caption, F.lit("")))}


def chart_of_texts() -> Column:
    """Chart class named in the tags, else in the caption, else null."""
    return F.coalesce(chart_in(F.col("low_tags")), chart_in(F.col("low_caption")))


def chart_from_text(tags: Column, caption: Column) -> Column:
    return F.coalesce(*map(chart_in, chart_texts(tags, caption).values()), F.lit(""))


def by_letter(words: str) -> str:
    r"""A pattern (?i)\b(one|two...)\b that finds the same, its words grouped by first letter: where no word begins, none is tried."""
    head, body, tail = re.fullmatch(r"(\(\?i\)\\b)\((.*)\)((?:s\?)?\\b)", words).groups()
    groups: dict[str, list[str]] = {}
    for word in re.findall(r"(?:[^|()]|\([^()]*\))+", body):
        groups.setdefault(word[0], []).append(word[1:])
    return f"{head}(?=[{''.join(groups)}])(?:{'|'.join(k + '(?:' + '|'.join(v) + ')' for k, v in groups.items())}){tail}"


RESULT, METHOD, EXAMPLE, PROMPT = map(by_letter, (L.RESULT_WORDS, L.METHOD_WORDS, L.EXAMPLE_WORDS, L.PROMPT_WORDS))


def caption_kind(caption: Column, num: Column, page: Column, has_raster: Column, n_drawings: Column) -> Column:
    """Kind of a figure by its caption; plain conditions come before patterns, which run only where those hold."""
    result, example = caption.rlike(RESULT), caption.rlike(EXAMPLE)
    return (
        F.when(~has_raster & (n_drawings < 12) & caption.rlike(PROMPT), "prompt")
        .when((num == "1") & (page <= 2) & ~result, "teaser")
        .when(~has_raster & result, "result")
        .when(caption.rlike(METHOD), "method")
        .when(has_raster & example, "example")
        .when(result, "result")
        .when(has_raster | example, "example")
        .otherwise("other")
    )


def kind_category(kind: Column, tables: bool = False) -> Column:
    """Category of a caption kind; `tables` is mapped only where counts for the site are made."""
    return mapped(kind, L.KIND_CATEGORY | ({"table": "table"} if tables else {}), F.lit("other"))


def norm_venue(v: Column) -> Column:
    t = stripped(F.coalesce(v, F.lit("")))
    return mapped(F.lower(t), L.VENUE_ALIASES, t)


def award_rank(note: Column, source: Column) -> Column:
    """Rank of the first matching tier; 4 for other curated papers, 5 for recent ones and the rest."""
    n = F.lower(F.coalesce(note, F.lit("")))
    out = None
    for rank, _, _, words in L.AWARD_TIERS:
        out = F.when(n.rlike(words), rank) if out is None else out.when(n.rlike(words), rank)
    return out.when(n.rlike(r"\brecent \("), 5).when(source == "seed", 4).otherwise(5)


def award_label(rank: Column, note: Column, english: bool = True) -> Column:
    """Label of a rank that award_rank gave."""
    out = None
    for r, zh, en, _ in L.AWARD_TIERS:
        label = en if english else zh
        out = F.when(rank == r, label) if out is None else out.when(rank == r, label)
    return out.when(F.lower(F.coalesce(note, F.lit(""))).rlike(r"\brecent \("), "Recent" if english else "近期论文").otherwise("")


def source_of(has_sidecar: Column, note: Column, url: Column) -> Column:
    award = F.lower(F.coalesce(note, F.lit(""))).rlike("best|outstanding|distinguished|honou?rable|award")
    return F.when(~has_sidecar, "local").when(award, "award").when(F.coalesce(url, F.lit("")) != "", "seed").otherwise("local")


def title_key(title: Column, cut: int = 80, separator: str = "") -> Column:
    """Lower-case letters and digits of a title; other characters become the separator."""
    t = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", separator)
    return F.substring(F.trim(t) if separator else t, 1, cut)
