"""Tool-call linking: join calls with results, order them, check arguments, serialise canonical JSON.

Identifiers are unique within a conversation only, so calls and results meet in shuffled hash joins on (conversation, identifier);
both sides are first reduced to one row for each key by a hash aggregate, so a repeated identifier doesn't
multiply rows. Dependencies between the calls of a conversation are edges. Where every edge points to an earlier turn, (turn, row) is already
a topological order. Conversations with other edges are ordered by peeling off calls that wait for
nothing: in one task each if they have at most GROUP_CALLS edges, else in rounds over tables with the same result. What never becomes free
is in or behind a cycle. Arguments are parsed as variants and checked against a schema of each tool: unknown tool, no JSON object,
missing, unexpected or wrongly typed fields. Canonical JSON has sorted keys and no blanks.

Defined results: a null identifier links to nothing (status `no_id`); of calls with one key the first (turn, then row; a null turn first)
counts and the others are `duplicate`, with no result and no edges; of results with one key the first counts; a result without call is an
`orphan_result` row; an edge to an unknown call is ignored, one to a null turn waits for it; a null conv_id is a conversation of its own; null
or broken arguments are invalid, not an error; long texts are rows like any other; an empty table gives no row; columns other than those named are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

GROUP_CALLS = 20_000
#: Fields of each tool's arguments as (type, required).
SCHEMAS = {
    "search": {"limit": ("BIGINT", True), "query": ("STRING", True), "site": ("STRING", False)},
    "lookup": {"key": ("STRING", True), "strict": ("BOOLEAN", False)},
}


def _problem(name: Column, args: Column, schemas: dict) -> Column:
    """The first thing wrong with a call's arguments, null when they fit."""
    kind = F.schema_of_variant(args)
    per_tool = []
    for tool, fields in schemas.items():
        checks = []
        for f, (want, required) in sorted(fields.items()):
            value = F.try_variant_get(args, f"$.{f}", "variant")
            if required:
                checks.append(F.when(value.isNull(), F.lit(f"missing {f}")))
            checks.append(F.when(value.isNotNull() & (F.schema_of_variant(value) != want), F.lit(f"type of {f}")))
        names = F.map_keys(F.try_variant_get(args, "$", "map<string,variant>"))
        extra = F.array_except(names, F.array(*[F.lit(f) for f in sorted(fields)]))
        checks.append(F.when(F.size(extra) > 0, F.concat(F.lit("unexpected "), F.array_min(extra))))
        per_tool.append(F.when(name == tool, F.coalesce(*checks)))
    return F.when(args.isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object").when(name.isNull() | ~name.isin(*schemas), "unknown tool").otherwise(F.coalesce(*per_tool))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with `key` (conversation and identifier, null without one) and `at`, a number that grows with (turn, row).

    A fixed-width `at` lets a hash aggregate find the first row of each key.
    """
    rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    at = F.coalesce("turn", F.lit(-(1 << 31))).cast("decimal(17,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + F.col("row_id").cast("decimal(20,0)")
    return rows.withColumns({"key": _key("call_id"), "at": at.cast("decimal(38,0)")}).drop("row_id")


def _key(call_id) -> Column:
    return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("\0"), call_id)


def _hashed(df: DataFrame) -> DataFrame:
    return df.hint("shuffle_hash")


def _levels(pairs: list[tuple[str, str]], held: set[str]) -> dict[str, int]:
    """Round of every call that `held` and the edges (call, what it waits for) of one conversation hold back; -1 in or behind a cycle."""
    waits, after = {}, {}
    for c, d in pairs:
        waits.setdefault(c, set()).add(d)
        after.setdefault(d, []).append(c)
    todo = list(held)
    while todo:
        for c in after.get(todo.pop(), ()):
            if c not in held:
                held.add(c)
                todo.append(c)
    left = {c: len(waits.get(c, set()) & held) for c in held}
    level = {c: 1 for c in held if not left[c]}
    todo = list(level)
    for c in todo:  # grows while it is walked
        for n in set(after.get(c, ())) & held:
            left[n] -= 1
            if not left[n]:
                level[n] = level[c] + 1
                todo.append(n)
    return {c: level.get(c, -1) for c in held}


def _order_small(edges: DataFrame) -> DataFrame:
    """(key, round) for conversations of bounded size, each in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _levels(list(zip(pdf["key"], pdf["dep"])), set(pdf["key"][pdf["late"]]))
        return pd.DataFrame({"key": list(found), "round": list(found.values())})

    return edges.groupBy("conv_id").applyInPandas(run, "key string, round int")


def _order_large(edges: DataFrame) -> DataFrame:
    """(key, round) by rounds over tables, for conversations of any size."""
    edges = common.saved(edges.select("key", "dep", "late"), "call-edges")
    held = common.saved(edges.filter("late").select("key").distinct(), "calls-held")
    while True:  # whatever depends on a held call is held as well
        more = edges.join(_hashed(held.withColumnRenamed("key", "dep")), "dep", "left_semi").select("key")
        grown = common.saved(held.unionByName(more).distinct(), "calls-held")
        done = grown.count() == held.count()
        common.discard(held)
        held = grown
        if done:
            break
    waiting, out, r = held, held.limit(0).withColumn("round", F.lit(0)), 1
    while True:
        blocked = edges.join(_hashed(waiting), "key", "left_semi").join(_hashed(waiting.withColumnRenamed("key", "dep")), "dep", "left_semi").select("key").distinct()
        free = common.saved(waiting.join(_hashed(blocked), "key", "left_anti"), "calls-free")
        if free.isEmpty():
            return out.unionByName(waiting.withColumn("round", F.lit(-1)))
        out = out.unionByName(free.withColumn("round", F.lit(r)))
        left = common.saved(waiting.join(_hashed(free), "key", "left_anti"), "calls-waiting")
        common.discard(waiting)
        waiting, r = left, r + 1


def _late(calls: DataFrame, most: int) -> DataFrame:
    """(late_key, round) of calls that an edge to the same or a later turn holds back; round -1: in or behind a cycle."""
    turns = calls.select(F.col("key").alias("dep"), F.col("turn").alias("dep_turn"))
    edges = calls.select("conv_id", "key", "turn", F.explode(F.array_distinct("after")).alias("to")).withColumn("dep", _key("to"))
    known = edges.join(_hashed(turns), "dep").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), "key", "dep", F.coalesce(F.col("dep_turn") >= F.col("turn"), F.lit(True)).alias("late"))
    known = common.saved(known, "call-deps")
    sizes = common.saved(known.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("late").alias("any")).filter("any"), "call-sizes")
    out = _order_small(known.join(_hashed(sizes.filter(F.col("n") <= most)), "conv_id", "left_semi"))
    large = sizes.filter(F.col("n") > most)
    if not large.isEmpty():
        out = out.unionByName(_order_large(known.join(_hashed(large), "conv_id", "left_semi")))
    return out.withColumnRenamed("key", "late_key")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS, group_calls: int = GROUP_CALLS) -> DataFrame:
    """conv_id, turn, call_id, name, status, problem, round, json for every call and every result without call.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after (array of call ids of the same conversation);
    results: conv_id, turn, call_id, content. Sorting a conversation by (round, turn) runs it in order.
    """
    common.bound_batches(calls.sparkSession)
    calls = common.saved(_keyed(calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")), "calls")
    results = common.saved(_keyed(results.select("conv_id", "turn", "call_id", "content").filter("call_id IS NOT NULL")), "results")
    first = common.saved(calls.filter("key IS NOT NULL").groupBy("key").agg(F.min("at").alias("at")), "calls-first")
    first_result = results.groupBy("key").agg(F.min("at").alias("at"))
    answer = results.join(_hashed(first_result), ["key", "at"], "left_semi").select("key", F.struct("conv_id", "turn", "call_id", "content").alias("a"))
    late = common.saved(_late(calls.join(_hashed(first), ["key", "at"], "left_semi"), group_calls), "calls-late")
    args = F.try_parse_json("arguments")
    joined = calls.join(_hashed(first.withColumnRenamed("at", "first_at")), "key", "left").join(_hashed(answer), "key", "left").join(_hashed(late), F.col("key") == F.col("late_key"), "left")
    counts = F.col("at") == F.col("first_at")
    status = (
        F.when(F.col("key").isNull(), "no_id").when(~counts, "duplicate").when(F.col("round") == -1, "cycle").when(F.col("a").isNull(), "no_result")
        .when(F.col("a.turn") < F.col("turn"), "result_first").otherwise("linked")
    )
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json(args), F.lit("null")), F.lit(',"id":'), F.coalesce(_quoted("call_id"), F.lit("null")),
        F.lit(',"name":'), F.coalesce(_quoted("name"), F.lit("null")), F.lit(',"result":'), F.coalesce(F.when(counts, _quoted("a.content")), F.lit("null")), F.lit("}"),
    )
    ordered = F.when(F.coalesce(counts, F.lit(False)), F.coalesce("round", F.lit(0))).otherwise(0).alias("round")
    out = joined.select("conv_id", "turn", "call_id", "name", status.alias("status"), _problem(F.col("name"), args, schemas).alias("problem"), ordered, json.alias("json"))
    lone = answer.join(_hashed(first), "key", "left_anti").select(
        "a.conv_id", "a.turn", "a.call_id", F.lit(None).cast("string").alias("name"), F.lit("orphan_result").alias("status"), F.lit(None).cast("string").alias("problem"), F.lit(0).alias("round"),
        F.concat(F.lit('{"arguments":null,"id":'), _quoted("a.call_id"), F.lit(',"name":null,"result":'), F.coalesce(_quoted("a.content"), F.lit("null")), F.lit("}")).alias("json"),
    )
    return out.unionByName(lone)


def _quoted(col: str) -> Column:
    """A string as JSON text, null for null."""
    return F.when(F.col(col).isNotNull(), F.regexp_extract(F.to_json(F.struct(F.col(col).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off a chat: a user turn is a call, the next assistant turn its result.

    The tool, its arguments and some faulty ones follow from the turn's words, as do some edges that point to the next call.
    """
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    name_of = lambda back: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    search = F.to_json(F.struct(F.when(words % 7 != 0, F.substring_index("text", " ", 6)).alias("query"), words.cast("long").alias("limit"), F.when(words % 11 == 0, F.lit(True)).alias("page")))
    lookup = F.to_json(F.struct(F.when(words % 5 == 0, F.lit("yes")).alias("strict"), F.substring_index("text", " ", 1).alias("key")))
    users = conversations.filter("role = 'user'")
    calls = users.select(
        "conv_id", "turn", name_of(0).alias("call_id"), F.when(words % 3 == 0, "lookup").otherwise("search").alias("name"),
        F.when(words % 13 == 0, F.substring_index("text", " ", 2)).when(words % 3 == 0, lookup).otherwise(search).alias("arguments"),
        F.when(words % 17 == 0, F.array(name_of(-2))).when(F.col("turn") >= 2, F.array(name_of(2))).otherwise(F.expr("cast(array() as array<string>)")).alias("after"),
    )
    results = conversations.filter("role = 'assistant'").select("conv_id", "turn", name_of(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
