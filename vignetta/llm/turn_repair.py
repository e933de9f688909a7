"""Conversation structure repair by an auction algorithm for shortest paths.

A conversation's turns are repaired by the cheapest edits that leave role initials `(s?(ua)+)?`: Keep 0, Rerole to user or assistant 2, Delete 3
(required for blank and duplicate turns), Insert an empty user or assistant turn 2; a truncated turn that stays adds 1. The edits are arcs of a lattice
whose nodes are (turns done, state), the state being the start, after a system turn, after a user turn, after an assistant turn.

The shortest path is found by auction: nodes carry prices, starting at what the turns ahead cost at least; the path is extended from its
end over the arc of least cost plus price when that equals the end's price, otherwise the end's price rises to it and the path contracts by
a node. At the sink the path is shortest and the prices on it are exact. The trace then goes from the origin over arcs that the prices show to be tight, least
edit initial first; the auction is resumed from the arc's far end first, so its price has converged and an arc that only looked tight drops out.
Initials determine roles (a turn after the start or an assistant turn must be a user's, after a user turn an assistant's), so the ASCII-least audit is one repair.

Long conversations are cut in segments of SEGMENT turns. Each segment gives the cost from every entry to every exit state, a conversation's
segments are a lattice again whose converged prices are the exits' costs to go, and every segment is then traced from each entry state. Only two characters a turn
take part in this. Turns are ordered by range partitions, so no task holds a conversation's texts.

Turns of one conversation are in order of turn (nulls first), then role and digest of the text; turns equal in all stand together. Null roles and texts are one space, the
null conv_id is a conversation too. Duplicates are found by the least place of each (conversation, role, text). Initials other than
s, u, a can't be kept. An empty table gives no row; other columns are ignored; texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
SEGMENT = 128
BLANK, DUPLICATE, TRUNCATED, SOUND = "bdt."
END = "E"  # stands after a conversation's last turn: insertions may come before it, only a whole conversation passes
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_FAR = 1 << 60

Arcs = list[list[tuple[str, int, int]]]


def lattice(signs: str) -> Arcs:
    """Arcs (edit, cost, node) out of every node of a segment; signs has initial and fault of each turn, node 4 * i + state is before turn i."""
    turns = [(signs[i], signs[i + 1]) for i in range(0, len(signs), 2)]
    arcs: Arcs = []
    for i, (initial, fault) in enumerate(turns):
        down = 4 * (i + 1)
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for state in range(4):
            out = [(INSERT, COST[INSERT], 4 * i + _NEXT[state])]
            if initial == END:
                if state in (START, ASSISTANT):
                    out.append(("", 0, down))
            else:
                out.append((DELETE, COST[DELETE], down + state))
                if fault in (TRUNCATED, SOUND):
                    out.append((REROLE, COST[REROLE] + extra, down + _NEXT[state]))
                    if (kept := _KEPT.get(initial, {}).get(state)) is not None:
                        out.append((KEEP, COST[KEEP] + extra, down + kept))
            arcs.append(sorted(out))
    return arcs + [[] for _ in range(4)]


def least_ahead(arcs: Arcs, signs: str, exits: list[int]) -> list[int]:
    """Starting prices: what the turns ahead of a node cost at least, and the cheapest exit; nodes without a way to an exit are far from the start."""
    at_least = {BLANK: COST[DELETE], DUPLICATE: COST[DELETE], TRUNCATED: TRUNCATED_COST}
    sinks = len(arcs) - 4
    prices = [_FAR] * sinks + exits
    ahead = min(exits)
    for level in range(sinks - 4, -1, -4):
        ahead += at_least.get(signs[level // 2 + 1], 0)
        for _ in range(3):  # insertions lead on within a level
            for node in range(level, level + 4):
                if prices[node] == _FAR and any(prices[to] < _FAR for _, _, to in arcs[node]):
                    prices[node] = ahead
    return prices


def auction(arcs: Arcs, prices: list[int], origin: int, sinks: int) -> int:
    """Raise prices until a shortest path from origin to the nodes from `sinks` on (whose prices are fixed) is found; the path's length, _FAR or more if there is none."""
    path = [origin]
    while (end := path[-1]) < sinks:
        best, to = _FAR, -1
        for _, cost, node in arcs[end]:
            if (length := cost + prices[node]) < best:
                best, to = length, node
        if best >= _FAR:  # no way from here
            prices[end] = _FAR
            if len(path) == 1:
                return _FAR
            path.pop()
        elif prices[end] < best:  # contract
            prices[end] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)  # extend
    return prices[origin]


def trace(arcs: Arcs, prices: list[int], origin: int, sinks: int) -> tuple[str, int]:
    """The ASCII-least edits of a shortest path, and the sink it ends in."""
    auction(arcs, prices, origin, sinks)
    edits, at = [], origin
    while at < sinks:
        for edit, cost, node in arcs[at]:
            if prices[at] == cost + prices[node]:
                if node < sinks:
                    auction(arcs, prices, node, sinks)
                if prices[at] == cost + prices[node]:
                    edits.append(edit)
                    at = node
                    break
        else:
            raise ValueError("no way from the origin")
    return "".join(edits), at - sinks


def costs_through(signs: str) -> list[list[int]]:
    """Cost from each entry state (row) to each exit state of a segment."""
    arcs, sinks = lattice(signs), 2 * len(signs)
    table = [[_FAR] * 4 for _ in range(4)]
    for out in range(4):
        prices = least_ahead(arcs, signs, [0 if s == out else _FAR for s in range(4)])
        for state in range(4):
            table[state][out] = min(_FAR, auction(arcs, prices, state, sinks))
    return table


def repair_signs(signs: str) -> tuple[int, str]:
    """Cost and audit of one whole conversation's signs."""
    signs += END + SOUND
    arcs = lattice(signs)
    prices = least_ahead(arcs, signs, [0] * 4)
    audit, _ = trace(arcs, prices, START, 2 * len(signs))
    return prices[START], audit


def exit_costs(tables: list[list[list[int]]]) -> list[list[int]]:
    """Costs to go from the four exit states of every segment of a conversation: prices of the lattice of its segments."""
    sinks = 4 * len(tables)
    arcs: Arcs = [[("", cost, 4 * (i + 1) + out) for out, cost in enumerate(row) if cost < _FAR] for i, table in enumerate(tables) for row in table]
    prices = [0] * (sinks + 4)
    for node in reversed(range(sinks)):
        auction(arcs, prices, node, sinks)
    return [prices[4 * i : 4 * i + 4] for i in range(1, len(tables) + 1)]


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations damaged as the query's contract wants, by crc32(`conv_id:turn`) % 20; nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h")).filter("h <> 0")
    text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, place) of turns, saved; place grows in order of conversation, turn, role and digest of the text."""
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("salt")]
    # equal turns may stand in several partitions: the salt parts them, and their order doesn't matter
    dealt = rows.withColumn("salt", F.rand(7)).repartitionByRange(*order).sortWithinPartitions(*order)
    return common.saved(dealt.select("conv_id", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("place")), "repair-turns")


def faults(ordered: DataFrame) -> DataFrame:
    """(conv_id, turn, place, initial, fault) of ordered turns: the first fault that holds, or none."""
    again = ordered.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n").withColumnsRenamed({"conv_id": "_conv", "role": "_role", "digest": "_digest"})
    bare = F.rtrim("text", F.lit(SPACE))
    kind = F.when(F.octet_length(bare) == 0, BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    light = ordered.select("conv_id", "turn", "place", "role", "digest", kind.alias("kind"))
    same = light["conv_id"].eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    late = (F.col("kind") != BLANK) & (F.col("place") > F.col("first"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("-")
    return light.join(again, same, "left").select("conv_id", "turn", "place", initial.alias("initial"), F.when(late, DUPLICATE).otherwise(F.col("kind")).alias("fault"))


def segments(found: DataFrame) -> DataFrame:
    """(conv_id, segment, signs): at most SEGMENT turns each; `segment` is the place of the first."""
    part = F.shiftright("place", 33)
    rows = found.select("conv_id", "place", F.concat("initial", "fault").alias("sign")).repartition(part).sortWithinPartitions("place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, first, last, signs = None, None, None, []
        rows = []

        def out():
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], of), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["conv_id", "segment", "signs"])

        for b in batches:
            of = b.column("conv_id").type
            for c, place, sign in zip(b.column("conv_id").to_pylist(), b.column("place").to_pylist(), b.column("sign").to_pylist()):
                if first is None or c != conv or place >> 33 != last >> 33 or len(signs) == SEGMENT:
                    if first is not None:
                        rows.append((conv, first, "".join(signs)))
                    conv, first, signs = c, place, []
                signs.append(sign)
                last = place
            if len(rows) >= 1000:
                yield out()
                rows = []
        if first is not None:
            rows.append((conv, first, "".join(signs)))
        if rows:
            yield out()

    kind = found.schema["conv_id"].dataType.simpleString()
    return common.map_batches(rows, cut, f"conv_id {kind}, segment bigint, signs string")


def _solved(b: pa.RecordBatch) -> list[pa.Array]:
    got = [repair_signs(s) for s in b.column("signs").to_pylist()]
    return [pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())]


def _through(b: pa.RecordBatch) -> list[pa.Array]:
    return [pa.array([[c for row in costs_through(s) for c in row] for s in b.column("signs").to_pylist()], pa.list_(pa.int64()))]


def _traced(b: pa.RecordBatch) -> list[pa.Array]:
    """For each entry state the audit and the exit state."""
    audits, exits = [], []
    for signs, costs in zip(b.column("signs").to_pylist(), b.column("ahead").to_pylist()):
        arcs = lattice(signs)
        prices = least_ahead(arcs, signs, costs)
        got = [trace(arcs, prices, s, 2 * len(signs)) if auction(arcs, prices, s, 2 * len(signs)) < _FAR else ("", -1) for s in range(4)]
        audits.append([a for a, _ in got])
        exits.append([e for _, e in got])
    return [pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int64()))]


def _chained(b: pa.RecordBatch) -> list[pa.Array]:
    """Costs to go of a conversation's segments, whose tables come in order."""
    got = [exit_costs([[t[4 * i : 4 * i + 4] for i in range(4)] for t in tables]) for tables in b.column("tables").to_pylist()]
    return [pa.array(got, pa.list_(pa.list_(pa.int64())))]


def _walked(b: pa.RecordBatch) -> list[pa.Array]:
    """Entry states of a conversation's segments."""
    entries = []
    for exits in b.column("exits").to_pylist():
        states = [START]
        for e in exits[:-1]:
            states.append(e[states[-1]])
        entries.append(states)
    return [pa.array(entries, pa.list_(pa.int64()))]


def plans(parts: DataFrame) -> DataFrame:
    """(conv_id, segment, signs, entry, audit) of saved segments: the edits of each, from its entry state."""
    spread = Window.partitionBy("conv_id").orderBy("segment")
    last = parts.groupBy("conv_id").agg(F.max("segment").alias("last"), F.count("*").alias("n")).withColumnRenamed("conv_id", "_conv")
    rows = parts.join(last, parts["conv_id"].eqNullSafe(F.col("_conv"))).drop("_conv")
    whole = common.add_columns(rows.filter("n = 1").select("conv_id", "segment", "signs"), "cost bigint, audit string", _solved).select("conv_id", "segment", "signs", F.lit(START).cast("long").alias("entry"), "audit")
    many = rows.filter("n > 1").select("conv_id", "segment", F.when(F.col("segment") == F.col("last"), F.concat("signs", F.lit(END + SOUND))).otherwise(F.col("signs")).alias("signs"))
    many = common.saved(common.add_columns(many, "table array<bigint>", _through), "repair-tables")

    def by_segment(df: DataFrame, value: str, fn, new: str, kind: str) -> DataFrame:
        lists = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", value))).alias("s"))
        got = common.add_columns(lists.select("conv_id", F.col("s.segment").alias("segments"), F.col(f"s.{value}").alias(f"{value}s")), f"{new} array<{kind}>", fn)
        one = got.select(F.col("conv_id").alias("_conv"), F.explode(F.arrays_zip("segments", new)).alias("z")).select("_conv", F.col("z.segments").alias("_segment"), F.col(f"z.{new}").alias(new))
        return df.join(one, df["conv_id"].eqNullSafe(F.col("_conv")) & (df["segment"] == F.col("_segment"))).drop("_conv", "_segment")

    ahead = by_segment(many, "table", _chained, "ahead", "array<bigint>").select("conv_id", "segment", "signs", "ahead")
    traced = common.saved(common.add_columns(ahead, "audits array<string>, exit array<bigint>", _traced).drop("ahead"), "repair-traces")
    walked = by_segment(traced, "exit", _walked, "entry", "bigint")
    signs = F.regexp_replace("signs", END + r"\.$", "")
    return common.saved(whole.unionByName(walked.select("conv_id", "segment", signs.alias("signs"), "entry", F.get("audits", F.col("entry")).alias("audit"))), "repair-plans")


def apply_plans(ordered: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the repaired turns and of deleted ones (edit D): partitioned by conversation, in order within.

    A plan goes ahead of its segment's turns, so one shuffle of the turns is enough and a task streams them.
    """
    none = F.lit(None).cast("string")
    heads = planned.select("conv_id", F.col("segment").alias("place"), F.lit(0).alias("kind"), F.col("audit").alias("role"), none.alias("text"), "entry")
    turns = ordered.select("conv_id", "place", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("long").alias("entry"))
    stream = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {USER: "user", ASSISTANT: "assistant"}
        audit, at, tail, state = "", 0, 0, START
        for b in batches:
            of = b.column("conv_id").type
            out = []
            conv = place = None

            def inserted():
                nonlocal at, state
                while at < len(audit) and audit[at] == INSERT:
                    state = _NEXT[state]
                    out.append((conv, place, INSERT, names[state], ""))
                    at += 1

            for conv, place, kind, role, text, entry in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    audit, at, tail, state = role, 0, len(role.rstrip(INSERT)), entry
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == REROLE:
                    state = _NEXT[state]
                    role = names[state]
                elif edit == KEEP:
                    state = _KEPT[role[0]][state]
                out.append((conv, place, edit, role, text))
                if at == tail:  # a conversation's last turn may be followed by insertions
                    inserted()
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (of, pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "edit", "role", "text"])

    kind = ordered.schema["conv_id"].dataType.simpleString()
    return common.map_batches(stream.select("conv_id", "place", "kind", "role", "text", "entry"), run, f"conv_id {kind}, place bigint, edit string, role string, text string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ordered turns, plans of their segments and repaired turns of conversations (conv_id, turn, role, text)."""
    ordered = in_order(turns)
    found = common.saved(faults(ordered), "repair-faults")
    planned = plans(common.saved(segments(found), "repair-segments"))
    return found, planned, apply_plans(ordered, planned)


def text_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each conversation's `role:text` lines; repaired comes by conversation and in order, so a task streams it and holds one line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, any_, started = None, None, False, False

        def row(of):
            return pa.RecordBatch.from_arrays([pa.array([now], of), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

        of = None
        for b in batches:
            of = b.column("conv_id").type
            done = []
            for conv, edit, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text"))):
                if not started or conv != now:
                    if started:
                        done.append((now, state.hexdigest()))
                    now, state, any_, started = conv, hashlib.sha256(), False, True
                if edit != DELETE:
                    state.update(f"{chr(10) if any_ else ''}{role}:{text}".encode())
                    any_ = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], of), pa.array([x for _, x in done], pa.string())], ["conv_id", "repaired_sha256"])
        if started:
            yield row(of)

    kind = repaired.schema["conv_id"].dataType.simpleString()
    return common.map_batches(repaired, run, f"conv_id {kind}, repaired_sha256 string")


def report(turns: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row for every conversation of `turns` on what `damaged`, its damaged turns, lack and how they are repaired."""
    found, planned, repaired = repair(damaged)
    by_turn = found.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == f).alias(n) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))])
    counts = by_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated")
    )
    within = common.add_columns(planned.select("conv_id", "segment", "signs", "audit"), "illegal bigint, cost bigint, ends string", _measures)
    pieces = within.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "audit", "ends"))).alias("s"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    between = F.aggregate(F.sequence(F.lit(2), F.size("s")), F.lit(0).cast("long"), lambda n, i: n + F.when(_LEGAL(F.concat(F.right(F.get("s", i - 2)["ends"], F.lit(1)), F.substring(F.get("s", i - 1)["ends"], 1, 1))), 0).otherwise(1))
    whole = pieces.select("conv_id", (F.col("illegal") + F.when(F.size("s") > 1, between).otherwise(0)).alias("illegal"), "cost", F.array_join("s.audit", "").alias("audit"))
    out = turns.select(F.col("conv_id").alias("_all")).distinct()
    for df in (counts, whole, text_digests(repaired)):
        out = out.join(df, F.col("_all").eqNullSafe(df["conv_id"]), "left").drop("conv_id")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_all").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _LEGAL(pair):
    return pair.isin("su", "ua", "au")


def _measures(b: pa.RecordBatch) -> list[pa.Array]:
    """Illegal pairs within a segment, the cost of its edits, its first and last initial."""
    illegal, costs, ends = [], [], []
    for signs, audit in zip(b.column("signs").to_pylist(), b.column("audit").to_pylist()):
        roles = signs[::2]
        illegal.append(sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:])))
        own = [e for e in audit if e != INSERT]
        stays = sum(f == TRUNCATED and e != DELETE for e, f in zip(own, signs[1::2]))
        costs.append(sum(COST[e] for e in audit) + TRUNCATED_COST * stays)
        ends.append(roles[0] + roles[-1])
    return [pa.array(illegal, pa.int64()), pa.array(costs, pa.int64()), pa.array(ends, pa.string())]
