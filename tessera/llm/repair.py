"""Conversation structure repair by Hirschberg's divide and conquer over a four-state alignment.

A conversation is repaired by the cheapest edits after which the initials of its roles read
(s?(ua)+)?.  Keep costs 0, Rerole 2, Delete 3 (required for blank and duplicate rows), Insert
of an empty user or assistant row 2; a truncated row that stays adds 1.  Among the cheapest,
the edits whose initials (K, R, D, I) come first in ASCII order are taken.

Four states tell what was emitted last: nothing, s, u, a.  A *vector* holds for each state the
least cost at a row boundary and the order of the least edit strings that reach it.  Strings are compared
where they end with a row's own edit, so that none is a prefix of another and their order is enough.  A
forward vector and a backward vector meet mid-way; among the cheapest crossings the one whose
string so far is least belongs to the repair, and both halves are solved alike.  Only vectors are kept, never a table of all rows.

On Spark the same crossing is made between blocks: rows get gapless places in the order of
(conversation, turn, role, text) by ranges; a block of BLOCK places gives a 4 x 4 summary of
each conversation in it (cost and order of the strings from state to state), summaries are merged
FAN blocks at a time until every conversation is closed, and the crossings come down the same levels as
the two end states of each block.  A conversation of any length is therefore many small tasks.

Defined results: null role and text are one space, null turns come first, a null conv_id is a
conversation of its own; rows of one turn are ordered by role, then by a hash of the text, and equal rows are
duplicates of the first; a blank row is never a duplicate; an empty table gives an empty result; texts of any
length are hashed and moved, never collected; columns besides conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

BLOCK = 4096
FAN = 1024
#: Order of the four states: what was emitted last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
#: Edits per class of row: initial (s, u, a, other), must go, cut short.
SEEN = r"[^\x20\x09-\x0D]"

# ---- the alignment: a class of row is 0-15 = initial * 4 + must_go * 2 + truncated --------------


def _inserts(state: int, most: int = 2) -> Iterator[tuple[str, int]]:
    """Inserted rows before an edit, as letters and the state after them.  A third would only repeat a state."""
    letters = ""
    yield letters, state
    for _ in range(most):
        state, letters = ASSISTANT if state == USER else USER, letters + "I"
        yield letters, state


@lru_cache(None)
def steps(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state, state) -> cost and edits of one row: inserts, then the row's own edit; the cheapest, ASCII-least one."""
    initial, must_go, cut = kind // 4, kind // 2 % 2, kind % 2
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        for letters, at in _inserts(start):
            ways = [(3, "D", at)]
            if not must_go:
                ways.append((2 + cut, "R", ASSISTANT if at == USER else USER))
                if initial == 0 and at == NOTHING:
                    ways.append((cut, "K", SYSTEM))
                if (initial == 1 and at != USER) or (initial == 2 and at == USER):
                    ways.append((cut, "K", USER if initial == 1 else ASSISTANT))
            for cost, letter, to in ways:
                found = (2 * len(letters) + cost, letters + letter)
                best[start, to] = min(best.get((start, to), (NEVER, "")), found)
    return best


#: Cost and inserts from a state to a finished conversation.
ENDS = {NOTHING: (0, ""), SYSTEM: (4, "II"), USER: (2, "I"), ASSISTANT: (0, "")}

Vector = tuple[tuple[int, int], ...]  # per state: cost, order of its string (0: least)


def _start(state: int) -> Vector:
    return tuple((0, 0) if s == state else (NEVER, 0) for s in range(4))


@lru_cache(1 << 16)
def _advance(costs: Vector, kind: int) -> Vector:
    """The vector after one more row; costs are kept relative by the callers, so that few vectors occur."""
    found = []
    for to in range(4):
        ways = [(c + s[0], rank, s[1]) for p, (c, rank) in enumerate(costs) if c < NEVER and (s := steps(kind).get((p, to)))]
        found.append(min(ways, default=(NEVER, 0, "")))
    order = {key: n for n, key in enumerate(sorted({f[1:] for f in found if f[0] < NEVER}))}
    return tuple((f[0], order[f[1:]]) if f[0] < NEVER else (NEVER, 0) for f in found)


def forward(kinds: bytes, low: int, high: int, state: int) -> Vector:
    """The vector at `high` of the rows from `low`, beginning in `state`."""
    vector, base = _start(state), 0
    for k in range(low, high):
        vector = _advance(vector, kinds[k])
        least = min(c for c, _ in vector)
        if least:
            vector, base = tuple((c - least if c < NEVER else c, r) for c, r in vector), base + least
    return tuple((c + base if c < NEVER else c, r) for c, r in vector)


@lru_cache(1 << 16)
def _retreat(costs: tuple[int, ...], kind: int) -> tuple[int, ...]:
    return tuple(min((s[0] + costs[t] for t in range(4) if costs[t] < NEVER and (s := steps(kind).get((p, t)))), default=NEVER) for p in range(4))


def backward(kinds: bytes, low: int, high: int, state: int) -> list[int]:
    """Cost from each state at `low` over the rows up to `high`, ending in `state`."""
    costs, base = tuple(0 if s == state else NEVER for s in range(4)), 0
    for k in range(high - 1, low - 1, -1):
        costs = _retreat(costs, kinds[k])
        least = min(costs)
        if 0 < least < NEVER:
            costs, base = tuple(c - least if c < NEVER else c for c in costs), base + least
    return [c + base if c < NEVER else c for c in costs]


def crossing(ahead: Vector, behind: list[int]) -> int:
    """The state where the cheapest, then ASCII-least repair crosses a boundary."""
    return min((c + behind[s], rank, s) for s, (c, rank) in enumerate(ahead) if c < NEVER and behind[s] < NEVER)[2]


def hirschberg(kinds: bytes, state: int, end: int) -> list[str]:
    """Edits of each row (inserts before it included) from `state` to `end`; memory grows with the answer alone."""
    edits, todo = [], [(0, len(kinds), state, end)]
    while todo:
        low, high, p, q = todo.pop()
        if high - low == 1:
            edits.append(steps(kinds[low])[p, q][1])
        elif high > low:
            mid = (low + high) // 2
            at = crossing(forward(kinds, low, mid, p), backward(kinds, mid, high, q))
            todo += [(mid, high, at, q), (low, mid, p, at)]
    return edits


# ---- blocks: summaries go up, end states come down ------------------------------------------------


def summary(kinds: bytes) -> list[int]:
    """32 numbers of a block: cost and order of the strings from each state to each state."""
    return [x for p in range(4) for pair in forward(kinds, 0, len(kinds), p) for x in pair]


def _through(vector: Vector, block: list[int]) -> Vector:
    """The vector after a block of which only the summary is known."""
    found = []
    for to in range(4):
        ways = [
            (c + block[8 * p + 2 * to], rank, block[8 * p + 2 * to + 1])
            for p, (c, rank) in enumerate(vector) if c < NEVER and block[8 * p + 2 * to] < NEVER
        ]
        found.append(min(ways, default=(NEVER, 0, 0)))
    order = {key: n for n, key in enumerate(sorted({f[1:] for f in found if f[0] < NEVER}))}
    return tuple((f[0], order[f[1:]]) if f[0] < NEVER else (NEVER, 0) for f in found)


def merged(blocks: list[list[int]]) -> list[int]:
    """The summary of consecutive blocks."""
    out: list[int] = []
    for p in range(4):
        vector = _start(p)
        for b in blocks:
            vector = _through(vector, b)
        out += [x for pair in vector for x in pair]
    return out


def finish(block: list[int]) -> tuple[int, int]:
    """Cost and last state of a whole conversation."""
    cost, _, state = min((block[2 * s] + ENDS[s][0], block[2 * s + 1], s) for s in range(4) if block[2 * s] < NEVER)
    return cost, state


def crossings(blocks: list[list[int]], state: int, end: int) -> list[tuple[int, int]]:
    """Begin and end state of each of consecutive blocks: Hirschberg's step over their summaries."""
    behind = [[0 if s == end else NEVER for s in range(4)]]
    for b in reversed(blocks[1:]):
        after = behind[-1]
        behind.append([min((b[8 * p + 2 * t] + after[t] for t in range(4) if after[t] < NEVER), default=NEVER) for p in range(4)])
    found, vector, at = [], _start(state), state
    for b, after in zip(blocks, reversed(behind)):
        vector = _through(vector, b)
        to = crossing(vector, [min(c, NEVER) for c in after])
        found.append((at, to))
        at = to
    return found


# ---- Spark ------------------------------------------------------------------------------------------


def _blank(text: Column) -> Column:
    return ~text.rlike(SEEN)


def _truncated(text: Column) -> Column:
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def row_key(role: Column, text: Column) -> Column:
    """sha256 of role and text; the length keeps the border between them."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def conv_key(conv_id: Column) -> Column:
    """Text that orders conversations somehow and tells a null conv_id from every other."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """Stored: conv, turn, key, initial, blank, cut and a gapless `place` in the order of (conv, turn, role, key).

    Ranges are sorted apart; only the number of rows of each range passes through the driver.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    narrow = rows.select(
        conv_key(F.col("conv_id")).alias("conv"), "turn", role.alias("role"), row_key(role, text).alias("key"),
        F.substring(role, 1, 1).alias("initial"), _blank(text).alias("blank"), _truncated(text).alias("cut"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    ranges = stored(narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("role").withColumn("at", F.monotonically_increasing_id()))
    before, total = {}, 0
    for part, n in sorted(tuple(r) for r in ranges.groupBy(F.shiftright("at", 33).alias("part")).count().collect()):
        before[part], total = total, total + n
    if not before:
        return ranges.withColumn("place", F.col("at")).drop("at")
    starts = rows.sparkSession.createDataFrame([(k, v - (k << 33)) for k, v in before.items()], "part long, shift long")
    placed = ranges.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part")  # a row a range
    return placed.withColumn("place", F.col("at") + F.col("shift")).drop("part", "shift", "at")


def faults(rows: DataFrame) -> DataFrame:
    """Stored: conv, turn, key, place, kind (class of the row), fault ('blank', 'duplicate', 'truncated' or null)."""
    placed = ordered(rows)
    # a first place is a key of its own: however often a row is repeated, no join key is hot
    first = placed.where("not blank").groupBy("conv", "key").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = placed.join(first, "place", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 4).when(F.col("initial") == "a", 8).otherwise(12)
    must_go = F.col("blank") | F.col("first").isNull()
    kind = initial + F.when(must_go, 2).otherwise(0) + F.when(~must_go & F.col("cut"), 1).otherwise(0)
    return stored(marked.select("conv", "turn", "key", "place", kind.cast("int").alias("kind"), fault.alias("fault")))


NODE = "conv string, low long, high long, first int, last int, illegal long, edge boolean, summary array<long>"
NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]
#: Order of inserts after the last row of a conversation.
AFTER = 100


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _runs(convs: list[str]) -> Iterator[tuple[int, int]]:
    """Where the rows of each conversation stand among sorted rows."""
    at = 0
    for k in range(1, len(convs) + 1):
        if k == len(convs) or convs[k] != convs[at]:
            yield at, k
            at = k


def _block_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """One node a conversation of the block; `edge`: it may go on in a neighbour."""
    pdf = pdf.sort_values("place")
    convs, places, kinds = pdf["conv"].tolist(), pdf["place"].tolist(), bytes(pdf["kind"].tolist())
    out = []
    for a, b in _runs(convs):
        bad = sum(not _legal(kinds[k] // 4, kinds[k + 1] // 4) for k in range(a, b - 1))
        edge = a == 0 or b == len(convs)
        out.append((convs[a], places[a], places[b - 1], kinds[a] // 4, kinds[b - 1] // 4, bad, edge, summary(kinds[a:b])))
    return pd.DataFrame(out, columns=NODE_COLUMNS)


def _merge_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring nodes of one conversation become one; 2 x FAN nodes at most."""
    nodes = pdf[NODE_COLUMNS].sort_values("low").values.tolist()
    out = []
    for a, b in _runs([n[0] for n in nodes]):
        part = nodes[a:b]
        bad = sum(n[5] for n in part) + sum(not _legal(x[4], y[3]) for x, y in zip(part, part[1:]))
        edge = a == 0 or b == len(nodes)
        out.append((part[0][0], part[0][1], part[-1][2], part[0][3], part[-1][4], bad, edge, merged([list(n[7]) for n in part])))
    return pd.DataFrame(out, columns=NODE_COLUMNS)


def _descend(below: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """End states of merged nodes -> end states of the nodes that they were made of."""
    states = {r[0]: r[1:] for r in above[["conv", "state", "end", "closing"]].values.tolist()}
    nodes = below[["conv", "low", "summary"]].sort_values("low").values.tolist()
    out = []
    for a, b in _runs([n[0] for n in nodes]):
        state, end, closing = states[nodes[a][0]]
        for k, (p, q) in enumerate(crossings([list(n[2]) for n in nodes[a:b]], state, end), a):
            out.append((nodes[k][0], nodes[k][1], p, q, bool(closing) and k == b - 1))
    return pd.DataFrame(out, columns=["conv", "low", "state", "end", "closing"])


STATES = "conv string, low long, state int, end int, closing boolean"


def _finished(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for nodes in batches:
        costs = pd.DataFrame([finish(list(s)) for s in nodes["summary"]], columns=["cost", "end"], index=nodes.index)
        yield pd.concat([nodes[["conv", "low", "illegal"]], costs], axis=1)


def solve(marked: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv, illegal, cost; block ends: conv, low, state, end, closing) of `faults`."""
    narrow = marked.select("conv", "place", "kind").withColumn("block", F.expr(f"place div {block}"))
    levels, width = [stored(narrow.groupBy("block").applyInPandas(_block_nodes, NODE))], block
    last = marked.agg(F.max("place")).first()[0] or 0
    while last >= width:  # more than one group: what stands at the edge of a group may go on in the next
        width *= fan
        levels.append(stored(levels[-1].where("edge").groupBy(F.expr(f"low div {width}")).applyInPandas(_merge_nodes, NODE)))
    whole, ends = None, None
    # crossings come down: a closed node is a conversation, an edge is part of the node that covers it one level up
    for level, nodes in reversed(list(enumerate(levels))):
        top = level == len(levels) - 1
        closed = nodes if top else nodes.where("not edge")
        closed = stored(closed.mapInPandas(_finished, "conv string, low long, illegal long, cost long, end int"))
        found = closed.select("conv", "low", F.lit(NOTHING).alias("state"), "end", F.lit(True).alias("closing"))
        if not top:
            group = F.expr(f"low div {block * fan ** (level + 1)}").alias("g")
            pairs = nodes.where("edge").withColumn("g", group).groupBy("g").cogroup(ends.withColumn("g", group).groupBy("g"))
            # a closed node above has its parts here as edges: every edge is in exactly one node above
            found = found.unionByName(pairs.applyInPandas(_descend, STATES))
        ends = stored(found)
        whole = closed if whole is None else whole.unionByName(closed)
    return whole.select("conv", "illegal", "cost"), ends


EDITS = "conv string, place long, k int, edit string, role string, key binary"


def _block_edits(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place")
    known = {r[0]: r[1:] for r in states[["conv", "state", "end", "closing"]].values.tolist()}
    convs, places, keys, kinds = rows["conv"].tolist(), rows["place"].tolist(), rows["key"].tolist(), bytes(rows["kind"].tolist())
    out: list[tuple] = []
    for a, b in _runs(convs):
        at, end, closing = known[convs[a]]
        steps_taken = [(k, n, letter) for k, letters in enumerate(hirschberg(kinds[a:b], at, end), a) for n, letter in enumerate(letters)]
        steps_taken += [(b - 1, AFTER + n, letter) for n, letter in enumerate(ENDS[end][1] if closing else "")]
        for k, n, letter in steps_taken:
            role = None
            if letter == "K":
                at = (SYSTEM, USER, ASSISTANT)[kinds[k] // 4]
            elif letter != "D":
                at = ASSISTANT if at == USER else USER
                role = "user" if at == USER else "assistant"
            out.append((convs[k], places[k], n, letter, role, keys[k] if letter in "KR" else None))
    return pd.DataFrame(out, columns=["conv", "place", "k", "edit", "role", "key"])


def repair_edits(marked: DataFrame, ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, place, k, edit, role, key: every edit in order.  Inserts stand before the row of their place, or after the last one (k from AFTER)."""
    rows = marked.select("conv", "place", "kind", "key").groupBy(F.expr(f"place div {block}").alias("block"))
    return rows.cogroup(ends.groupBy(F.expr(f"low div {block}").alias("block"))).applyInPandas(_block_edits, EDITS)


def repair_conversations(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, edits) of `rows` (conv_id, turn, role, text).

    conversations: conv, blank, duplicate, truncated, illegal, cost; messages: conv, place, k, role, text - the
    repaired rows in order; edits: conv, place, k, edit, role, key (of the text that stays).
    """
    marked = faults(rows)
    costs, ends = solve(marked, block, fan)
    edits = stored(repair_edits(marked, ends, block))
    counts = marked.groupBy("conv").agg(*(F.sum((F.col("fault").eqNullSafe(f)).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")))
    # a kept row is the first of its role and text, so that conversation and key name one text
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    texts = (
        rows.select(conv_key(F.col("conv_id")).alias("conv"), row_key(role, text).alias("key"), role.alias("old"), text.alias("text"))
        .groupBy("conv", "key").agg(F.any_value("old").alias("old"), F.any_value("text").alias("text"))
    )
    kept = edits.where("edit in ('K', 'R')").join(texts, ["conv", "key"]).select("conv", "place", "k", F.coalesce("role", "old").alias("role"), "text")
    added = edits.where("edit = 'I'").select("conv", "place", "k", "role", F.lit("").alias("text"))
    return counts.join(costs, "conv"), kept.unionByName(added), edits


def digests(messages: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the newline-joined `role:text` of each conversation: one pass over sorted rows, in bounded memory."""
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                if conv != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.as_py().encode())
            yield pa.record_batch([[c for c, _ in done], [h for _, h in done]], schema=schema)
        if digest is not None:
            yield pa.record_batch([[at], [digest.hexdigest()]], schema=schema)

    lines = messages.select("conv", F.concat("role", F.lit(":"), "text").alias("line"), "place", "k")
    return lines.repartition("conv").sortWithinPartitions("conv", "place", "k").select("conv", "line").mapInArrow(fn, "conv string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows that the query repairs: crc32(conv_id:turn) mod 20 drops, empties, cuts, repeats or reroles; nulls are one space."""
    space = F.lit(" ")
    key = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return (
        rows.withColumn("_how", key).where("_how != 0")
        .select(
            "conv_id", "turn", F.when(F.col("_how") == 4, "user").otherwise(role).alias("role"),
            F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.expr("sequence(1, if(_how = 3, 2, 1))")).alias("_k"),
        )
        .drop("_k")
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hurt = damaged(rows)
    counts, messages, edits = repair_conversations(hurt)
    gaps = (
        hurt.groupBy(conv_key(F.col("conv_id")).alias("conv"), "turn").agg(F.lit(1).alias("one")).groupBy("conv")
        .agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    )
    # the audit of a conversation is one value of the contract: as long as its edits
    audit = edits.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "k", "edit"))).alias("e")).select("conv", F.array_join("e.edit", "").alias("audit"))
    every = rows.select("conv_id").distinct().withColumn("conv", conv_key(F.col("conv_id")))
    out = every
    for part in (gaps, counts, audit, digests(messages)):
        out = out.join(part, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return out.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
