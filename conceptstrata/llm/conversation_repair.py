"""Conversation structure repair by an auction algorithm for shortest paths.

A conversation, its rows by turn, should read as an optional system row and then pairs of user and assistant, or be
empty. Every row is kept (K, cost 0), given the other role (R, 1) or deleted (D, 2); blank rows and copies of an earlier
row must go, a truncated row that stays costs 5 more, and an empty user or assistant row may be inserted anywhere (I, 5).
The cheapest edits are a shortest path over the lattice of (rows read, state), with a node price that never exceeds the
cost still to come: prices obey p_i <= cost(i, j) + p_j. The path grows from its start along the first tight arc
(equality) in the order of the initials; where no arc is tight, the last node's price rises to its cheapest arc and
the path draws back by a node. Once the path arrives, the price of its start is the shortest distance. Prices of nodes on
the path have not changed since it passed them and prices elsewhere only rise, so arcs of cheapest paths were
tight throughout: of all cheapest edits the traced ones have the least string of initials.

Long lattices are cut into slabs, solved from the last to the first: the prices at the beginning of a slab, for each of
the four states, are the exact prices at the end of the one before it. Equal slabs are solved once per worker.

Conversations of up to `long_rows` different rows are dealt by their id. Longer ones, however large, are range
partitioned by their order into blocks of about that size: each block gives its costs between states, those of a
conversation's blocks compose into the prices at each block's end, and the traced states compose forward.

Order: by turn (nulls first), equal turns by role and text. Equal rows (id, turn, role, text) are counted before
anything else moves; all but the first are copies. Null role or text reads as one space; a null id is a conversation;
ids and turns keep their type. An empty table gives none. Other columns are not read, so names cannot clash. A long text
only ever stands in its row. Roles are compared as they are; an empty role has no initial and cannot be kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.llm.common import Scratch, short_batches, sorted_runs

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
LONG_ROWS = 100_000
SLAB = 16
INITIALS = "sua"
# States: nothing yet, after the system row, after a user, after an assistant.
INSERTED = (2, 2, 3, 2)
END_PRICES = (0, 10, 5, 0)  # after the last row: rows to insert until the conversation is complete
END_EDITS = ("", "II", "I", "")
NEVER = 1 << 60

Row = tuple[str, bool, bool, int]  # initial, must be deleted, truncated, further copies
Trace = tuple[str, int]  # edits of a slab, state at its end


def _arcs(row: Row, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial of the edit, cost, rows read, state), in the order of the initials. Copies of a row go with it."""
    initial, must_go, truncated, copies = row
    yield "D", 2 + 2 * copies, at + 1, state
    yield "I", 5, at, INSERTED[state]
    if must_go:
        return
    extra = 2 * copies + (5 if truncated else 0)
    if initial == "u" and state != 2:
        yield "K", extra, at + 1, 2
    elif initial == "a" and state == 2:
        yield "K", extra, at + 1, 3
    elif initial == "s" and state == 0:
        yield "K", extra, at + 1, 1
    yield "R", 1 + extra, at + 1, 3 if state == 2 else 2


def _auction(rows: tuple[Row, ...], ends: tuple[int, ...], prices: list[list[int]], start: int) -> Trace:
    """The path from `start` to the end of the rows; leaves the exact distance in prices[0][start]."""
    path, edits = [(0, start)], []
    while True:
        at, state = path[-1]
        if at == len(rows):
            return "".join(edits), state
        best, arc = NEVER, None
        for edit, cost, to, then in _arcs(rows[at], at, state):
            value = cost + (ends[then] if to == len(rows) else prices[to][then])
            if value < best:
                best, arc = value, (edit, to, then)
        if prices[at][state] < best:  # contract
            prices[at][state] = best
            if edits:
                path.pop()
                edits.pop()
        else:  # extend along the first tight arc
            edits.append(arc[0])
            path.append(arc[1:])


@lru_cache(maxsize=200_000)
def solve_slab(rows: tuple[Row, ...], ends: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[Trace, ...]]:
    """Exact prices at the beginning of a slab and the traces from there, per state, given the prices at its end."""
    prices = [[0] * 4 for _ in rows]
    traces = tuple(_auction(rows, ends, prices, start) for start in range(4))
    return tuple(prices[0]), traces


def solve(rows: list[Row], ends: tuple[int, ...]) -> tuple[tuple[int, ...], list[tuple[Trace, ...]]]:
    """Prices at the beginning, and the traces of every slab, in order."""
    slabs = []
    for at in reversed(range(0, len(rows), SLAB)):
        low = min(ends)  # prices may be shifted together: the cache meets equal slabs again
        ends, traces = solve_slab(tuple(rows[at : at + SLAB]), tuple(e - low for e in ends))
        ends = tuple(e + low for e in ends)
        slabs.append(traces)
    return ends, slabs[::-1]


def walk(slabs: Iterable[tuple[Trace, ...]], state: int) -> Trace:
    edits = []
    for traces in slabs:
        part, state = traces[state]
        edits.append(part)
    return "".join(edits), state


def _counted_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(ck, conv, turn, role, text, n, fault): one row for equal rows; ck is the id as text, marked where null."""
    blank = F.lit(" ")
    named = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("ck"),
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"),
    )
    counted = named.groupBy("ck", "conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    spaces = " \t\n\x0b\x0c\r"
    bare = F.rtrim(F.col("text"), F.lit(spaces))
    body = counted.withColumn("is_blank", bare == "").withColumn("is_cut", ~F.substring(bare, -1, 1).isin(".", "!", "?"))
    # The first turn of each (role, text) of a conversation. Null turns come first.
    digest = [F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2")]
    body = body.select("*", *digest)
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    firsts = body.groupBy("ck", "role", "t1", "t2").agg(F.min(at).alias("first"))
    known = body.join(firsts, ["ck", "role", "t1", "t2"])
    later = (F.col("turn").isNotNull() != F.col("first.has")) | ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("is_blank"), BLANK).when(later, DUPLICATE).when(F.col("is_cut"), TRUNCATED)
    return known.select("ck", "conv", "turn", "role", "text", "n", fault.alias("fault"))


def _lattice(table: pa.Table | pa.RecordBatch) -> list[Row]:
    roles, n, faults = (table[c].to_pylist() for c in ("role", "n", "fault"))
    initials = [r[0] if r and r[0] in INITIALS else "-" for r in roles]
    return [(i, f in (BLANK, DUPLICATE), f == TRUNCATED, k - 1) for i, f, k in zip(initials, faults, n, strict=True)]


def _illegal(initial: str, before: str | None, copies: int) -> int:
    """Pairs that do not fit: of the row and the one before it, and of its copies, which are of one role."""
    return copies + (before is not None and before + initial not in ("su", "ua", "au"))


class Edited:
    """Edited rows of one table, by their place in it; an inserted row belongs to the conversation of row `owner`."""

    def __init__(self, table: pa.Table):
        self.table, self.rows, self.roles = table, _lattice(table), table["role"].to_pylist()
        self.owner, self.take, self.edits, self.made, self.costs, self.wrong = [], [], [], [], [], []

    def add(self, at: int, edits: str, state: int, before: str | None) -> None:
        """Edits of the rows from `at` on, which begin in `state`, after a row with the initial `before`."""
        owner = at
        for edit in edits:
            if edit == "I":
                state = INSERTED[state]
                row, made, cost, wrong = None, "user" if state == 2 else "assistant", 5, 0
            else:
                initial, _, truncated, copies = self.rows[at]
                made, cost = None, 2 + 2 * copies
                if edit == "K":
                    state = 2 if initial == "u" else 3 if initial == "a" else 1
                    made, cost = self.roles[at], 2 * copies + 5 * truncated
                elif edit == "R":
                    state = 3 if state == 2 else 2
                    made, cost = "user" if state == 2 else "assistant", 1 + 2 * copies + 5 * truncated
                own = self.roles[at][:1]
                row, wrong, before = at, _illegal(own, before, copies), own
                at += 1
            self.owner.append(owner)
            self.take.append(row)
            self.made.append(made)
            self.costs.append(cost)
            self.wrong.append(wrong)
        self.edits.extend(edits)

    def result(self, part: int) -> pa.Table:
        owner, take = pa.array(self.owner, pa.int64()), pa.array(self.take, pa.int64())
        columns = {c: self.table[c].take(owner) for c in ("ck", "conv")}
        columns |= {c: self.table[c].take(take) for c in ("turn", "role", "text", "n", "fault")}
        columns |= {"edit": pa.array(self.edits, pa.string()), "new_role": pa.array(self.made, pa.string())}
        columns |= {"cost": pa.array(self.costs, pa.int64()), "illegal": pa.array(self.wrong, pa.int64())}
        columns |= {"part": pa.array(np.full(len(take), part, np.int32)), "seq": pa.array(np.arange(len(take)))}
        return pa.table(columns)


def _edit_schema(rows: DataFrame) -> T.StructType:
    schema = T.StructType(list(rows.select("ck", "conv", "turn", "role", "text", "n", "fault").schema))
    schema.add("edit", "string").add("new_role", "string").add("cost", "long").add("illegal", "long")
    return schema.add("part", "integer").add("seq", "long")


def _repair_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations, one after the other."""
    for table in sorted_runs(batches, ["ck"]):
        keys, found = table["ck"].to_pylist(), Edited(table)
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            _, slabs = solve(found.rows[a:z], END_PRICES)
            edits, state = walk(slabs, 0)
            found.add(a, edits + END_EDITS[state], 0, None)
        yield from found.result(0).combine_chunks().to_batches(max_chunksize=1000)


def _block_costs(table: pa.Table) -> pa.Table:
    """Costs of a block from state to state (16 numbers, row-wise), its first and last initial."""
    rows = _lattice(table)
    gone = sum(2 + 2 * copies for *_, copies in rows)
    system = [gone - 2 + 5 * truncated for initial, must_go, truncated, _ in rows if initial == "s" and not must_go]
    to_user, _ = solve(rows, (5, 5, 0, 5))
    to_assistant, _ = solve(rows, (10, 10, 5, 0))
    costs = [[NEVER, NEVER, to_user[q], to_assistant[q]] for q in range(4)]
    costs[0][0] = costs[1][1] = gone
    costs[0][1] = min(system, default=NEVER)
    roles = table["role"].to_pylist()
    return pa.table(
        {
            "ck": pa.array([table["ck"][0].as_py()], pa.string()),
            "part": pa.array([table["part"][0].as_py()], pa.int32()),
            "costs": pa.array([[c for row in costs for c in row]], pa.list_(pa.int64())),
            "last": pa.array([roles[-1][:1]], pa.string()),
        }
    )


def _block_ends(blocks: pd.DataFrame) -> pd.DataFrame:
    """Prices at the end of each block of a conversation, from those of all later blocks."""
    blocks = blocks.sort_values("part")
    ends, price = [], list(END_PRICES)
    for costs in reversed(blocks["costs"].tolist()):
        ends.append(price)
        price = [min(int(costs[4 * q + s]) + price[s] for s in range(4)) for q in range(4)]
    return pd.DataFrame({"ck": blocks["ck"], "part": blocks["part"], "ends": ends[::-1], "before": blocks["last"].shift(1)})


def _block_states(table: pa.Table) -> pa.Table:
    _, slabs = solve(_lattice(table), tuple(table["ends"][0].as_py()))
    states = [walk(slabs, q)[1] for q in range(4)]
    return pa.table(
        {
            "ck": pa.array([table["ck"][0].as_py()], pa.string()),
            "part": pa.array([table["part"][0].as_py()], pa.int32()),
            "ends": pa.array([table["ends"][0].as_py()], pa.list_(pa.int64())),
            "before": pa.array([table["before"][0].as_py()], pa.string()),
            "states": pa.array([states], pa.list_(pa.int32())),
        }
    )


def _block_starts(blocks: pd.DataFrame) -> pd.DataFrame:
    blocks = blocks.sort_values("part")
    starts, state = [], 0
    for states in blocks["states"]:
        starts.append(state)
        state = int(states[state])
    last = [False] * (len(blocks) - 1) + [True]
    return blocks.drop(columns="states").assign(start=np.array(starts, np.int32), last=last)


def _block_edits(table: pa.Table) -> pa.Table:
    found, start = Edited(table), table["start"][0].as_py()
    _, slabs = solve(found.rows, tuple(table["ends"][0].as_py()))
    edits, state = walk(slabs, start)
    found.add(0, edits + (END_EDITS[state] if table["last"][0].as_py() else ""), start, table["before"][0].as_py())
    return found.result(table["part"][0].as_py())


def _in_order(block):
    """A block's rows as they lie in their conversation: Spark hands on groups in any order."""

    def run(table: pa.Table) -> pa.Table:
        return block(table.sort_by([("pos", "ascending")]))

    return run


def _repair_long(rows: DataFrame, long_rows: int, scratch: Scratch) -> DataFrame:
    """Conversations that may be of any size, block by block."""
    order = [F.col("ck"), F.col("turn"), F.col("role"), F.substring("text", 1, 64)]
    count = max(1, -(-rows.count() // long_rows))
    ranged = rows.repartitionByRange(count, *order).sortWithinPartitions("ck", "turn", "role", "text")
    ranged = ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"))
    ranged = scratch.keep(ranged, "long-conversations")
    by_block = ["ck", "part"]
    narrow = ranged.select(*by_block, "pos", "role", "n", "fault")
    costs = narrow.groupBy(*by_block).applyInArrow(_in_order(_block_costs), "ck string, part int, costs array<bigint>, last string")
    ends = costs.groupBy("ck").applyInPandas(_block_ends, "ck string, part int, ends array<bigint>, before string")
    ends = scratch.keep(ends, "block-ends")
    states = narrow.join(ends, by_block).groupBy(*by_block)
    states = states.applyInArrow(_in_order(_block_states), "ck string, part int, ends array<bigint>, before string, states array<int>")
    starts = states.groupBy("ck").applyInPandas(_block_starts, "ck string, part int, ends array<bigint>, before string, start int, last boolean")
    starts = scratch.keep(starts, "block-starts")
    return ranged.join(starts, by_block).groupBy(*by_block).applyInArrow(_in_order(_block_edits), _edit_schema(rows))


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long_rows: int = LONG_ROWS
) -> DataFrame:
    """The rows of all conversations with their edits, inserted rows included.

    (ck, conv, turn, role, text, n, fault, edit, new_role, cost, illegal, part, seq): `n` equal rows, of which `edit`
    is for the first and the others are deleted; `new_role` is null for deleted rows; `illegal` counts the pairs of
    neighbours, this row being the second, whose roles do not follow each other; (part, seq) is the order in `ck`.
    """
    short_batches(rows.sparkSession)
    scratch = Scratch(rows.sparkSession)
    found = scratch.keep(_counted_rows(rows, conv, turn, role, text), "counted-rows")
    schema = _edit_schema(found)
    long = scratch.keep(found.groupBy("ck").count().where(F.col("count") > long_rows).select("ck"), "long-ids")
    dealt = found.join(long, "ck", "left_anti").repartition("ck").sortWithinPartitions("ck", "turn", "role", "text")
    short = dealt.mapInArrow(_repair_short, schema)
    if long.isEmpty():
        return short
    return short.unionByName(_repair_long(found.join(long, "ck", "left_semi"), long_rows, scratch))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ck, audit, repaired_sha256) of conversations in order: only the digest and the initials are held."""
    key, audit, digest, lines = None, [], hashlib.sha256(), 0
    done: list[tuple[str, str, str]] = []
    names = ["ck", "audit", "repaired_sha256"]

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names)

    for batch in batches:
        for ck, edit, n, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ck != key:
                if key is not None:
                    done.append((key, "".join(audit), digest.hexdigest()))
                key, audit, digest, lines = ck, [], hashlib.sha256(), 0
            audit.append(edit + "D" * ((n or 1) - 1))
            if role is not None:
                digest.update((("\n" if lines else "") + f"{role}:{text or ''}").encode())
                lines += 1
        if len(done) >= 1000:
            yield result()
            done = []
    if key is not None:
        done.append((key, "".join(audit), digest.hexdigest()))
    if done:
        yield result()


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, cost, initials of the edits, SHA-256 of the repaired lines.

    The digest of a conversation is a chain, so one task reads the conversation's edits in order, row by row; all
    counts are summed before they move.
    """
    real = F.col("edit") != "I"
    first = F.when(real, 1).otherwise(0)
    further = F.when(real, F.col("n") - 1).otherwise(0)
    sums = edits.groupBy("ck").agg(
        F.first("conv").alias("conv"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("fault") == BLANK, F.col("n")).otherwise(0)).alias(BLANK),
        F.sum(F.when(F.col("fault") == BLANK, 0).when(F.col("fault") == DUPLICATE, F.col("n")).otherwise(further)).alias(DUPLICATE),
        F.sum(F.when(F.col("fault") == TRUNCATED, first).otherwise(0)).alias(TRUNCATED),
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
    )
    ordered = edits.select("ck", "part", "seq", "edit", "n", "new_role", "text").repartition("ck").sortWithinPartitions("ck", "part", "seq")
    digests = ordered.select("ck", "edit", "n", "new_role", "text").mapInArrow(_digests, "ck string, audit string, repaired_sha256 string")
    return sums.join(digests, "ck")

