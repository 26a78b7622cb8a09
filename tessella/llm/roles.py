"""Minimum-cost role repair of conversations: dynamic programming over an automaton of legal turns.

A legal conversation is an optional system turn, then user and assistant turns in alternation, beginning with the user
and ending with the assistant. Each turn that is there is kept (free), relabelled to another role, or merged into the
turn before it (the roles may differ, then the merge also costs a relabelling); where the automaton needs a turn in
between, an empty one is inserted. The cheapest whole repair is taken; among equally cheap ones the first in the order
of the choices below. The repaired turns are rendered with role marks.

A conversation's turns are numbered in their order and cut into blocks of `BLOCK`. The costs of all ways through a block,
by the state before and after it, are one small matrix; matrices are combined in the (min, +) sense, first those of
`GROUP` blocks and then those of the groups, which gives the states at the ends of each, and then each block is repaired
by itself. So a conversation as long as you like is repaired by many tasks, and what meets in one task is a block's
turns, a group's matrices, or one matrix for each group.

Numbers come from a sort of all turns by ranges, which cuts through conversations where they are long: turns are counted
within each range, and a range that begins inside a conversation adds what the ranges before it have of that one.

Turns are ordered by (turn, role, hash of role and text). Nulls: a null role is an unknown role, relabelled; a null text
is empty; a null turn comes last; all turns of a null conv_id are one conversation. Unknown roles are any other strings;
names that mean a known role (`ALIASES`) count as it. Repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import small_batches, stored

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "ai": "assistant", "model": "assistant", "gpt": "assistant"}
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 2, 3, 4
FAR = 1 << 40
#: Turns in a block, and blocks in a group.
BLOCK, GROUP = 1024, 1024
LAST = 1 << 50
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def shortest_insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns between a state and a turn of a role that may follow, by (state, role)."""
    out = {}
    for state in range(4):
        todo = [(state, ())]
        while todo:
            at, path = todo.pop(0)
            for role in LEGAL[at]:
                if (state, role) not in out:
                    out[state, role] = path
                    todo.append((role, (*path, role)))
    return out


INSERTIONS = shortest_insertions()
#: To end a conversation from a state: at the assistant.
ENDINGS = {s: () if s == ASSISTANT else (*INSERTIONS[s, ASSISTANT], ASSISTANT) for s in range(4)}


def known_role(role: Column) -> Column:
    """The number of a role, -1 for unknown ones."""
    name = F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), r"^\s+|\s+$", ""))
    number = F.lit(-1)
    for i, known in enumerate(ROLES, 1):
        number = F.when(name.isin(known, *(a for a, r in ALIASES.items() if r == known)), i).otherwise(number)
    return number.cast("int")


def moves(state: int, role: int) -> Iterator[tuple[int, int, str]]:
    """(next state, cost, action) for a turn of a role after a state, in the order of preference."""
    wanted = [role, *(r for r in (USER, ASSISTANT, SYSTEM) if r != role)] if role > 0 else [USER, ASSISTANT, SYSTEM]
    for r in wanted:
        if (state, r) in INSERTIONS:
            yield r, INSERT * len(INSERTIONS[state, r]) + (RELABEL if r != role else 0), "keep" if r == role else "relabel"
        if r == wanted[0] and state != START:
            yield state, MERGE + (RELABEL if state != role else 0), "merge"


MOVES = {(s, r): list(moves(s, r)) for s in range(4) for r in (-1, 1, 2, 3)}


def through_turn(role: int) -> np.ndarray:
    """Least costs through a turn of this role, by state before and after."""
    cost = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        for t, c, _ in MOVES[s, role]:
            cost[s, t] = min(cost[s, t], c)
    return cost


THROUGH = {r: through_turn(r) for r in (-1, 1, 2, 3)}


def combined(matrices: list[np.ndarray]) -> np.ndarray:
    """Least costs through all of these, one after the other."""
    cost = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(cost, 0)
    for m in matrices:
        cost = np.minimum((cost[:, :, None] + m).min(1), FAR)
    return cost


def states_between(matrices: list[np.ndarray], begin: int, end: int | None) -> list[tuple[int, int]]:
    """The states before and after each matrix on the cheapest way from begin to end (None: to a legal ending)."""
    ahead = [ending_costs(end)]
    for m in reversed(matrices):
        ahead.append(np.minimum((m + ahead[-1]).min(1), FAR))
    ahead.reverse()
    out, state = [], begin
    for i, m in enumerate(matrices):
        after = int((m[state] + ahead[i + 1]).argmin())
        out.append((state, after))
        state = after
    return out


def ending_costs(end: int | None) -> np.ndarray:
    return np.array([INSERT * len(ENDINGS[s]) if end is None else 0 if s == end else FAR for s in range(4)], np.int64)


def repair(roles: list[int], begin: int, end: int | None) -> list[tuple[int, str, tuple[int, ...]]]:
    """The cheapest way from state to state (None: to a legal ending): for each turn its state, action and the roles
    inserted before it."""
    ahead = [ending_costs(end).tolist()]
    for role in reversed(roles):
        ahead.append([min((c + ahead[-1][t] for t, c, _ in MOVES[s, role]), default=FAR) for s in range(4)])
    ahead.reverse()
    out, state = [], begin
    for i, role in enumerate(roles):
        for t, c, action in MOVES[state, role]:
            if c + ahead[i + 1][t] == ahead[i][state]:
                out.append((t, action, () if action == "merge" else INSERTIONS[state, t]))
                state = t
                break
    return out


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, role, text) with their task and their place among the conversation's rows in it."""
    part, key, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        null = b.column(0).is_null().to_numpy(zero_copy_only=False)
        ids, index = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.arange(b.num_rows)
        new = np.append(key != (ids[0], null[0]), (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]))
        begin = np.maximum.accumulate(np.where(new, index, -seen if not new[0] else 0))
        at = index - begin
        key, seen = (ids[-1], null[-1]), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(at.astype(np.int64))], ["conv_id", "role", "text", "part", "at"])


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, block, at, role, text): the turns with their numbers in the conversation, from 0, and these's blocks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"), known_role(F.col("role")).alias("role"),
        F.xxhash64(F.coalesce(F.col("role"), F.lit("")), text).alias("mark"), F.monotonically_increasing_id().alias("row"), text.alias("text"),
    )
    order = ["conv_id", "turn", "role", "mark", "row"]
    by_range = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    placed = stored(by_range.mapInArrow(places, "conv_id long, role int, text string, part int, at long"), "turns")
    # Only the conversation that a range begins with can have turns before it, so there is a row a range at most.
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = counts.select(F.col("conv_id").alias("of"), F.col("part").alias("begun"), before.alias("before")).where("before > 0")
    both = placed.join(F.broadcast(earlier), (F.col("part") == F.col("begun")) & F.col("conv_id").eqNullSafe(F.col("of")), "left")
    at = F.col("at") + F.coalesce("before", F.lit(0))
    return both.select("conv_id", at.alias("at"), "role", "text").select("conv_id", F.expr(f"at div {BLOCK}").alias("block"), "at", "role", "text")


def grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with the same first two values, which come one after the other."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(columns)), strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield key, rows


def batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def square(costs: list[int]) -> np.ndarray:
    return np.array(costs, np.int64).reshape(4, 4)


def block_states(rows: DataFrame) -> DataFrame:
    """(conv_id, block, begin, end, last) of the blocks of conversations that fill one: the states at their ends."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("at", "role"))), lambda x: x["role"])
    full = rows.groupBy("conv_id", "block").agg(turns.alias("items")).where((F.col("block") > 0) | (F.size("items") == BLOCK))

    def products(name: str, of) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(conv, at, combined([of(x) for x in items]).ravel().tolist()) for conv, at, items in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                if out:
                    yield batch(out, [pa.int64(), pa.int64(), pa.list_(pa.int64())], ["conv_id", name, "costs"])

        return run

    blocks = stored(full.mapInArrow(products("block", THROUGH.__getitem__), "conv_id long, block long, costs array<long>"), "turn-costs")
    lists = blocks.groupBy("conv_id", F.expr(f"block div {GROUP}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("block", "costs"))).alias("items"))
    matrices = lists.select("conv_id", "part", F.transform("items", lambda x: x["costs"]).alias("items"))
    groups = matrices.mapInArrow(products("part", square), "conv_id long, part long, costs array<long>")
    tops = groups.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "costs"))).alias("items"))
    tops = tops.select("conv_id", "items", F.lit(START).alias("begin"), F.lit(None).cast("int").alias("end"), F.lit(True).alias("last"))

    def ends(name: str) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for conv, items, begin, end, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    found = states_between([square(x["costs"]) for x in items], begin, end)
                    out += [(conv, x[name], s, t, last and i == len(items) - 1) for i, (x, (s, t)) in enumerate(zip(items, found, strict=True))]
                if out:
                    yield batch(out, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()], ["conv_id", name, "begin", "end", "last"])

        return run

    of_parts = tops.mapInArrow(ends("part"), "conv_id long, part long, begin int, end int, last boolean")
    same = lists["conv_id"].eqNullSafe(of_parts["conv_id"]) & (lists["part"] == of_parts["part"])
    return lists.join(of_parts, same).select(lists["conv_id"], "items", "begin", "end", "last").mapInArrow(ends("block"), "conv_id long, block long, begin int, end int, last boolean")


REPAIRED = "conv_id long, block long, n_turns int, cost long, n_merged int, n_relabelled int, n_inserted int, rendered string"


def repaired(turns: DataFrame) -> DataFrame:
    """One row for each block of a conversation of turns (conv_id, turn, role, text); `rendered` of the blocks, in their
    order, is the whole conversation. Conversations of up to `BLOCK` turns have one block."""
    small_batches(turns.sparkSession)
    rows = numbered(turns)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in REPAIRED.split(", ")]
        out, size = [], 0
        for (conv, block), found in grouped(batches, 8):
            at, _, _, *ends = found[0]
            begin, end, last = ends if at < 0 else (START, None, True)
            found = found[at < 0 :]
            roles = [role for _, role, *_ in found]
            cost = merged = relabelled = inserted = 0
            parts, state, opened = [], begin, begin != START
            for (_, _, text, *_), role, (after, action, between) in zip(found, roles, repair(roles, begin, end), strict=True):
                for r in between:
                    parts += [CLOSE if opened else "", OPEN.format(ROLES[r - 1])]
                    opened = True
                inserted += len(between)
                cost += INSERT * len(between)
                if action == "merge":
                    merged += 1
                    cost += MERGE
                    parts += ["\n", text]
                else:
                    parts += [CLOSE if opened else "", OPEN.format(ROLES[after - 1]), text]
                    opened = True
                if after != role:
                    relabelled += 1
                    cost += RELABEL
                state = after
            if last:
                for r in ENDINGS[state]:
                    parts += [CLOSE if opened else "", OPEN.format(ROLES[r - 1])]
                    opened = True
                inserted += len(ENDINGS[state])
                cost += INSERT * len(ENDINGS[state])
                parts.append(CLOSE)
            out.append((conv, block, len(found), cost, merged, relabelled, inserted, "".join(parts)))
            size += len(out[-1][-1])
            if len(out) >= 2000 or size >= 1 << 24:
                yield batch(out, kinds, names)
                out, size = [], 0
        if out:
            yield batch(out, kinds, names)

    # A block's states come as a row before its turns, so that states and turns meet by one shuffle.
    states = block_states(rows).select("conv_id", "block", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("role"), F.lit("").alias("text"), "begin", "end", "last")
    both = rows.select("*", *(F.lit(None).cast(k).alias(c) for c, k in (("begin", "int"), ("end", "int"), ("last", "boolean")))).unionByName(states)
    return both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at").mapInArrow(render, REPAIRED)


def rendered_conversations(blocks: DataFrame) -> DataFrame:
    """One row per conversation of `repaired`: the rendered text and the summed costs. A row must hold a conversation."""
    total = [F.sum(c).alias(c) for c in ("n_turns", "cost", "n_merged", "n_relabelled", "n_inserted")]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "rendered"))), lambda x: x["rendered"]), "")
    return blocks.groupBy("conv_id").agg(*total, text.alias("rendered"))
