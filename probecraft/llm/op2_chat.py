"""Chat formatting with minimum-cost role repair.

Legal sequences are an optional system turn and then user and assistant turns in alternation, ending with the
assistant. Every turn may be kept, relabelled, merged into the one before it, or preceded by an inserted
empty turn; each has a cost, and dynamic programming over the automaton's states finds the cheapest
repair of each conversation. The turns' costs are matrices in the (min, +) algebra, so a conversation that lies
in several partitions is solved piece by piece: only the matrix of a partition's first and last conversation
goes to the driver (two rows for each partition), which fixes the states in which pieces begin and end.

Every turn gives its fragments of the rendered text; a conversation is their concatenation by ``pos``, so none
is ever held whole. A start marker closes the turn before it.

Costs are pairs: the cost itself, then the turns that are not kept as they are; among repairs equal in both, the one whose
last state that differs is the smaller counts (system, user, assistant). A piece's matrix comes with the order of its
best ways from each first state, so that the choice is the same however conversations lie in partitions.

Fixed behaviour: turns order by turn number, nulls first, ties by role and text; null or unknown roles must be
relabelled (at RELABEL each); null texts are empty; rows without conv_id are one conversation; markers within a
text are broken up by a space; repeated rows are turns of their own; very long texts are whole; empty tables give empty results; ties of cost are
settled as above; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, partitions

#: Costs of changes, in natural order; infinite where the automaton has no way.
RELABEL, MERGE, INSERT = 2, 1, 3
ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the turn before.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: A cost as one integer: the cost times UNIT, and the turns not kept.
UNIT, INF = 1 << 28, 1 << 60
FRAGMENTS = "conv_id long, pos long, turn long, action string, role string, fragment string"
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _moves() -> tuple[np.ndarray, dict]:
    """Cost of putting a turn of each role after each state, and the role inserted before it."""
    cost, inserted = np.full((4, 4), INF, np.int64), {}
    for s in range(4):
        for q in (SYSTEM, USER, ASSISTANT):
            if q in NEXT[s]:
                cost[s, q] = 0
            elif q == s:
                cost[s, q] = MERGE * UNIT + 1
            else:
                for e in NEXT[s]:
                    if q in NEXT[e] and cost[s, q] == INF:
                        cost[s, q], inserted[s, q] = INSERT * UNIT, e
    return cost, inserted


MOVES, INSERTED = _moves()
#: Inserted turns that complete a conversation from each state.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
CLOSE = [INSERT * UNIT * len(CLOSING[s]) for s in range(4)]


def _matrix(role: int) -> list[list[int]]:
    """Cost from each state to each state over a turn of a role (0: unknown); a merged turn counts once as not kept."""
    out = MOVES.copy()
    for q in (SYSTEM, USER, ASSISTANT):
        if q != role:
            out[:, q] += RELABEL * UNIT
            out[[s for s in range(4) if s != q], q] += 1
    return np.minimum(out, INF).tolist()


MATRICES = [_matrix(r) for r in range(4)]


def ways(roles: list[int], cost: list[int]) -> tuple[list[int], list[list[int]]]:
    """Least costs of the states after the turns, from costs of the states before them, and each turn's table of states before."""
    back = []
    for r in roles:
        m, new, way = MATRICES[r], [INF] * 4, [0] * 4
        for q in (1, 2, 3):
            for s in range(4):
                c = cost[s] + m[s][q]
                if c < new[q]:
                    new[q], way[q] = c, s
        back.append(way)
        cost = new
    return cost, back


def states_to(end: int, back: list[list[int]]) -> list[int]:
    """The states after each turn, the last being end."""
    states = [end]
    for way in reversed(back[1:]):
        states.append(way[states[-1]])
    return states[::-1][: len(back)]


def summary(roles: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """Least cost from each state to each state over the turns, and for each end the order of the beginnings by their ways, last states first."""
    cost, path = [], {}
    for s in range(4):
        found, back = ways(roles, [0 if k == s else INF for k in range(4)])
        cost.append([min(c, INF) for c in found])
        for q in (1, 2, 3):
            path[s, q] = (states_to(q, back)[::-1], s)
    order = [[0] * 4 for _ in range(4)]
    for q in (1, 2, 3):
        for k, s in enumerate(sorted(range(4), key=lambda s: path[s, q])):
            order[s][q] = k
    return cost, order


def chosen(pieces: list[tuple[list[list[int]], list[list[int]]]]) -> list[tuple[int, int]]:
    """The states in which each piece of a conversation begins and ends, from the pieces' summaries."""
    cost, back = [(0, 0) if s == START else None for s in range(4)], []
    for m, order in pieces:
        new, way = [None] * 4, [0] * 4
        for q in (1, 2, 3):
            options = [(cost[s][0] + m[s][q] // UNIT, cost[s][1] + m[s][q] % UNIT, order[s][q], s) for s in range(4) if cost[s] is not None and m[s][q] < INF]
            if options:
                best = min(options)
                new[q], way[q] = best[:2], best[3]
        back.append(way)
        cost = new
    end = min((s for s in range(4) if cost[s] is not None), key=lambda s: (cost[s][0] + CLOSE[s] // UNIT, cost[s][1], s))
    out = []
    for way in reversed(back):
        out.append((way[end], end))
        end = way[end]
    return out[::-1]


def repair(roles: list[int], begin: int = START, end: int | None = None) -> tuple[list[int], int]:
    """The cheapest state after each turn from begin, and the cost; the last is end, or the cheapest to close."""
    cost, back = ways(roles, [0 if s == begin else INF for s in range(4)])
    closes = end is None
    if closes:
        end = min(range(4), key=lambda s: (cost[s] + CLOSE[s], s))
    return states_to(end, back), (cost[end] + (CLOSE[end] if closes else 0)) // UNIT


def _escape(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def fragments(turns: list[tuple], states: list[int], begin: int, closes: bool) -> Iterator[tuple]:
    """(turn, action, role, fragment) for each turn and insertion; turns are (turn, role, text)."""
    state = begin

    def opened(role: int, text: str) -> str:
        return (f"{END}\n" if state != START else "") + f"{BEGIN}{ROLES[role - 1]}\n{text}"

    for (turn, role, text), q in zip(turns, states, strict=True):
        if (state, q) in INSERTED and q not in NEXT[state] and q != state:
            e = INSERTED[state, q]
            yield turn, "insert", ROLES[e - 1], opened(e, "")
            state = e
        merged = q == state
        action = "merge" if merged else "keep" if q == role else "relabel"
        yield turn, action, ROLES[q - 1], f"\n{_escape(text)}" if merged else opened(q, _escape(text))
        state = q
    if closes:
        for e in CLOSING[state]:
            yield None, "insert", ROLES[e - 1], opened(e, "")
            state = e
        yield None, "end", None, f"{END}\n"


def _runs(it: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, object, list]]:
    """(part, conversation, rows) of rows in order of part and seq."""
    at, held = None, []
    for b in it:
        for row in zip(*(b.column(i).to_pylist() for i in range(width)), strict=True):
            if row[:2] != at and held:
                yield *at, held
                held = []
            at = row[:2]
            held.append(row[2:])
    if held:
        yield *at, held


def format_chat(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The fragments of every conversation of turns (conv_id, turn, role, text)."""
    scratch, n = Scratch(spark), partitions(spark)
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.trim("role"))), F.lit(0)).cast("int")
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    rows = turns.select("conv_id", "turn", "role", "text").repartitionByRange(n, *order).sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    table = scratch.write(rows.select("part", "conv_id", "seq", code.alias("code"), "turn", "text"))

    def edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Matrices of each part's first and last conversation."""
        out, last, part_at = [], None, None
        for part, conv, held in _runs(it, 4):
            if part != part_at:
                if last:
                    out.append(last)
                last, part_at = None, part
                out.append((part, conv, held))
            else:
                last = (part, conv, held)
        if last:
            out.append(last)
        found = [summary([r[1] for r in h]) for _, _, h in out]
        flat = [pa.array([sum(f[i], []) for f in found], pa.list_(pa.int64())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2][0][0] for o in out], pa.int64()), *flat], names=["part", "conv_id", "seq", "cost", "order"])

    dealt = lambda *c: table.select(*c).repartition(n, "part").sortWithinPartitions("part", "seq")
    found = dealt("part", "conv_id", "seq", "code").mapInArrow(edges, "part int, conv_id long, seq long, cost array<long>, order array<long>").collect()
    found.sort(key=lambda r: (r["part"], r["seq"]))
    chains: dict = {}
    square = lambda x: [x[i : i + 4] for i in range(0, 16, 4)]
    for r in found:
        chains.setdefault(r["conv_id"], []).append((r["part"], (square(r["cost"]), square(r["order"]))))
    plan = {}
    for conv, pieces in chains.items():
        if len(pieces) > 1:
            for i, ((part, _), (begin, end)) in enumerate(zip(pieces, chosen([m for _, m in pieces]), strict=True)):
                plan[part, conv] = (begin, end, i == len(pieces) - 1)

    def render(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for part, conv, held in _runs(it, 6):
            begin, end, closes = plan.get((part, conv), (START, None, True))
            states, _ = repair([r[1] for r in held], begin, end)
            base = held[0][0] * 4
            for k, f in enumerate(fragments([(r[2], r[1], r[3]) for r in held], states, begin, closes)):
                out.append((conv, base + k, *f))
            if len(out) > 5000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return dealt("part", "conv_id", "seq", "code", "turn", "text").mapInArrow(render, FRAGMENTS)


def _batch(rows: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", "pos", "turn", "action", "role", "fragment"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
