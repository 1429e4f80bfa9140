"""Chat formatting with minimum-cost role repair.

Legal conversations are the paths of a small automaton: an optional system
turn first, then user and assistant in turn, starting with the user.  For each
turn a repair may keep its role, relabel it, merge it into the turn before, or
put empty turns before it; a dynamic program over the automaton's states finds
the cheapest repair of the whole conversation (equal costs: the first in the
order of ``moves``).  The repaired turns are rendered as

    <|role|>\\ntext<|end|>\\n

The cost of a stretch of turns is a matrix, entry state by exit state, and
matrices combine by minimum and sum.  So a conversation of any length is cut
where the range partitions of (conv_id, turn) end: each stretch gives its
matrix; from these come the costs before each stretch; with them each stretch
says, for every state it may end in, where it comes from; one row per stretch
decides the states in between, and each stretch is then repaired alone, as it
would be in one piece.  No task holds more of a conversation than its partition.

The result has one row per input turn with the piece of text it adds, in the
order (conv_id, part, seq); a conversation's text is its pieces joined.

Defined results: turns are ordered by turn, then role, a hash of the text and
the text, nulls first (the order of the range partitions, so that their number
makes no difference),
so repeated rows are further turns; null texts are empty; null and unknown
roles are relabelled at a low cost; null ids form one conversation; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

ROLES = ("system", "user", "assistant")
START = 3                      # state before the first turn; others: role of the last turn
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 4, 2, 2, 3
NEVER = 1 << 40


@lru_cache(None)
def moves(role: int) -> tuple:
    """(from state, to state, cost, action, empty roles put before) for a turn
    of the role (-1: unknown), in order of preference."""
    out = []
    for s in (START, 0, 1, 2):
        for to in (0, 1, 2):
            own = 0 if role == to else RELABEL_UNKNOWN if role < 0 else RELABEL
            name = "keep" if role == to else "relabel"
            if to in NEXT[s]:
                out.append((s, to, own, name, ()))
            if s == to:
                out.append((s, to, own + MERGE, "merge", ()))
            for mid in NEXT[s]:                        # one empty turn, or two, on the way
                if to in NEXT[mid]:
                    out.append((s, to, own + INSERT, "insert", (mid,)))
                for mid2 in NEXT[mid]:
                    if to in NEXT[mid2]:
                        out.append((s, to, own + 2 * INSERT, "insert", (mid, mid2)))
    return tuple(sorted(out, key=lambda m: m[2]))


def code(role) -> int:
    return ROLES.index(role) if role in ROLES else -1


@lru_cache(None)
def step(role: int) -> np.ndarray:
    """Least cost from state to state over one turn of the role."""
    m = np.full((4, 4), NEVER, np.int64)
    for s, to, cost, *_ in moves(role):
        m[s, to] = min(m[s, to], cost)
    return m


def stretch(roles: list[int]) -> np.ndarray:
    """Least cost from entry state to exit state over several turns."""
    m = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for r in roles:
        m = np.minimum((m[:, :, None] + step(r)).min(1), NEVER)
    return m


def forward(roles: list[int], cost: list[int]) -> tuple[list, list[int]]:
    """Per turn the best move into each state, and the costs of the states
    after the last turn, from those before the first."""
    trace = []
    for r in roles:
        new, how = [NEVER] * 4, [None] * 4
        for m in moves(r):
            c = cost[m[0]] + m[2]
            if c < new[m[1]]:
                new[m[1]], how[m[1]] = c, m
        cost = new
        trace.append(how)
    return trace, cost


def repair(roles: list[int], cost: list[int], leave: int | None) -> list[tuple]:
    """The cheapest moves over the turns, from the costs of the states before
    them, to a state (None: the cheapest)."""
    trace, cost = forward(roles, cost)
    s = min(range(4), key=lambda i: cost[i]) if leave is None else leave
    out = []
    for how in reversed(trace):
        out.append(how[s])
        s = how[s][0]
    return out[::-1]


def entries(roles: list[int], cost: list[int]) -> list[int]:
    """For each state after the turns the one before them that the cheapest
    moves come from (-1: none), and the cheapest state after them."""
    trace, end = forward(roles, cost)
    out = []
    for s in range(4):
        for how in reversed(trace):
            s = how[s][0] if s >= 0 and how[s] else -1
        out.append(s)
    return [*out, min(range(4), key=lambda i: end[i])]


BEGIN = [NEVER] * START + [0]


def starts(parts: list[tuple]) -> list[tuple]:
    """(part, costs of the states before it) of each stretch of one
    conversation, from (part, matrix)."""
    cost, out = np.array(BEGIN), []
    for part, m in sorted(parts):
        out.append((part, cost.tolist()))
        cost = np.minimum((cost[:, None] + np.array(m).reshape(4, 4)).min(0), NEVER)
    return out


def leaves(parts: list[tuple]) -> list[tuple]:
    """(part, costs before, state after, last) of each stretch, from (part,
    costs before, ``entries``)."""
    s, out = None, []
    for part, cost, back in sorted(parts, reverse=True):
        last = s is None
        s = back[4] if last else s
        out.append((part, cost, s, last))
        s = back[s]
    return out


def piece(move: tuple, text: str, last: bool) -> str:
    s, to, _, action, empty = move
    end = "<|end|>\n"
    out = "\n" + text if action == "merge" else ("" if s == START else end) + "".join(
        f"<|{ROLES[e]}|>\n{end}" for e in empty) + f"<|{ROLES[to]}|>\n{text}"
    return out + end if last else out


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, part, seq, turn, role, action, cost, piece), one row per turn."""
    spark = turns.sparkSession
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ["conv_id", "turn", "role", F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *key).withColumn("part", F.spark_partition_id())
    rows = C.settle(rows, "chat-turns")

    def each(frame, fn, out):
        def run(batches):
            for g in C.runs(batches, "part", "conv_key"):
                yield from fn(g)
        with_key = frame.withColumn("conv_key", F.xxhash64("conv_id", F.col("conv_id").isNull()))
        return (with_key.repartition("part", "conv_key")
                .sortWithinPartitions("part", "conv_key", *key, "text").mapInArrow(run, out))

    def matrix(g):
        m = stretch([code(r) for r in g.column("role").to_pylist()])
        yield pa.RecordBatch.from_arrays([
            pa.array([g.column("conv_id")[0].as_py()], pa.int64()), pa.array([g.column("part")[0].as_py()], pa.int32()),
            pa.array([m.ravel().tolist()])], names=["conv_id", "part", "m"])
    # conversations that cross a partition bound: at most one per bound
    cut = rows.groupBy("conv_id", "part").agg(F.lit(1).alias("x")).groupBy("conv_id").count().where("count > 1")
    cut = C.settle(cut.select(F.col("conv_id").alias("cut_id")), "chat-cut")
    across = rows.join(cut, F.col("conv_id").eqNullSafe(F.col("cut_id")), "left_semi")
    parts = each(across.withColumn("text", F.lit("")), matrix, "conv_id long, part int, m array<long>")
    def per_conversation(parts, fn, out):
        """fn of one conversation's stretches, as lists of tuples."""
        schema = pa.schema([("c", pa.int64()), ("p", pa.int32()), ("before", pa.list_(pa.int64())),
                            *([("leave", pa.int32()), ("final", pa.bool_())] if "leave" in out else [])])
        packed = parts.groupBy("conv_id").agg(F.collect_list(F.struct(*parts.columns[1:])).alias("parts"))

        def run(batches):
            for chunk in C.rows_of(batches, "conv_id", "parts"):
                for conv, ps in chunk:
                    got = [(conv, *x) for x in fn([tuple(p.values()) for p in ps])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema)
        return C.settle(packed.mapInArrow(run, out), "chat-states")

    def joined(frame, known):
        return frame.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").drop("c", "p")

    def origin(g):
        cost = g.column("before")[0].as_py()
        yield pa.RecordBatch.from_arrays([
            g.column("conv_id").combine_chunks()[:1], g.column("part").combine_chunks()[:1], pa.array([cost], pa.list_(pa.int64())),
            pa.array([entries([code(r) for r in g.column("role").to_pylist()], cost)], pa.list_(pa.int64()))],
            names=["conv_id", "part", "before", "back"])
    known = per_conversation(parts, starts, "c long, p int, before array<long>")
    parts = each(joined(across.withColumn("text", F.lit("")), known), origin,
                 "conv_id long, part int, before array<long>, back array<long>")
    known = per_conversation(parts, leaves, "c long, p int, before array<long>, leave int, final boolean")
    rows = joined(rows, known)

    def render(g):
        one = lambda c: g.column(c)[0].as_py()
        roles, texts = g.column("role").to_pylist(), g.column("text").to_pylist()
        final = one("final")
        got = repair([code(r) for r in roles], one("before") or BEGIN, one("leave"))
        size = len(got)
        yield pa.RecordBatch.from_arrays([
            pa.array([one("conv_id")] * size, pa.int64()), pa.array([one("part")] * size, pa.int32()),
            pa.array(range(size), pa.int64()), pa.array(g.column("turn").to_pylist(), pa.int64()),
            pa.array([ROLES[m[1]] for m in got]), pa.array([m[3] for m in got]),
            pa.array([m[2] for m in got], pa.int64()),
            pa.array([piece(m, t or "", i == size - 1 and final is not False)
                      for i, (m, t) in enumerate(zip(got, texts))])],
            names=["conv_id", "part", "seq", "turn", "role", "action", "cost", "piece"])
    return each(rows, render, "conv_id long, part int, seq long, turn long, role string, action string, "
                              "cost long, piece string")
