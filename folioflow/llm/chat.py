"""Chat formatting with minimum-cost repair of roles.

A legal conversation is an optional system turn, then user and assistant turns in turn, ending with the
assistant. The cheapest repair of a sequence of turns is found by dynamic programming over that automaton; each turn is kept,
relabelled (``RELABEL``) or merged into the turn before it (``MERGE``, and ``RELABEL`` if the roles differ), and empty
turns may be inserted before it or at the end (``INSERT`` each). Of equally cheap repairs the one that comes first in the
order keep/relabel before merge, states in the order of ``STATES``, is taken from the end backwards.

A conversation of any length is repaired exactly although no task holds all of it: turns are range-partitioned and sorted by
conversation, turn, role and text, each task sums up its part of a conversation that crosses its borders as a min-plus matrix
between states, the driver chains these (two rows from each task at most), and each task then traces its own part.

Output is a row for each turn with the piece of rendered text that belongs to it and ``seq``, the turn's number within the whole conversation; a conversation's
pieces in the order of ``seq`` are the whole rendering. A text's own ``<|`` is written ``<\\|`` (and ``<\\|`` with one backslash more, and so on), so that no
text can open or close a turn and the writing can be undone; see ``unescaped``.

Defined results: a null role or one that is not system, user or assistant must be relabelled; a null text is empty.
Turns without a conversation id form one conversation. Turns with equal numbers are taken in the order of role and text; repeated rows are turns
of their own. Ids and turn numbers may be of any type that Spark orders. Extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut

RELABEL, MERGE, INSERT = 2.0, 1.0, 3.0
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = ("start", "system", "user", "assistant")
INF = float("inf")


def _fill(state: int, role: int) -> list[int] | None:
    """Empty turns to insert so that ``role`` may follow ``state``; None if no insertion helps."""
    if role == SYSTEM:
        return [] if state == START else None
    if role == USER:
        return [ASSISTANT] if state == USER else []
    return [] if state == USER else [USER]


_FILL = [[_fill(s, r) if r else None for r in range(4)] for s in range(4)]


def moves(role: int) -> list[tuple[float, int, int, bool]]:
    """(cost, state before, state after, merged) for a turn of ``role`` (0: not a legal one)."""
    out = []
    for s in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            if _FILL[s][to] is not None:
                out.append((RELABEL * (role != to) + INSERT * len(_FILL[s][to]), s, to, False))
        if s != START:
            out.append((MERGE + RELABEL * (role != s), s, s, True))
    return out


_MOVES = [moves(r) for r in range(4)]
_ROLE = {name: i for i, name in enumerate(STATES) if i}


def ending(state: int) -> tuple[float, list[int]]:
    """Cost and empty turns that close a conversation in ``state``."""
    return (0.0, []) if state == ASSISTANT else (INSERT, [ASSISTANT]) if state == USER else (2 * INSERT, [USER, ASSISTANT])


def forward(costs: list[float], roles: list[int]) -> list[list[float]]:
    """Cheapest cost of being in each state before the first turn and after each."""
    rows = [costs]
    for role in roles:
        new = [INF] * 4
        for cost, s, to, _ in _MOVES[role]:
            if costs[s] + cost < new[to]:
                new[to] = costs[s] + cost
        costs = new
        rows.append(costs)
    return rows


def trace(rows: list[list[float]], roles: list[int], last: int) -> list[tuple[int, int, bool]]:
    """(state before, role given, merged) of each turn, on a cheapest path that ends in ``last``."""
    out, state = [], last
    for i in range(len(roles) - 1, -1, -1):
        _, s, merged = min((rows[i][s] + cost, s, merged) for cost, s, to, merged in _MOVES[roles[i]] if to == state)
        out.append((s, state, merged))
        state = s
    return out[::-1]


def best_end(costs: list[float]) -> int:
    return min(range(4), key=lambda s: (costs[s] + ending(s)[0], s))


def matrix(roles: list[int]) -> list[list[float]]:
    """Cheapest cost from each state to each over a stretch of turns."""
    return [forward([0.0 if s == k else INF for s in range(4)], roles)[-1] for k in range(4)]


def _head(role: int) -> str:
    return f"<|{STATES[role]}|>\n"


END = "<|end|>\n"


_MARK, _WRITTEN = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text) if "|" in text else text


def unescaped(text: str) -> str:
    """The text that ``escaped`` wrote."""
    return _WRITTEN.sub(r"<\1|", text)


def piece(state: int, role: int, merged: bool, text: str, closes: list[int] | None) -> str:
    """The turn's share of the rendering; ``closes``: empty turns after the conversation's last one, else None."""
    text = escaped(text)
    if merged:
        out = "\n" + text
    else:
        out = END * (state != START) + "".join(_head(r) + END for r in _FILL[state][role]) + _head(role) + text
    return out if closes is None else out + END + "".join(_head(r) + END for r in closes)


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conversation, turn, ``seq`` (from 0, within the conversation), ``role``, ``role_out``, ``action``, ``inserted``, ``rendered``, ``text``."""
    named = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keys = ["conv", "turn", "role", "text"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(named.repartitionByRange(n, *keys).sortWithinPartitions(*keys))

    def parts(batches):
        """Runs of one conversation within the task: (conversation, turns, roles, texts), one run at a time."""
        held: list[list] = []
        now = object()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != now:
                    yield now, held
                    held = []
                now = row[0]
                held.append(row)
        if held:
            yield now, held

    def borders(batches):
        task, runs = TaskContext.get().partitionId(), []
        for conv, held in parts(batches):
            run = (task, conv, [_ROLE.get(r[2], 0) for r in held])
            runs = [runs[0], run] if runs else [run]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in runs], pa.int32()), pa.array(list(range(len(runs))), pa.int32()), pa.array([len(r[2]) for r in runs], pa.int64()), pa.array([None if r[1] is None else str(r[1]) for r in runs], pa.string()), pa.array([[x for row in matrix(r[2]) for x in row] for r in runs], pa.list_(pa.float64()))],
            ["task", "nth", "turns", "conv", "m"],
        )

    ends = sorted(rows.mapInArrow(borders, "task int, nth int, turns long, conv string, m array<double>").collect(), key=lambda r: (r.task, r.nth))
    # for the first (0) and last (1, or 0 if alone) run of a task: costs before it, and the state it must end in
    entry: dict[tuple[int, int], list[float]] = {}
    leave: dict[tuple[int, int], int] = {}
    fresh = [0.0, INF, INF, INF]
    chained: list[list] = []
    for r in ends:
        same = chained and chained[-1][-1].conv == r.conv and not (chained[-1][-1].task == r.task)
        if same:
            chained[-1].append(r)
        else:
            chained.append([r])
    first_seq: dict[tuple[int, int], int] = {}
    for chain in chained:
        costs, before = fresh, 0
        for r in chain:
            first_seq[r.task, r.nth] = before
            before += r.turns
            entry[r.task, r.nth] = costs
            m = np.array(r.m).reshape(4, 4)
            costs = (np.array(costs)[:, None] + m).min(0).tolist()
        state = best_end(costs)
        for i in range(len(chain) - 1, -1, -1):
            r = chain[i]
            leave[r.task, r.nth] = state
            m = np.array(r.m).reshape(4, 4)
            before = entry[r.task, r.nth]
            state = min(range(4), key=lambda s: (before[s] + m[s][state], s))
            # of equally cheap ways in, both sides of the border take this one
            entry[r.task, r.nth] = [0.0 if s == state else INF for s in range(4)]
    open_after = {(r.task, r.nth) for chain in chained for r in chain[:-1]}
    last_nth: dict[int, int] = {}
    for r in ends:
        last_nth[r.task] = r.nth

    def render(batches):
        task = TaskContext.get().partitionId()
        runs = parts(batches)
        i, ahead = 0, next(runs, None)
        while ahead is not None:
            (_, held), ahead = ahead, next(runs, None)
            at = (task, 0) if i == 0 else (task, last_nth[task]) if ahead is None else None
            roles = [_ROLE.get(r[2], 0) for r in held]
            costs = forward(entry.get(at, fresh), roles)
            path = trace(costs, roles, leave.get(at, best_end(costs[-1])))
            last, base = len(held) - 1, first_seq.get(at, 0)
            out = {"conv": [], "turn": [], "seq": [], "role": [], "role_out": [], "action": [], "inserted": [], "rendered": [], "text": []}
            for k, (row, (s, to, merged)) in enumerate(zip(held, path, strict=True)):
                closes = ending(to)[1] if k == last and at not in open_after else None
                values = (row[0], row[1], base + k, row[2], STATES[to], ("merge" if merged else "keep") if roles[k] == to else ("relabel+merge" if merged else "relabel"), (0 if merged else len(_FILL[s][to])) + len(closes or ()), piece(s, to, merged, row[3] or "", closes), row[3])
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)
            yield out
            i += 1

    whole, words = LongType(), StringType()
    schema = StructType([named.schema["conv"], named.schema["turn"], *[StructField(c, t) for c, t in (("seq", whole), ("role", words), ("role_out", words), ("action", words), ("inserted", whole), ("rendered", words), ("text", words))]])
    types = {f.name: to_arrow_type(f.dataType) for f in schema}

    def batches_of(batches):
        held, n = None, 0
        for out in render(batches):
            held = out if held is None else _extend(held, out)
            n = len(held["conv"])
            if n >= 2000:
                yield _batch(held)
                held = None
        if held:
            yield _batch(held)

    def _extend(a, b):
        for k, v in b.items():
            a[k].extend(v)
        return a

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], list(types))

    result = rows.mapInArrow(batches_of, schema)
    return result.withColumnsRenamed({"conv": conv_col, "turn": turn_col, "text": text_col, "role": role_col})
