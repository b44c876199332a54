"""Chat formatting with minimum-cost role repair.

A conversation is legal if a system turn comes at most once and first, user
and assistant alternate, the user begins and the assistant ends.  Every turn
of the input is kept, relabelled or merged into the turn before it, and empty
turns may be inserted; dynamic programming over the automaton of legal turns
finds the cheapest repair, which is then rendered.

The automaton has four states, so a run of turns is a 4 x 4 matrix of costs
and runs combine by (min, +) products.  Rows are dealt out by ranges of
(conversation, turn): a conversation of any length may span many tasks.  Each
task reports the matrices of its first and last conversation, the driver
chains the few that cross a border (two per task), and each task then decodes
its own turns between known border states.

Ties: of equally cheap repairs the one whose last differing state comes first
in STATES wins, wherever the borders lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm.common import checkpointed, width

STATES = ("start", "system", "user", "assistant")
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}     # roles that may follow a state
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 3, 1, 1, 2
JOIN = "\n\n"                                      # between the texts of merged turns
_FAR = 1 << 40


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest run of inserted turns that leads from one state to another."""
    paths = {(s, s): () for s in LEGAL}
    for _ in LEGAL:
        for (a, b), p in list(paths.items()):
            for c in LEGAL[b]:
                if (a, c) not in paths or len(paths[a, c]) > len(p) + 1:
                    paths[a, c] = (*p, c)
    return paths


_PATHS = _insertions()


def _moves(role: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """Cheapest way from state to state by one turn of ``role`` (0: unknown):
    (cost, action, inserted turns)."""
    out = {}
    for s in LEGAL:
        for to in (1, 2, 3):
            label = 0 if role == to else RELABEL if role else RELABEL_UNKNOWN
            ways = [(label + INSERT * len(p), "keep" if role == to else "relabel", p)
                    for mid in LEGAL if to in LEGAL[mid] and (p := _PATHS.get((s, mid))) is not None]
            if s == to:
                ways.append((MERGE + label, "merge", ()))
            if ways:
                out[s, to] = min(ways, key=lambda w: (w[0], len(w[2])))
    return out


_MOVES = {r: _moves(r) for r in range(4)}
_COST = {r: np.array([[_MOVES[r].get((a, b), (_FAR,))[0] for b in range(4)] for a in range(4)]) for r in range(4)}
_MADE = {r: np.array([[0 if (m := _MOVES[r].get((a, b))) is None else len(m[2]) + (m[1] != "merge") for b in range(4)] for a in range(4)]) for r in range(4)}
_END = {s: _PATHS[s, 3] for s in (1, 2, 3)}
_END_COST = np.array([_FAR, *(INSERT * len(_END[s]) for s in (1, 2, 3))])


class Run:
    """Costs of a run of turns from entry to exit state, the rank of entries
    that tie, and how many turns the best way makes."""

    def __init__(self):
        self.cost = np.where(np.eye(4, dtype=bool), 0, _FAR)
        self.rank, self.made = np.zeros((4, 4), dtype=int), np.zeros((4, 4), dtype=int)

    def add(self, role: int) -> None:
        step = self.cost[:, :, None] + _COST[role][None]             # entry, before, after
        before = step.argmin(axis=1)                                  # first of equals
        entry, after = np.arange(4)[:, None], np.arange(4)[None]
        self.cost = np.minimum(step.min(axis=1), _FAR)
        self.made = self.made[entry, before] + _MADE[role][before, after]
        key = before * 4 + self.rank[entry, before]
        self.rank = (key[:, None, :] > key[None, :, :]).sum(axis=1)

    def packed(self) -> list[int]:
        return [int(x) for m in (self.cost, self.rank, self.made) for x in m.ravel()]

    @staticmethod
    def unpacked(x) -> Run:
        r = Run()
        r.cost, r.rank, r.made = np.array(x).reshape(3, 4, 4)
        return r


def border_states(runs: list[Run]) -> list[int]:
    """States between consecutive runs of one conversation, entry and exit included."""
    ahead = [np.array([0, _FAR, _FAR, _FAR])]
    for r in runs:
        ahead.append(np.minimum((ahead[-1][:, None] + r.cost).min(axis=0), _FAR))
    states = [int((ahead[-1] + _END_COST).argmin())]
    for r, d in zip(reversed(runs), reversed(ahead[:-1])):
        total = d + r.cost[:, states[0]]
        states.insert(0, int(np.lexsort((r.rank[:, states[0]], total))[0]))
    return states


def decode(roles: list[int], entry: int, leave: int | None) -> list[int]:
    """State after each turn of the cheapest way from ``entry`` (to ``leave``, or
    to the cheapest end)."""
    d, back = np.where(np.arange(4) == entry, 0, _FAR), []
    for r in roles:
        step = d[:, None] + _COST[r]
        back.append(step.argmin(axis=0))
        d = np.minimum(step.min(axis=0), _FAR)
    s = int((d + _END_COST).argmin()) if leave is None else leave
    out = []
    for b in reversed(back):
        out.append(s)
        s = int(b[s])
    return out[::-1]


def _escape(text: str) -> str:
    return text.replace("<|", "< |")


def _open(role: int) -> str:
    return f"<|im_start|>{STATES[role]}\n"


_CLOSE = "<|im_end|>\n"


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, list]]:
    """(conversation, its consecutive rows in this task) from sorted batches."""
    now, rows = None, []
    for b in batches:
        for row in zip(b["conv_id"], b["turn"], b["role"], b["text"]):
            conv = None if pd.isna(row[0]) else int(row[0])
            if rows and conv != now:
                yield now, rows
                rows = []
            now = conv
            rows.append(row)
    if rows:
        yield now, rows


def _role(role) -> int:
    return STATES.index(role) if role in STATES[1:] else 0


def repair(turns: DataFrame) -> DataFrame:
    """Repaired and rendered turns of the conversations in ``turns``
    (conv_id, turn, role, text).

    One row per input turn: conv_id, turn, role, new_role, action (keep,
    relabel or merge), inserted (roles of empty turns put in before it),
    appended (put in after it, at the end), cost, out_turn (its place in the
    repaired conversation, from 0) and piece.  The pieces of a conversation in
    order, joined without anything between, are its rendered text.

    Nulls: a null or unknown role is relabelled at lower cost, a null text is
    empty, a null turn comes last, rows without conv_id form one conversation.
    Turns of equal number follow one another by role and text; repeated rows
    are turns of their own (they get merged).  A tag inside a text is broken
    up.  An empty table gives no rows; other columns are not read.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_last("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    dealt = checkpointed(turns.select("conv_id", "turn", "role", "text").repartitionByRange(width(turns.sparkSession), *order)
                         .sortWithinPartitions(*order))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        def of(rows):
            r = Run()
            for row in rows:
                r.add(_role(row[2]))
            return r.packed()

        first = last = None
        n = 0
        for conv, rows in _segments(batches):
            n += 1
            if first is None:
                first = (conv, of(rows))
            last = (conv, rows)
        if n:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [n], "first": pd.array([first[0]], dtype="Int64"),
                                "last": pd.array([last[0]], dtype="Int64"), "a": [first[1]], "b": [of(last[1])]})

    borders = sorted(dealt.mapInPandas(report, "part int, n int, first long, last long, a array<long>, b array<long>").collect(),
                     key=lambda r: r["part"])  # one row per task
    # per task: (entry, exit, turns made before, goes on) of its first and last segment
    known: dict[int, dict[str, tuple]] = {r["part"]: {} for r in borders}
    i = 0
    while i < len(borders):
        j = i
        while j + 1 < len(borders) and borders[j]["last"] == borders[j + 1]["first"] and (j == i or borders[j]["n"] == 1):
            j += 1
        if j > i:
            runs = [Run.unpacked(borders[k]["b" if k == i else "a"]) for k in range(i, j + 1)]
            states, made = border_states(runs), 0
            for k, r, s, e in zip(range(i, j + 1), runs, states[:-1], states[1:]):
                known[borders[k]["part"]]["last" if k == i else "first"] = (s, e, made, k < j)
                made += int(r.made[s, e])
        i = j if j > i else i + 1
    schema = T.StructType([turns.schema["conv_id"], turns.schema["turn"], T.StructField("role", T.StringType()),
                           T.StructField("new_role", T.StringType()), T.StructField("action", T.StringType()),
                           T.StructField("inserted", T.ArrayType(T.StringType())), T.StructField("appended", T.ArrayType(T.StringType())),
                           T.StructField("cost", T.IntegerType()), T.StructField("out_turn", T.LongType()), T.StructField("piece", T.StringType())])
    columns = schema.names
    counts = {r["part"]: r["n"] for r in borders}

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), []
        for k, (conv, rows) in enumerate(_segments(batches)):
            at = known[part]
            entry, leave, made, goes_on = at["first"] if k == 0 and "first" in at else at["last"] if k == counts[part] - 1 and "last" in at else (0, None, 0, False)
            roles = [_role(r[2]) for r in rows]
            state = entry
            for n, (row, role, to) in enumerate(zip(rows, roles, decode(roles, entry, leave))):
                cost, action, before = _MOVES[role][state, to]
                piece = JOIN if action == "merge" else (_CLOSE if state else "") + "".join(_open(r) + _CLOSE for r in before) + _open(to)
                piece += _escape(row[3] if row[3] is not None else "")
                made += len(before) + (action != "merge")
                end = _END[to] if n == len(rows) - 1 and not goes_on else ()
                if n == len(rows) - 1 and not goes_on:
                    piece += _CLOSE + "".join(_open(r) + _CLOSE for r in end)
                out.append((conv, None if pd.isna(row[1]) else int(row[1]), row[2], STATES[to], action, [STATES[r] for r in before],
                            [STATES[r] for r in end], cost + INSERT * len(end), made - 1, piece))
                state = to
            if len(out) > 5000:
                yield _frame(out, columns)
                out = []
        yield _frame(out, columns)

    return dealt.mapInPandas(write, schema)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=columns, dtype=object)
    return df.assign(conv_id=df["conv_id"].astype("Int64"), turn=df["turn"].astype("Int64"))
