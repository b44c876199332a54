"""Conversation structure repair at least cost, by dynamic programming over runs.

Every row of a conversation is a symbol: the initial of its role and its
fault.  An automaton of four states accepts the legal sequences of role
initials, ``(s?(ua)+)?``, so a symbol is a 4 x 4 matrix of edit costs and rows
in sequence are a (min, +) product.  Equal consecutive symbols collapse to a
run, and a run of n rows is a product of cached binary powers of one matrix.
Every power remembers the state in its middle, so the choices are unrolled
from the powers afterwards, which gives the audit.

Beside the cost a matrix keeps the order of the least audits that lead from a
state to the four others.  Audits that consume the same rows and end with a
row's letter are never prefixes of one another, so this order survives
products, and the least of all cheapest audits is found exactly.

Rows are dealt out by ranges of (conversation, turn): a conversation of any
length may span many tasks.  Each task reports the products of its first and
last conversation, the driver chains those that cross a border (two per task),
and each task then unrolls its own rows between known states.  A row that
repeats an earlier one gets a marker from an aggregation over (conversation,
role, text), which travels to the row's place in the same exchange.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import checkpointed, width

STATES = ("", "system", "user", "assistant")         # what the last legal row was
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAULTS = ("", "blank", "duplicate", "truncated")
_AFTER = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}      # states that may follow
_MADE = {0: 2, 1: 2, 2: 3, 3: 2}                     # state after an inserted or reroled row
_INSERTS = {(0, 0): 0, (0, 2): 1, (0, 3): 2, (1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 2): 0, (2, 3): 1, (3, 3): 0, (3, 2): 1}
_TO_END = (0, 2, 1, 0)                               # inserts that complete a conversation
_INITIAL = {"s": 1, "u": 2, "a": 3}
_FAR = 1 << 50
_BLANKS = " \t\n\x0b\f\r"
_CHUNK = 1 << 20
MUST_DELETE = 0                                      # the symbol of blank and duplicate rows


def symbol(role: str, fault: int) -> int:
    """Number of a row's symbol: its initial's state, doubled, plus 1 if truncated, from 1 on."""
    return MUST_DELETE if fault in (1, 2) else 1 + 2 * _INITIAL.get(role[:1], 0) + (fault == 3)


class Element:
    """Costs of some rows from state to state, and the order of their least audits."""

    __slots__ = ("cost", "rank", "mid")

    def __init__(self, cost, rank, mid=None):
        self.cost, self.rank, self.mid = cost, rank, mid

    def packed(self) -> list[int]:
        return [int(x) for m in (self.cost, self.rank) for r in m for x in r]

    @staticmethod
    def unpacked(x) -> Element:
        m = np.array(x).reshape(2, 4, 4).tolist()
        return Element(*m)


def _ranks(keys: list) -> list[int]:
    order = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [order[k] for k in keys]


@lru_cache(maxsize=None)
def _letters(sym: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, edits) of the cheapest, then least, way from state to state by one row."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    state, late = divmod(sym - 1, 2)
    for (s, mid), n in _INSERTS.items():
        ways = [(mid, DELETE, "D")]
        if sym != MUST_DELETE:
            ways.append((_MADE[mid], REROLE + late * TRUNCATED, "R"))
            if state in _AFTER[mid]:
                ways.append((state, KEEP + late * TRUNCATED, "K"))
        for t, cost, letter in ways:
            way = (n * INSERT + cost, "I" * n + letter)
            out[s, t] = min(out.get((s, t), way), way)
    return out


@lru_cache(maxsize=None)
def power(sym: int, k: int) -> Element:
    """2 ** k rows of one symbol."""
    if k:
        half = power(sym, k - 1)
        return product(half, half)
    way = _letters(sym)
    return Element([[way.get((s, t), (_FAR,))[0] for t in range(4)] for s in range(4)],
                   [_ranks([way.get((s, t), (_FAR, f"~{t}"))[1] for t in range(4)]) for s in range(4)])


def advance(cost: list, rank: list, e: Element) -> tuple[list, list, list]:
    """Costs, order and middle states after ``e`` of ways with these costs and order."""
    mids, costs, keys = [], [], []
    for t in range(4):
        c, _, m = min((cost[m] + e.cost[m][t], rank[m], m) for m in range(4))
        mids.append(m)
        costs.append(min(c, _FAR))
        keys.append((rank[m], e.rank[m][t], t if c >= _FAR else -1))
    return costs, _ranks(keys), mids


def product(a: Element, b: Element) -> Element:
    rows = [advance(a.cost[s], a.rank[s], b) for s in range(4)]
    return Element([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def powers(symbols: list[int]) -> list[tuple[int, int]]:
    """Runs of equal symbols as binary powers: (symbol, k) for 2 ** k rows."""
    out = []
    for sym, run in itertools.groupby(symbols):
        n = sum(1 for _ in run)
        out += [(sym, k) for k in reversed(range(n.bit_length())) if n >> k & 1]
    return out


def whole(symbols: list[int]) -> Element:
    """The product of all rows."""
    e = Element([[0 if s == t else _FAR for t in range(4)] for s in range(4)], [[0 if s == t else 1 + t for t in range(4)] for s in range(4)])
    for p in powers(symbols):
        e = product(e, power(*p))
    return e


def states_between(elements: list[Element], entry: int, leave: int | None) -> list[int]:
    """The states around each element on the best way from ``entry`` to ``leave``,
    or to the cheapest completion."""
    cost, rank = [0 if s == entry else _FAR for s in range(4)], [0 if s == entry else 1 + s for s in range(4)]
    back = []
    for e in elements:
        cost, rank, mids = advance(cost, rank, e)
        back.append(mids)
    at = min(range(4), key=lambda s: (cost[s] + INSERT * _TO_END[s], rank[s])) if leave is None else leave
    out = [at]
    for mids in reversed(back):
        out.append(at := mids[at])
    return out[::-1]


@lru_cache(maxsize=1 << 16)
def unroll(sym: int, k: int, s: int, t: int) -> str:
    """The edits of 2 ** k rows from state ``s`` to ``t``."""
    if not k:
        return _letters(sym)[s, t][1]
    m = power(sym, k).mid[s][t]
    return unroll(sym, k - 1, s, m) + unroll(sym, k - 1, m, t)


def edits(symbols: list[int], entry: int = 0, leave: int | None = None) -> str:
    """Cheapest edits of rows between two states, the ASCII-least of equals; with
    ``leave`` None up to a complete conversation."""
    return _edits(tuple(powers(symbols)), entry, leave) if len(symbols) <= 64 else _edits.__wrapped__(tuple(powers(symbols)), entry, leave)


@lru_cache(maxsize=1 << 14)
def _edits(parts: tuple, entry: int, leave: int | None) -> str:
    at = states_between([power(*p) for p in parts], entry, leave)
    out = "".join(unroll(*p, s, t) for p, s, t in zip(parts, at, at[1:]))
    return out + "I" * _TO_END[at[-1]] if leave is None else out


def _batches_of_runs(batches: Iterator[pd.DataFrame], text: bool) -> Iterator[tuple[tuple, list]]:
    """((part, conversation known, conversation), rows) of each conversation in a
    task; a row is (turn, role, text, fault)."""
    names = ["part", "c1", "conv", "t1", "turn", "role", "sha", "kind", "blank", "cut", *(["text"] if text else [])]
    now, before, rows = None, None, []
    for b in batches:
        for row in zip(*(b[c].tolist() for c in names)):
            if row[:3] != now:
                if now is not None:
                    yield now, rows
                now, rows = row[:3], []
            key = row[1:7]
            if row[7] == 1:
                fault = 1 if row[8] else 2 if key == before else 3 if row[9] else 0
                rows.append((row[4] if row[3] else None, row[5], row[10] if text else None, fault))
            before = key
    if now is not None:
        yield now, rows


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per task: its first and last conversation and their products."""
    first = last = None
    n = 0
    for at, rows in _batches_of_runs(batches, False):
        symbols = [symbol(r[1], r[3]) for r in rows]
        if first is None:
            first = (at, whole(symbols).packed())
        last = (at, symbols)
        n += 1
    if n:
        yield pd.DataFrame({"part": [first[0][0]], "n": [n], "first": [list(map(int, first[0][1:]))], "last": [list(map(int, last[0][1:]))],
                            "a": [first[1]], "b": [whole(last[1]).packed()]})


def _borders(dealt: DataFrame) -> dict[tuple, tuple[int, int, bool]]:
    """(entry, exit, whether it ends here) of every part of the conversations that cross tasks."""
    light = dealt.drop("text")
    tasks = sorted(light.mapInPandas(_report, "part int, n int, first array<long>, last array<long>, a array<long>, b array<long>").collect(),
                   key=lambda r: r["part"])  # one row per task
    known, i = {}, 0
    while i < len(tasks):
        j = i
        while j + 1 < len(tasks) and tasks[j]["last"] == tasks[j + 1]["first"] and (j == i or tasks[j]["n"] == 1):
            j += 1
        if j > i:
            at = states_between([Element.unpacked(tasks[k]["b" if k == i else "a"]) for k in range(i, j + 1)], 0, None)
            for k, s, t in zip(range(i, j + 1), at, at[1:]):
                known[tasks[k]["part"], bool(tasks[i]["last"][0]), tasks[i]["last"][1]] = (s, t, k == j)
        i = j if j > i else i + 1
    return known


_TURNS = ("part int, seq long, c1 boolean, conv long, t1 boolean, turn long, role string, fault string, edit string, "
          "new_role string, text string, cost long")


def _edited(known: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size, names = [], 0, [c.split()[0] for c in _TURNS.split(", ")]
        for at, rows in _batches_of_runs(batches, True):
            entry, leave, ends = known.get(at, (0, None, True))
            letters = edits([symbol(r[1], r[3]) for r in rows], entry, leave)
            if ends and leave is not None:
                letters += "I" * _TO_END[leave]
            if not rows:        # names the conversation; where another part ends it may still hold inserts
                out.append((at[0], -1, at[1], at[2], False, 0, None, "", "", None, None, 0))
            state, left = entry, iter(rows)
            for i, letter in enumerate(letters):
                if letter == "I":
                    state = _MADE[state]
                    out.append((at[0], i, at[1], at[2], False, 0, None, "", "I", STATES[state], "", INSERT))
                    continue
                turn, role, text, fault = next(left)
                cost = {"K": KEEP, "R": REROLE, "D": DELETE}[letter] + (fault == 3 and letter != "D") * TRUNCATED
                if letter == "K":
                    state = _INITIAL[role[0]]
                elif letter == "R":
                    state = _MADE[state]
                new = None if letter == "D" else role if letter == "K" else STATES[state]
                out.append((at[0], i, at[1], at[2], turn is not None, turn or 0, role, FAULTS[fault], letter, new, text, cost))
                size += len(text)
                if len(out) >= 5000 or size >= 16 * _CHUNK:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
        yield pd.DataFrame(out, columns=names)
    return run


class Summary:
    """Counts, edits and text of consecutive repaired rows."""

    def __init__(self):
        self.faults, self.illegal, self.cost, self.lines = dict.fromkeys(FAULTS, 0), 0, 0, 0
        self.edits, self.role, self.first_role = [], None, None
        self.turns, self.low, self.high = 0, None, None

    def row(self, turn, role, fault, edit, new_role, text, cost) -> bytes:
        """Take in a row; its line of the repaired text, a line break before all but the first."""
        self.edits.append(edit)
        self.cost += cost
        if role is not None:
            self.faults[fault] += 1
            if self.first_role is None:
                self.first_role = role[:1]
            else:
                self.illegal += self.role + role[:1] not in ("su", "ua", "au")
            self.role = role[:1]
            if turn is not None and turn != self.high:
                self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        if new_role is None:
            return b""
        self.lines += 1
        return (("\n" if self.lines > 1 else "") + f"{new_role}:{text}").encode()

    def packed(self) -> tuple:
        return ([*self.faults.values(), self.illegal, self.cost, self.lines, self.turns], [self.low, self.high], [self.first_role, self.role], "".join(self.edits))

    def add(self, counts, turns, roles, letters) -> bytes:
        """Take in the packed summary of the rows that follow; what goes between the texts."""
        *faults, illegal, cost, lines, n = map(int, counts)
        for name, x in zip(FAULTS, faults):
            self.faults[name] += x
        if roles[0] is not None:
            if self.role is None:
                self.first_role = roles[0]
            else:
                illegal += self.role + roles[0] not in ("su", "ua", "au")
            self.role = roles[1]
        self.illegal, self.cost = self.illegal + illegal, self.cost + cost
        if n:
            self.turns += n - (self.high == turns[0])
            self.low, self.high = turns[0] if self.low is None else self.low, turns[1]
        self.edits.append(letters)
        between = b"\n" if self.lines and lines else b""
        self.lines += lines
        return between

    def result(self, c1: bool, conv: int, sha) -> tuple:
        gaps = 0 if self.low is None else int(self.high) - int(self.low) + 1 - self.turns
        return (c1, conv, min(gaps, 2**63 - 1), self.faults["blank"], self.faults["duplicate"], self.faults["truncated"],
                self.illegal, self.cost, "".join(self.edits), sha.hexdigest())


_RESULT = ("c1 boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_PIECE = "part int, piece int, c1 boolean, conv long, counts array<long>, turns array<string>, roles array<string>, edits string, body binary"


def _frame(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _turn_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator]]:
    def rows():
        for b in batches:
            yield from zip(*(b[c].tolist() for c in ("part", "c1", "conv", "t1", "turn", "role", "fault", "edit", "new_role", "text", "cost")))

    for at, run in itertools.groupby(rows(), key=lambda r: r[:3]):
        yield at, ((r[4] if r[3] else None, *r[5:]) for r in run)


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The result row of each conversation; all its rows are in this task."""
    out = []
    for (_, c1, conv), rows in _turn_rows(batches):
        s, sha = Summary(), hashlib.sha256()
        for r in rows:
            sha.update(s.row(*r))
        out.append(s.result(c1, conv, sha))
        if len(out) >= 5000:
            yield _frame(out, _RESULT)
            out = []
    yield _frame(out, _RESULT)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """This task's part of each conversation: its summary, and its text in pieces."""
    for (part, c1, conv), rows in _turn_rows(batches):
        s, body, size, n = Summary(), [], 0, 1
        for r in rows:
            body.append(s.row(*r))
            size += len(body[-1])
            if size >= _CHUNK:
                yield _frame([(part, n, c1, conv, None, None, None, None, b"".join(body))], _PIECE)
                body, size, n = [], 0, n + 1
        yield _frame([(part, n, c1, conv, None, None, None, None, b"".join(body))], _PIECE)
        counts, turns, roles, letters = s.packed()
        yield _frame([(part, 0, c1, conv, counts, [None if t is None else str(t) for t in turns], roles, letters, None)], _PIECE)


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The result rows from pieces in order of conversation, part and piece."""
    def rows():
        for b in batches:
            yield from zip(*(b[c].tolist() for c in ("c1", "conv", "piece", "counts", "turns", "roles", "edits", "body")))

    for (c1, conv), run in itertools.groupby(rows(), key=lambda r: r[:2]):
        s, sha = Summary(), hashlib.sha256()
        for _, _, piece, counts, turns, roles, letters, body in run:
            sha.update(body if piece else s.add(counts, [None if t is None else int(t) for t in turns], roles, letters))
        yield _frame([s.result(c1, conv, sha)], _RESULT)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """The benchmark damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped
    (0), emptied (1), loses its ``.!?`` (2), comes twice (3) or becomes a user's (4).

    Nulls count as one space.  Dropped rows stay in the table for the sake of
    their conversation; the second value is the condition that a row is there."""
    def text_of(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    k = (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20).cast("int")
    out = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), k.alias("k"))
    out = out.withColumn("text", F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("k") == 4, "user").otherwise(F.col("role")))
    return out.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))), F.col("k") != 0


def _dealt(turns: DataFrame, there: Column) -> DataFrame:
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    trimmed = F.rtrim(text, F.lit(_BLANKS))
    rows = turns.select(
        F.col("conv_id").isNotNull().alias("c1"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("t1"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.when(there, 1).otherwise(2).alias("kind"),
        (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"), text.alias("text"))
    key = ["c1", "conv", "role", "sha"]
    # a marker goes to every place of a (role, text) but the earliest
    real = rows.where("kind = 1 AND NOT blank").select(*key, "t1", "turn").distinct()
    first = real.groupBy(*key).agg(F.min(F.struct("t1", "turn")).alias("at")).select(*key, "at.t1", "at.turn")
    markers = real.join(first, [*key, "t1", "turn"], "left_anti").selectExpr(
        "c1", "conv", "t1", "turn", "role", "sha", "0 AS kind", "false AS blank", "false AS cut", "'' AS text")
    order = ["c1", "conv", "t1", "turn", "role", "sha"]
    return checkpointed(rows.unionByName(markers).repartitionByRange(width(turns.sparkSession), *order)
                        .sortWithinPartitions(*order, "kind").withColumn("part", F.spark_partition_id()))


def _crosses(known: dict) -> Column:
    """Whether a row's conversation lies in several tasks (at most one per border)."""
    ids = sorted({conv for _, c1, conv in known if c1})
    return F.when(F.col("c1"), F.col("conv").isin(ids)).otherwise(F.lit(any(not c1 for _, c1, _ in known)))


def repair(turns: DataFrame, there: Column | None = None) -> DataFrame:
    """The edits that repair each conversation of ``turns`` (conv_id, turn, role, text).

    One row per edit in order of (conv_id, part, seq): conv_id, part, seq, turn,
    role, fault (of the input row: '', blank, duplicate or truncated), edit
    (K, R, D or I), new_role (null for deleted rows), text and cost.  Rows for
    which ``there`` is not true are not part of the conversation.

    Rows go by turn, nulls first; rows of one turn by role, then by the hash of
    the text.  A null role or text is one space, rows without conv_id form one
    conversation.  conv_id and turn must be integers.  Rows that repeat a role
    and text are duplicates after the first, repeated rows too.  Unknown
    initials of roles cannot be kept.  An empty table gives no rows; other
    columns are not read.  Texts of any length; a task holds those of the
    conversation it works on, at most its own share of the table.
    """
    dealt = _dealt(turns, F.lit(True) if there is None else there)
    return dealt.mapInPandas(_edited(_borders(dealt)), _TURNS).where("edit <> ''").select(
        F.expr("IF(c1, conv, NULL)").alias("conv_id"), "part", "seq", F.expr("IF(t1, turn, NULL)").alias("turn"),
        "role", "fault", "edit", "new_role", "text", "cost")


def summarise(turns: DataFrame, there: Column | None = None) -> DataFrame:
    """One row per conversation of ``turns``, also of those without rows ``there``.

    conv_id, gaps in the turn numbers, blank, duplicate and truncated rows
    (first fault of each), illegal neighbours, cost and audit of the repair (see
    ``repair``, also for nulls, ties and repeated rows) and the SHA-256 of the
    repaired text.  A digest of a conversation that spans tasks is taken in one
    task over pieces of its text; all the rest is done where the rows are.
    Gaps beyond 2^63 - 1 are given as that.
    """
    dealt = _dealt(turns, F.lit(True) if there is None else there)
    known = _borders(dealt)
    crosses, n = _crosses(known), width(turns.sparkSession)
    inner = dealt.where(~crosses).mapInPandas(_edited({}), _TURNS).mapInPandas(_summed, _RESULT)
    pieces = dealt.where(crosses).mapInPandas(_edited(known), _TURNS).mapInPandas(_pieces, _PIECE)
    outer = pieces.repartition(n, "c1", "conv").sortWithinPartitions("c1", "conv", "part", "piece").mapInPandas(_joined, _RESULT)
    return inner.unionByName(outer).select(F.expr("IF(c1, conv, NULL)").alias("conv_id"), "gaps", "blank", "duplicate", "truncated",
                                           "illegal", "cost", "audit", "repaired_sha256")
