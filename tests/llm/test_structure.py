import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from hostlens.llm import queries, structure

from .conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, edits) of rows (initial, fault), by trying every edit at every place."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def go(i, last, inserted):
        best = (0, "") if i == len(rows) and last in ("", "a") else (10**9, "")
        if i < len(rows):
            initial, fault = rows[i]
            c, s = go(i + 1, last, 0)
            best = min(best, (c + 3, "D" + s))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if initial and initial in step[last]:
                    c, s = go(i + 1, initial, 0)
                    best = min(best, (c + late, "K" + s))
                for to in "ua":
                    if to in step[last]:
                        c, s = go(i + 1, to, 0)
                        best = min(best, (c + 2 + late, "R" + s))
        if inserted < 3:
            for to in "ua":
                if to in step[last]:
                    c, s = go(i, to, inserted + 1)
                    best = min(best, (c + 2, "I" + s))
        return best

    return go(0, "", 0)


def damage(rows):
    out, there = [], []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
        there += [k != 0] * (2 if k == 3 else 1)
    return out, there


def expected(rows, there=None):
    """conv_id -> the other columns, by a plain loop over each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r, t in zip(rows, there or [True] * len(rows)) if r[0] == conv and t]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            body = text.strip(BLANKS)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        cost, audit = cheapest(tuple(zip(initials, faults)))
        last, left, lines = "", iter(mine), []
        for e in audit:
            row = None if e == "I" else next(left)
            if e == "D":
                continue
            role = row[2] if e == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{row[3] if row else ''}")
        turns = [r[1] for r in mine if r[1] is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_powers_against_every_edit():
    """All short sequences, and long ones of few symbols; ties go to the least audit."""
    kinds = [("s", ""), ("u", ""), ("a", ""), ("u", "truncated"), ("a", "truncated"), ("x", ""), ("u", "blank")]
    number = {k: structure.symbol(k[0], structure.FAULTS.index(k[1])) for k in kinds}
    r = random.Random(3)
    cases = [c for n in range(4) for c in itertools.product(kinds, repeat=n)]
    cases += [tuple(itertools.chain(*([r.choice(kinds)] * r.choice([1, 1, 2, 7, 33]) for _ in range(r.randrange(1, 9))))) for _ in range(150)]
    for case in cases:
        symbols = [number[k] for k in case]
        cost, audit = cheapest(case)
        assert structure.edits(symbols) == audit, case
        e = structure.whole(symbols)
        assert min(e.cost[0][t] + 2 * structure._TO_END[t] for t in range(4)) == cost
        # cut anywhere: chained products give the same states, hence the same audit
        cuts = sorted(r.randrange(len(case) + 1) for _ in range(2))
        parts = [symbols[i:j] for i, j in zip([0, *cuts], [*cuts, len(case)])]
        at = structure.states_between([structure.Element.unpacked(structure.whole(p).packed()) for p in parts], 0, None)
        assert "".join(structure.edits(p, s, t) for p, s, t in zip(parts, at, at[1:])) + "I" * structure._TO_END[at[-1]] == audit


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12(spark, SF)) == expected(*damage(rows))


def chats(seed, n, turns, hot=0):
    r = random.Random(seed)
    texts = ["Yes.", "Yes.", "no", "", " \t", "why?", "É!", "a.b", None, "Well then. "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    rows = [(c, r.choice([t, t, None, r.randrange(turns)]), r.choice(roles), r.choice(texts)) for c in [*range(n), None] for t in range(r.randrange(1, turns))]
    rows += [(7000, t, "user" if t % 2 == 0 else "assistant", f"line {t}." if t % 5 else "line") for t in range(hot)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [1, 4, 23])
def test_conversations_across_tasks(spark, width):
    """One conversation holds more than a third of the rows; with many tasks most cross a border."""
    rows = chats(5, 12, 9, hot=120)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        assert found(structure.summarise(df)) == expected(rows)
        harmed, there = damage(rows)
        assert found(structure.summarise(*structure.damaged(df))) == expected(harmed, there)
        assert width < 23 or len({k[1:] for k in structure._borders(structure._dealt(df, F.lit(True)))}) > 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_awkward(spark):
    assert structure.summarise(spark.createDataFrame([], SCHEMA)).count() == 0 == structure.repair(spark.createDataFrame([], SCHEMA)).count()
    rows = [(1, -2**62, "user", "x" * 300_000), (1, 2**62, "assistant", "y."), (None, None, None, None), (None, None, None, None),
            (2, 0, "user", "a."), (2, 0, "user", "a."), (2**63 - 1, 1, "assistant", "é"), (-2**63, 1, "system", "!")]
    clash = spark.createDataFrame([(*r, 7, "x", 1, 0.5) for r in rows], SCHEMA + ", kind long, part string, conv long, sha double")
    assert found(structure.summarise(clash)) == expected(rows)
    gone = structure.summarise(clash, F.col("conv_id") != 2)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(gone)[2] == (0, 0, 0, 0, 0, 0, "", empty)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes"), (1, 2, "user", "Yes"), (1, 3, "user", " ")]
    got = structure.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("part", "seq").collect()
    assert [(r["edit"], r["new_role"], r["fault"]) for r in got] == [
        ("I", "user", ""), ("K", "assistant", ""), ("D", None, "truncated"), ("D", None, "duplicate"), ("D", None, "blank")]
    assert sum(r["cost"] for r in got) == 11 == expected(rows)[1][5]
