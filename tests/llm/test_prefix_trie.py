import hashlib
import random
import re
import zlib

import pytest

from hostlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def expected(rows, borrow=True):
    """(conv_id, depth) -> the other columns, by a plain trie of nested prefixes."""
    chats = {}
    for c, turn, role, text in rows:
        if c is not None:
            chats.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    chats = {c: [r[3] for r in sorted(x)] for c, x in chats.items()}
    built = {}
    for c, own in chats.items():
        h = zlib.crc32(str(c).encode()) % 4 if borrow else 0
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(chats.get(donor, [])[:h] + own[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = {}
    for node, ids in members.items():
        below = [n for n in members if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in ids if built[c] == node)))
        out[min(ids), len(node)] = (min(members[node[:-1]]) if node else None, len(ids), len(children), len(leaves), saved,
                                    hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(got) == len(rows)
    return got


def chats(seed, n, hot_turns=0, hot_copies=0):
    r = random.Random(seed)
    texts = ["hi there", "ok", "", None, "one two\tthree", "Öl  é x"]
    rows = [(c, r.choice([t, t, None, r.randrange(4)]), r.choice(["user", "assistant", None]), r.choice(texts[:2 if (c or 0) % 3 else 6]))
            for c in [*range(-25, n), 2**63 - 1, -2**63, None] for t in range(r.randrange(1, 6))]
    rows += [(5000, t, "user", f"t{t // 2} x") for t in range(hot_turns)]
    rows += [(6000 + 20 * i, t, "user", "same") for i in range(hot_copies) for t in range(2)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [1, 4, 23])
def test_against_a_plain_trie(spark, monkeypatch, width):
    """With one long conversation, many equal ones, and blocks and pieces so small that all borders are met."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "_CHUNK", 60)
    rows = chats(4, 60, hot_turns=90, hot_copies=40)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        assert found(prefix_trie.shared_openings(df)) == expected(rows)
        assert found(prefix_trie.prefix_trie(df)) == expected(rows, borrow=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_awkward(spark):
    assert prefix_trie.shared_openings(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.shared_openings(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    turnless = next(c for c in range(21, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    rows = [(turnless, 0, "user", "gone"), (3000, None, None, None), (3000, None, None, None), (3000, 1, "user", "w " * 200_000)]
    clash = spark.createDataFrame([(*r, 7, "x", True, 1) for r in rows], SCHEMA + ", conv long, node string, own boolean, depth long")
    got = found(prefix_trie.shared_openings(clash))
    assert got == expected(rows) and got[turnless, 0][1] == 2
