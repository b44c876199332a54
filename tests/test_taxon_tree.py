"""Nested intervals against a plain walk of the tree."""

import random

import pytest
from pyspark.sql import functions as F

from hostlens.operators import taxon_tree as TT
from hostlens.operators.joins import lookup_join

EDGES = "node string, parent string"


def brute(edges):
    """node -> (parent, depth, descendants, numbered in pre-order) of all nodes that hang from a root."""
    up = {}
    for n, p in sorted(((n, p) for n, p in edges if n is not None), key=lambda e: (e[1] is None, e[1] or "")):
        up.setdefault(n, p)
    up = {n: p if p in up else None for n, p in up.items()}
    below = {}
    for n, p in up.items():
        below.setdefault(p, []).append(n)
    out, order = {}, []
    stack = [(n, 1) for n in sorted(below.get(None, []), reverse=True)]
    while stack:
        n, depth = stack.pop()
        order.append(n)
        out[n] = (up[n], depth)
        stack += [(c, depth + 1) for c in sorted(below.get(n, []), reverse=True)]
    size = dict.fromkeys(out, 1)
    for n in reversed(order):
        if up[n] is not None:
            size[up[n]] += size[n]
    return {n: (*out[n], i + 1, i + size[n]) for i, n in enumerate(order)}


def found(df):
    rows = df.collect()
    got = {r["node"]: (r["parent"], r["depth"], r["lo"], r["hi"]) for r in rows}
    assert len(got) == len(rows)
    return got


def tree(seed, n, hot=0):
    """A random forest; ``hot`` further children of one node, which then holds over a third of all."""
    r = random.Random(seed)
    names = [f"t{r.randrange(10**9)}" for _ in range(n)]
    edges = [(names[i], names[r.randrange(max(0, i - 20), i)] if i and r.random() > .02 else None) for i in range(n)]
    edges += [(f"h{i}", names[3]) for i in range(hot)]
    r.shuffle(edges)
    return edges


@pytest.mark.parametrize("n,hot", [(1, 0), (7, 0), (150, 100)])
def test_against_a_plain_walk(spark, n, hot):
    edges = tree(n, n, hot)
    assert found(TT.nested_intervals(spark.createDataFrame(edges, EDGES).repartition(3))) == brute(edges)


def test_orphans_two_parents_cycles(spark):
    edges = [("a", None), ("b", "a"), ("c", "b"), ("c", "a"), ("d", "nowhere"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s"), (None, "a"), ("b", "a"), ("f", None)]
    want = {n: v for n, v in brute(edges).items()}
    got = found(TT.nested_intervals(spark.createDataFrame(edges, EDGES)))
    assert got == want and {"x", "y", "z", "s"}.isdisjoint(got) and got["c"][0] == "a" and got["d"][0] is None
    assert TT.nested_intervals(spark.createDataFrame([], EDGES)).count() == 0


def test_a_chain_takes_logarithmic_rounds(spark, monkeypatch):
    jumps, jump = [], TT._jump
    monkeypatch.setattr(TT, "_jump", lambda t: jumps.append(1) or jump(t))
    chain = spark.range(10_000).selectExpr("format_string('n%05d', id) AS node", "IF(id > 0, format_string('n%05d', id - 1), NULL) AS parent")
    got = found(TT.nested_intervals(chain))
    assert len(jumps) <= 18
    assert got == {f"n{i:05d}": (f"n{i - 1:05d}" if i else None, i + 1, i + 1, 10_000) for i in range(10_000)}


def test_sums_and_members(spark, monkeypatch):
    monkeypatch.setattr(TT, "BLOCK", 8)
    edges = tree(4, 90, 40)
    want = brute(edges)
    values = {n: i % 7 for i, n in enumerate(sorted(want)) if i % 3}
    t = TT.nested_intervals(spark.createDataFrame(edges, EDGES))
    rows = TT.subtree_sums(t, spark.createDataFrame([*values.items(), ("stranger", 5)], "node string, n long"), "n").collect()
    under = {n: [m for m in want if want[n][2] <= want[m][2] <= want[n][3]] for n in want}
    assert {r["node"]: (r["n_below"], r["n"]) for r in rows} == {n: (len(m) - 1, sum(values.get(x, 0) for x in m)) for n, m in under.items()}
    asked = sorted(want)[::5]
    got = TT.members(t, spark.createDataFrame([(a,) for a in [*asked, "stranger"]], "taxon string"), block=8).collect()
    assert sorted(map(tuple, got)) == sorted((a, m) for a in asked for m in under[a])


def test_edges_from_lineages(spark):
    df = spark.createDataFrame([("Vaccinia", "Viruses; Poxviridae ;Orthopoxvirus"), ("Viruses", None), ("Cowpox", "Viruses;Poxviridae;Orthopoxvirus;"), (None, "x")], "name string, lineage string")
    got = sorted((r["node"], r["parent"]) for r in TT.edges_from_lineages(df, "name", "lineage").where(F.col("parent").isNotNull()).collect())
    assert got == [("Cowpox", "Orthopoxvirus"), ("Orthopoxvirus", "Poxviridae"), ("Poxviridae", "Viruses"), ("Vaccinia", "Orthopoxvirus")]
    assert found(TT.nested_intervals(TT.edges_from_lineages(df, "name", "lineage")))["Orthopoxvirus"] == ("Poxviridae", 3, 3, 5)


def test_lookup_join(spark):
    left = spark.createDataFrame([(("hot", None, f"k{i}")[i % 3], i) for i in range(90)], "k string, i long")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k5", 3), ("other", 4)], "k string, v long")
    for parts in (1, 10, 10_000):
        got = {r["i"]: r["v"] for r in lookup_join(left, right, "k", parts).collect()}
        assert got == {i: 1 if i % 3 == 0 else {2: 2, 5: 3}.get(i) for i in range(90)}


def test_rounds_go_by_depth(spark, monkeypatch):
    """A flat tree takes few rounds however many nodes it has, also with roots that hold nothing and a cycle."""
    jumps, jump = [], TT._jump
    monkeypatch.setattr(TT, "_jump", lambda t: jumps.append(1) or jump(t))
    edges = [("top", None), *((f"g{i}", "top") for i in range(20)), *((f"s{i}", f"g{i % 20}") for i in range(400)), *((f"r{i}", None) for i in range(300))]
    assert found(TT.nested_intervals(spark.createDataFrame(edges, EDGES))) == brute(edges)
    assert len(jumps) <= 2
    assert found(TT.nested_intervals(spark.createDataFrame([*edges[:50], ("x", "y"), ("y", "x"), ("z", "x")], EDGES))) == brute(edges[:50])
