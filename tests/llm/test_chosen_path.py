import random

import pytest

from hostlens.llm import chosen_path, queries
from hostlens.llm.graph import components

from .conftest import AWKWARD, SF, docs_of, prose


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num=80, den=100):
    """Set size and component of every row (ids unique)."""
    s = {i: sets(t, k) for i, t in rows}
    comp = {i: i for i in s}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(s[i]), root(i)) for i in ids}


def variant(text, r, changes):
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
    return " ".join(w)


def check(spark, rows, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           chosen_path.near_duplicates(docs_of(spark, rows, clash=True), shingle=k).collect()}
    assert got == brute(rows, k)


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, k):
    r, rows = random.Random(k), []
    for g in range(40):
        base = prose(g, 120, 5000)
        rows += [(len(rows) + j, base if j == 0 else variant(base, r, r.randrange(0, 12))) for j in range(r.randrange(1, 7))]
    r.shuffle(rows)
    check(spark, rows, k)


def test_large_groups_take_every_path(spark, monkeypatch):
    """Nodes that stay large down to the last level, groups over several blocks, chains of links."""
    monkeypatch.setattr(chosen_path, "SMALL", 6)
    monkeypatch.setattr(chosen_path, "BLOCK", 20)
    r, rows = random.Random(5), []
    base = prose(1, 150, 5000)
    rows += [(i, variant(base, r, 4)) for i in range(90)]
    chain = prose(2, 150, 5000)
    for i in range(60):
        chain = variant(chain, r, 5)
        rows.append((1000 + i, chain))
    common = prose(3, 100, 5000)  # half of every text is shared, no links
    rows += [(2000 + i, common + " " + prose(100 + i, 100, 5000)) for i in range(60)]
    rows += [(3000 + i, base) for i in range(50)]
    check(spark, rows, 2)


@pytest.mark.parametrize("limit", ["BLOCK", "BLOCK_SHINGLES"])
def test_texts_follow_only_alike_sketches(spark, monkeypatch, scratch_dir, limit):
    """A group of texts that share a passage, dealt over blocks: texts are read once, and again only of alike pairs."""
    monkeypatch.setattr(chosen_path, limit, {"BLOCK": 20, "BLOCK_SHINGLES": 4000}[limit])
    real = chosen_path._confirm

    def counting(*args):
        run = real(*args)

        def seen(batches):
            for b in batches:
                with open(f"{scratch_dir}/rows", "a") as f:
                    f.write(f"{len(b)}\n")
                yield b

        return lambda batches: run(seen(batches))

    monkeypatch.setattr(chosen_path, "_confirm", counting)
    r, common = random.Random(3), prose(3, 60, 5000)
    rows = [(i, common + " " + prose(100 + i, 140, 5000)) for i in range(120)]
    rows += [(200 + i, variant(rows[i][1], r, 2)) for i in (30, 60, 90, 95)]
    docs = docs_of(spark, rows)
    classes = chosen_path._sketches(docs, 2).selectExpr("*", "doc_id AS id")
    groups = classes.where("id > 0").selectExpr("id as u", "0L as v")
    got = {tuple(sorted(e)) for e in chosen_path._confirmed(docs, classes, groups, 2, 80, 100).collect()}
    assert got == {(i, 200 + i) for i in (30, 60, 90, 95)}
    with open(f"{scratch_dir}/rows") as f:
        assert len(rows) < sum(map(int, f)) < 2 * len(rows)


def test_threshold_is_exact(spark):
    w = [f"q{i}" for i in range(40)]
    a = " ".join(w[:10])                     # 9 shingles
    exact = " ".join(w[:9])                  # 8 of 9 shared: 0.889
    rows = [(1, a), (2, exact), (3, " ".join(w[20:25])), (4, " ".join(w[20:26])), (5, " ".join(w[20:25] + ["x"]))]
    check(spark, rows, 2)                    # 4 of 5 shared: 0.8 is a link; 4 of 6 is none


def test_awkward_rows(awkward, no_docs):
    rows = chosen_path.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert sorted((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None) == [
        (1, True, 1, True), (1, True, 1, True), (2, True, 1, False), (3, False, 3, True), (4, False, 4, True), (5, False, 5, True),
        (6, True, 6, True), (7, True, 7, True), (8, True, 8, True), (9, True, 9, True)]
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert chosen_path.near_duplicates(no_docs).count() == 0


def test_query_over_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9(spark, SF).collect()} == brute(docs, 2)


def test_components_of_paths_and_stars(spark):
    r = random.Random(3)
    path = list(range(100, 140))
    r.shuffle(path)
    edges = list(zip(path, path[1:])) + [(5, i) for i in range(6, 60)] + [(7, 7), (300, 301), (301, 300)]
    got = {x["u"]: x["v"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 140)}, **{i: 5 for i in range(6, 60)}, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_an_id_with_several_texts_is_linked_through_each(spark):
    """20 ids with two unlike texts each; the first, then the second, has a near copy under another id."""
    r = random.Random(9)
    rows = []
    for i in range(20):
        a, b = prose(2 * i, 120, 5000), prose(2 * i + 1, 120, 5000)
        rows += [(1000 + i, a), (1000 + i, b), (2000 + i, variant(a, r, 1)), (500 + i, variant(b, r, 1))]
    r.shuffle(rows)
    got = {(x["doc_id"], x["component_id"]) for x in chosen_path.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {(d + i, 500 + i) for i in range(20) for d in (500, 1000, 2000)}


def test_ids_of_other_types(spark):
    r, base = random.Random(2), prose(1, 120, 5000)
    rows = [("b", base), ("a", variant(base, r, 2)), ("c", prose(5, 120, 5000)), (None, base)]
    out = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(x["doc_id"], x["component_id"], x["kept"]) for x in out} == {("a", "a", True), ("b", "a", False), ("c", "c", True), (None, None, True)}
    wide = [(-2**63, base), (2**63 - 1, variant(base, r, 2)), (0, prose(6, 120, 5000))]
    out = chosen_path.near_duplicates(docs_of(spark, wide)).collect()
    assert {x["doc_id"]: x["component_id"] for x in out} == {-2**63: -2**63, 2**63 - 1: -2**63, 0: 0}
