import hashlib
import re

import pytest

from hostlens.llm import queries, winnow

from .conftest import AWKWARD, SF, docs_of, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[a:a + n]), set()).add(i)
    lens = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in lens:
            for a in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[a:a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    ids |= {str(i) for i in got if i is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()), key=str)


def passages(spark):
    a, b = prose(11, 40), prose(12, 12)
    items = [(1, a), (2, a), (10, b), (3, "only three words"), (4, "a b a b a b a b a b a b a b"), (5, None), (6, ""), (None, prose(13, 15)), (7, "Straße naïve É")]
    docs = [(1, f"{prose(1, 30)} {a[20:]} {prose(2, 30)}"), (2, " ".join(b.split()[:10])), (3, " ".join(b.split()[:9])),
            (4, "x, ONLY-three; words y"), (5, "a b " * 30), (6, f"{b} {prose(3, 9)} {b}"), (7, prose(13, 15)), (8, "the Straße, NAÏVE É"),
            (9, "the straße naïve É. end"), (6, prose(4, 50)), (None, a)]
    return docs, items


@pytest.mark.parametrize("limit", [winnow.BROADCAST_BYTES, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(winnow, "BROADCAST_BYTES", limit)  # 0: the shuffled join
    docs, items = passages(spark)
    df = winnow.decontaminate(docs_of(spark, docs, clash=True), spark.createDataFrame(items, "item_id long, text string"))
    assert got(df) == brute(docs, items)


@pytest.mark.parametrize("letters", [1, 7, 40])
def test_long_texts_in_pieces(spark, monkeypatch, letters):
    monkeypatch.setattr(winnow, "PIECE", letters)
    docs, items = passages(spark)
    a = prose(11, 40).split()
    docs = [*docs, (30, "  ".join(a).upper() + " " * 100), (31, "\n" * 90 + (" " * 60).join(a) + "."), (32, " " * 200), (33, "w" * 300),
            (34, f"{'🙂' * 50} {' '.join(a[:10])}{'É' * 60}"), (35, "only" + "-" * 80 + "three" + "-" * 80 + "words"), (36, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got_docs = winnow.decontaminate(docs_of(spark, docs, clash=True), bench)
    assert got(got_docs) == brute(docs, items)
    spans = winnow.decontaminate(docs_of(spark, docs[:1]), bench).first()["spans"]
    monkeypatch.setattr(winnow, "PIECE", 10_000)
    assert spans == winnow.decontaminate(docs_of(spark, docs[:1]), bench).first()["spans"]


def test_hits_do_not_carry_the_document(spark):
    docs, items = passages(spark)
    df = winnow.decontaminate(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), carry=True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "BroadcastHashJoin" in x)
    above, join = (re.search(r"\*\((\d+)\) (\w+)", x) for x in plan[at - 1:at + 1])
    assert above and above[2] == "Project" and above[1] == join[1]   # in the generated code that holds the hits of a row
    assert not re.search(r"(?<!AS )(?<!\()\b(ws|least|row)#\d+(?=[,\]])", plan[at - 1])


def test_aggregate_does_not_copy_the_row_for_each_hit(spark):
    docs, items = passages(spark)
    docs = docs_of(spark, [*docs, (40, f"{prose(11, 40)} " * 500)])
    df = winnow.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), carry=True)
    assert "first(row#" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r["row"]["doc_id"]), r["row"]["text"], r["contaminated"]) for r in df.collect()) == sorted(
        (str(r["doc_id"]), r["text"], brute([(r["doc_id"], r["text"])], items)[0][5]) for r in docs.collect())


def test_awkward_rows_and_empty_tables(spark, awkward, no_docs):
    items = spark.createDataFrame([(1, prose(1, 20)), (2, "a")], "item_id long, text string")
    assert got(winnow.decontaminate(awkward, items)) == brute([r[:2] for r in AWKWARD], [(1, prose(1, 20)), (2, "a")])
    assert got(winnow.decontaminate(awkward, items.limit(0))) == brute([r[:2] for r in AWKWARD], [])
    assert winnow.decontaminate(no_docs, items).count() == 0


def test_spans_and_carried_row(spark):
    a = prose(11, 14)
    docs = docs_of(spark, [(1, f"x y {a}")], clash=True)
    r = winnow.decontaminate(docs, spark.createDataFrame([(1, a)], "item_id long, text string"), carry=True).first()
    assert [(s["start"], s["len"]) for s in r["spans"]] == [(i, 10) for i in range(2, 7)]
    assert r["row"].asDict() == docs.first().asDict()


def test_shuffled_hashes_do_not_carry_the_document(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BROADCAST_BYTES", 0)
    docs, items = passages(spark)
    docs = [*docs, (20, f"{prose(5, 20_000, 5000)} {prose(11, 40)} {prose(6, 50)}")]
    df = winnow.decontaminate(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), carry=True)
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    steps = [x for x in plan if "Project" in x and re.search(r"\bk#", x)]
    assert steps and not any(re.search(r"\b(row|ws|least)#", x) for x in steps)
    assert sorted((str(r["row"]["doc_id"]), r["row"]["text"], r["n_hit"]) for r in df.collect()) == sorted(
        (str(d), t, n) for (d, t), n in [(x, brute([x], items)[0][2]) for x in docs])


def test_query_runs_without_python(spark):
    plan = queries.op3(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
