"""BM25 over the stored index against a plain loop over every document."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hostlens.operators import article_index as IX


def plain(docs, queries, k):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs if i is not None}
    n, average = len(words), sum(map(len, words.values())) / max(len(words), 1)
    df = Counter(t for w in words.values() for t in set(w))
    out = {}
    for q, text in queries:
        scores = []
        for i, w in words.items():
            tf, s = Counter(w), 0.0
            for t in set(re.findall(r"[^\W_]+", text.lower())):
                if tf[t]:
                    s += math.log(1 + (n - df[t] + .5) / (df[t] + .5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (.25 + .75 * len(w) / average))
            if s:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def corpus(n, seed=1):
    """Words of very different frequency; every text holds 'the', a third are alike."""
    r = random.Random(seed)
    names = [f"w{int(1.5 ** (i / 6))}x{i}" for i in range(150)]
    docs = [(i * 7 - 50, " ".join(["the"] + r.choices(names, [1 / (j + 1) for j in range(150)], k=r.randrange(3, 60)))) for i in range(n)]
    return [(i, "The same ÉTÉ text, same words." if j % 3 == 0 else t) for j, (i, t) in enumerate(docs)]


@pytest.mark.parametrize("block,k", [(4, 3), (128, 5)])
def test_against_every_document(spark, scratch_dir, monkeypatch, block, k):
    monkeypatch.setattr(IX, "BLOCK", block)
    docs = [*corpus(400), (None, "the lost one"), (10**15, None), (10**15 + 1, "")]
    queries = [(1, "the"), (2, "w1x0 w1x3 the"), (3, "same été"), (4, "nowhere to be found"), (5, "w1x0 w1x1 w1x2 w1x5 w2x20 w17x80 the the"),
               (6, "w1x140"), (7, ""), (8, "w2x20 w3x25 w17x80 w22x90 w30x100")]
    IX.build_index(spark.createDataFrame(docs, "i long, t string").repartition(5), "i", "t", scratch_dir + "/ix", buckets=8)
    got = found(IX.search_index(spark.createDataFrame(queries, "q long, t string"), "q", "t", scratch_dir + "/ix", k=k))
    want = plain(docs, queries, k)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    assert all(abs(a - b) < 2e-6 for q in got for (_, a), (_, b) in zip(got[q], want[q]))


def test_only_the_buckets_of_the_words_are_opened(spark, scratch_dir):
    path = scratch_dir + "/ix"
    IX.build_index(spark.createDataFrame(corpus(200), "i long, t string"), "i", "t", path, buckets=16)
    bucket = spark.sql("SELECT pmod(xxhash64('same'), 16)").first()[0]
    files = IX.asked_blocks(spark, path, [bucket]).select("token", F.input_file_name().alias("f")).distinct().collect()
    assert files and all(f"bucket={bucket}/" in r["f"] for r in files) and "same" in {r["token"] for r in files}
    plan = IX.asked_blocks(spark, path, [bucket])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan or f"(bucket#" in plan.split("PartitionFilters")[1][:80]
    # a bucket that is not asked for may be missing altogether
    import shutil
    for other in range(16):
        if other != bucket:
            shutil.rmtree(f"{path}/postings/bucket={other}", ignore_errors=True)
    q = spark.createDataFrame([(1, "same")], "q long, t string")
    assert found(IX.search_index(q, "q", "t", path, k=2))[1][0][0] == -50


def test_blocks_of_common_words_are_pruned(spark, scratch_dir, monkeypatch):
    """A query with a rare word reads no block of the common one for candidates."""
    path = scratch_dir + "/ix"
    docs = [(i, "common " * (1 + i % 3) + ("rare" if i % 50 == 0 else f"u{i}")) for i in range(2000)]
    IX.build_index(spark.createDataFrame(docs, "i long, t string"), "i", "t", path, buckets=4)
    candidates, seen = IX._candidates, []
    monkeypatch.setattr(IX, "_candidates", lambda *a: seen.append(candidates(*a)) or seen[-1])
    got = found(IX.search_index(spark.createDataFrame([(1, "common rare")], "q long, t string"), "q", "t", path, k=5))
    assert got[1] == [(i, pytest.approx(s, abs=2e-6)) for i, s in plain(docs, [(1, "common rare")], 5)[1]]
    assert 5 <= seen[0].count() <= 40           # of 2,000 documents that hold the common word


def test_empty(spark, scratch_dir):
    for n, rows in enumerate(([], [(1, None), (2, "...")])):
        path = f"{scratch_dir}/{n}"
        IX.build_index(spark.createDataFrame(rows, "i long, t string"), "i", "t", path)
        assert IX.search_index(spark.createDataFrame([(1, "x y")], "q long, t string"), "q", "t", path).count() == 0


def test_words_are_counted_without_python(spark):
    """No batch of whole texts goes to Python; rows of one id count by themselves."""
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (1, ["a"]), (2, []), (3, ["é", "E", "é", "é"])], "id long, words array<string>")
    got = IX._counted(rows)
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("token", "id", "tf", "len").collect())) == [
        ("E", 3, 1, 4), ("a", 1, 1, 1), ("a", 1, 1, 3), ("b", 1, 2, 3), ("é", 3, 3, 4)]
