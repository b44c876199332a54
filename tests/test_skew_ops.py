"""Skew-safe operators against brute force on small fixtures, with one key
holding a third of all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostlens.operators import search as S
from hostlens.operators.joins import asof_join
from hostlens.operators.ordering import global_rank


def skewed_rows(n=600, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = 0 if i % 3 == 0 else rnd.randint(1, 40)      # key 0 holds a third
        rows.append((i, g, rnd.randint(0, 50)))
    return rows


def test_global_rank_matches_sort(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id BIGINT, g BIGINT, v BIGINT")
    got = {r.id: r.rank for r in global_rank(df, [("v", False), "id"], num_partitions=5).collect()}
    expect = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(expect)}


def test_asof_join_matches_brute_force(spark):
    rnd = random.Random(3)
    t0 = datetime(2024, 1, 1)
    left, right = [], []
    for i in range(300):
        u = 0 if i % 3 == 0 else rnd.randint(1, 10)
        left.append((i, u, t0 + timedelta(minutes=rnd.randint(0, 5000))))
    for j in range(200):
        u = 0 if j % 3 == 0 else rnd.randint(1, 10)
        right.append((1000 + j, u, t0 + timedelta(minutes=rnd.randint(0, 5000), seconds=30)))
    L = spark.createDataFrame(left, "event_id BIGINT, user_id BIGINT, ts TIMESTAMP")
    R = spark.createDataFrame(right, "event_id BIGINT, user_id BIGINT, ts TIMESTAMP")
    got = {r.event_id: r.r_event_id for r in
           asof_join(L, R, ["user_id"], "ts", ["event_id"], ["event_id"], bucket_seconds=3600).collect()}
    expect = {}
    for i, u, ts in left:
        cands = [(t, e) for e, uu, t in right if uu == u and t <= ts]
        expect[i] = max(cands)[1] if cands else None
    assert got == expect


def test_contains_join_matches_brute_force(spark):
    names = ["small ring", "red widget", "big red ring", "ring", "Ringo star", "ab", "abc", "xyz"]
    terms = ["ring", "RED", "ab", "r", "widget x", "ng", "zzz", "big red", "o s"]
    got = {(r.term, r.name) for r in S.contains_join(
        spark.createDataFrame([(t,) for t in terms], "term STRING"),
        spark.createDataFrame([(n,) for n in names], "name STRING")).collect()}
    expect = {(t, n) for t in terms for n in names if t.lower() in n.lower()}
    assert got == expect


@pytest.mark.parametrize("block_bytes", [S.QUERY_BLOCK_BYTES, 8])
def test_search_topk_matches_brute_force(spark, block_bytes):
    rnd = random.Random(11)
    words = [f"v{i}" for i in range(12)]
    docs = [(i, " ".join(["common", *rnd.choices(words, k=rnd.randint(1, 6))])) for i in range(60)] + [(None, "common"), (99, None)]
    queries = [(10, "common v1 v2"), (11, "v3 V3 v4"), (12, "nothing here"), (13, "common"), (14, None)]
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3)
    q = spark.createDataFrame(queries, "qid BIGINT, text STRING")
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in
           S.search_topk(q, "qid", "text", d, "doc_id", "text", k=4, block_bytes=block_bytes).collect()}
    expect = {}
    for qid, qt in queries:
        sc = [(-n, did) for did, t in docs if did is not None and t and (n := len(set((qt or "").lower().split()) & set(t.split())))]
        expect.update({(qid, i): (did, -n) for i, (n, did) in enumerate(sorted(sc)[:4], 1)})
    assert got == expect
    assert {k: v for k, v in got.items() if k[0] == 13} == {(13, i + 1): (i, 1) for i in range(4)}   # a word in every document


def test_resolve_names_cuts_a_hot_key_before_the_join(spark):
    names = spark.range(3000).select(
        F.col("id").alias("tax_id"), F.when(F.col("id") % 3 == 0, "HIV").otherwise(F.concat(F.lit("n"), "id")).alias("name"),
        F.lit("acronym").alias("name_class"), F.lit(3).alias("priority")).withColumn("key", S.norm_name(F.col("name")))
    out = S.resolve_names(spark.createDataFrame([("hiv",), ("n7",), ("?",)], "term STRING"), names, k=5)
    assert sorted((r.term, r.rank, r.tax_id) for r in out.collect() if r.found) == [
        *(("hiv", i + 1, 3 * i) for i in range(5)), ("n7", 1, 7)]


def test_resolve_names_ranking(spark):
    names = spark.createDataFrame([
        (5, "Human immunodeficiency virus 1", "scientific name", 1),
        (5, "HIV", "acronym", 3), (3, "HIV", "synonym", 2), (9, "HIV", "common name", 4)],
        "tax_id BIGINT, name STRING, name_class STRING, priority INT") \
        .withColumn("key", S.norm_name(F.col("name")))
    terms = spark.createDataFrame([(" hiv ",), ("unknown",)], "term STRING")
    got = [(r.term, r.rank, r.tax_id, r.name_class, r.found)
           for r in S.resolve_names(terms, names).orderBy("term", "rank").collect()]
    assert got == [(" hiv ", 1, 3, "synonym", True), (" hiv ", 2, 5, "acronym", True),
                   (" hiv ", 3, 9, "common name", True), ("unknown", 1, None, None, False)]


def test_asof_ties_are_deterministic(spark):
    t0 = datetime(2024, 1, 1)
    L = spark.createDataFrame([(1, 7, t0 + timedelta(hours=5)), (2, 7, t0 + timedelta(minutes=1))],
                              "event_id BIGINT, user_id BIGINT, ts TIMESTAMP")
    R = spark.createDataFrame([(10, 7, t0), (11, 7, t0), (12, 7, t0 + timedelta(minutes=1))],
                              "event_id BIGINT, user_id BIGINT, ts TIMESTAMP")
    got = {r.event_id: r.r_event_id for r in
           asof_join(L, R, ["user_id"], "ts", ["event_id"], ["event_id"], bucket_seconds=3600).collect()}
    assert got == {1: 12, 2: 12}
    same = spark.createDataFrame([(20, 7, t0), (21, 7, t0)], "event_id BIGINT, user_id BIGINT, ts TIMESTAMP")
    got = {r.event_id: r.r_event_id for r in
           asof_join(L, same, ["user_id"], "ts", ["event_id"], ["event_id"], bucket_seconds=3600).collect()}
    assert got == {1: 21, 2: 21}


def test_group_rank_with_a_hot_and_a_null_group(spark):
    from hostlens.operators.ordering import group_rank

    rows = [((7, None, i % 50)[i % 3], (i * 37) % 300) for i in range(300)]
    got = {(r.g, r.i): r["rank"] for r in group_rank(spark.createDataFrame(rows, "g BIGINT, i BIGINT").repartition(5), "g", [("i", False)]).collect()}
    assert got == {(g, i): 1 + sum(h == g and j > i for h, j in rows) for g, i in rows}
    assert group_rank(spark.createDataFrame([], "g BIGINT, i BIGINT"), "g", ["i"]).count() == 0
