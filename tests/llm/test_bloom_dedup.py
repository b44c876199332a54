import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from hostlens.llm import bloom_dedup, common

from .conftest import AWKWARD, docs_of, prose

LOWER = str.maketrans(common.UPPER, common.LOWER)


def brute(rows):
    """Sorted (id, keep, size, sha) of every row, and the number kept per group."""
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i))
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr), len(groups)


def check(df, rows):
    got = df.collect()
    want, n = brute(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == n == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def copies(seed=5):
    """A third of all rows are one text, some texts come twice in other letters, the rest once."""
    r = random.Random(seed)
    rows = [(i, "The SAME text " * 3) for i in range(0, 900, 3)]
    rows += [(i, prose(i, 12).upper() if i % 2 else prose(i - 1, 12)) for i in range(1001, 1201)]
    rows += [(i, prose(i, 12) + " É") for i in range(2001, 2301)] + [(5001, "ÉCOLE"), (5002, "école"), (5003, "ÉCole")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("case", [{}, {"MAX_SEGMENTS": 1, "BITS": 1}, {"_TOLD": 3}])
def test_against_brute_force(spark, monkeypatch, case):
    """Also with a filter that is far too small and with reports that are forgotten at once."""
    for k, v in case.items():
        monkeypatch.setattr(bloom_dedup, k, v)
    rows = copies()
    check(bloom_dedup.exact_dedup(docs_of(spark, rows).repartition(7)), rows)


def test_awkward(spark, awkward, no_docs):
    check(bloom_dedup.exact_dedup(awkward), AWKWARD)
    assert bloom_dedup.exact_dedup(no_docs).count() == 0 == bloom_dedup.deduplicated(no_docs).count()
    stay = bloom_dedup.deduplicated(awkward)
    assert stay.columns == awkward.columns and stay.count() == brute(AWKWARD)[1]
    check(bloom_dedup.exact_dedup(docs_of(spark, [(1, "a")] * 50)), [(1, "a")] * 50)
    check(bloom_dedup.exact_dedup(docs_of(spark, [(None, None)] * 3)), [(None, None)] * 3)
    wide = [(-2**63, "x"), (2**63 - 1, "X"), (0, "x")]
    check(bloom_dedup.exact_dedup(docs_of(spark, wide)), wide)
    named = spark.createDataFrame([("b", "x"), ("a", "X"), ("c", "y")], "doc_id string, text string")
    check(bloom_dedup.exact_dedup(named), [("b", "x"), ("a", "X"), ("c", "y")])


def test_only_possible_repeats_shuffle(spark):
    rows = copies()
    src = docs_of(spark, rows).selectExpr("xxhash64(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h")
    n = src.groupBy("h").count().where("count > 1").count()
    assert n <= bloom_dedup.repeated_hashes(src).distinct().count() <= n + 3
    one = src.where("h = xxhash64('the same text the same text the same text ')").repartition(4)
    assert one.mapInPandas(bloom_dedup._look(False), "h long, again boolean").count() <= 8      # two per task


def test_filter_grows_and_forgets_nothing():
    rng = np.random.default_rng(1)
    seen, all_of = bloom_dedup.Seen(bits=10), []
    for n in (10, 1000, 5000, 20_000, 1):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert seen.add(h).mean() < 0.05 or n == 1
        all_of.append(h)
    assert all(seen.add(h).all() for h in all_of)


def test_hot_keys_are_broadcast_the_rest_shuffles(spark, monkeypatch):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 999), ("lone", 1000)], "k string, i long")
    right = left.where("k is not null and k <> 'lone'").groupBy("k").count()
    for parts in (common.HOT_PARTS, 10, 1):
        monkeypatch.setattr(common, "HOT_PARTS", parts)
        got = {r["i"]: r["count"] for r in common.join_hot(left, right, "k", "count", 302).collect()}
        assert got == {**{i: 200 if i % 3 else 1 for i in range(300)}, 999: None, 1000: None}
