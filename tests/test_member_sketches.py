"""Stored sketches against exact distinct counts."""

import random

import pytest

from hostlens.operators import member_sketches as MS

SCHEMA = "family string, genus string, month string, species string"


def rows(seed, n):
    """A third of all rows lie in one genus; members recur across genera and months."""
    r = random.Random(seed)
    return [("F1" if i % 3 == 0 else r.choice(["F1", "F2", None]), "hot" if i % 3 == 0 else r.choice("abc"), f"2026-0{r.randrange(1, 5)}",
             f"s{int(r.random() ** 2 * 9000)}" if i % 50 else None) for i in range(n)]


def exact(data, level):
    at, out = {"family": 0, "genus": 1, "month": 2}, {}
    for row in data:
        n = out.setdefault(tuple(row[at[c]] for c in level), [0, set()])
        n[0] += 1
        n[1] |= {row[3]} - {None}
    return out


LEVELS = [["family", "genus"], ["family"], ["month"], []]


def check(df, data):
    got = {}
    for r in df.collect():
        level = [c for c in r["level"].split(",") if c]
        got.setdefault(tuple(level), {})[tuple(r[c] for c in level)] = (r["n_rows"], r["n_members"])
    for level in LEVELS:
        want = exact(data, level)
        have = got.pop(tuple(level))
        assert have.keys() == want.keys()
        for k, (n, members) in want.items():
            assert have[k][0] == n and have[k][1] == pytest.approx(len(members), rel=0.02)
    assert not got


def test_batches_merge_to_every_level(spark, scratch_dir):
    path, first, second = scratch_dir + "/s", rows(1, 30_000), rows(2, 8000)
    MS.add_batch(spark.createDataFrame(first, SCHEMA), ["family", "genus", "month"], "species", path, "1")
    check(MS.members(spark, path, LEVELS), first)
    for _ in range(2):                                  # the same batch twice replaces itself
        MS.add_batch(spark.createDataFrame(second, SCHEMA), ["family", "genus", "month"], "species", path, "2")
    check(MS.members(spark, path, LEVELS), first + second)
    some = MS.members(spark, path, LEVELS, "month >= '2026-03'")
    check(some, [r for r in first + second if r[2] >= "2026-03"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "species" not in plan and "PushedFilters" in plan


def test_few_members_are_exact(spark, scratch_dir):
    data = [("F", "g", "2026-01", f"s{i % 300}") for i in range(2000)] + [("F", "none", "2026-01", None)]
    MS.add_batch(spark.createDataFrame(data, SCHEMA), ["family", "genus", "month"], "species", scratch_dir + "/s", "1")
    got = {r["genus"]: r["n_members"] for r in MS.members(spark, scratch_dir + "/s", [["genus"]]).collect()}
    assert got == {"g": 300, "none": 0}
