"""Edits of a bucketed table against a plain dict; untouched buckets keep their files."""

import os
import random

import pytest

from hostlens.operators import bucket_tables as BT

SCHEMA = "k1 string, k2 long, v string, seq long"


def files(path):
    return {(d[len(path):], f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(spark, path, schema):
    return sorted(map(tuple, BT.read(spark, path, schema).collect()))


@pytest.mark.parametrize("buckets", [1, 8])
def test_batches_against_a_dict(spark, scratch_dir, buckets):
    r, path = random.Random(buckets), scratch_dir + "/t"
    state = {(f"a{i % 7}", i): ("old", 0) for i in range(200)}
    base = spark.createDataFrame([(*k, *v) for k, v in state.items()], SCHEMA)
    BT.create(base, ["k1", "k2"], path, buckets)
    for n in range(1, 4):
        batch = [(f"a{i % 7}", i, f"new{r.randrange(100)}", n * 100 + j) for j, i in enumerate(r.choices(range(260), k=40))] + [(None, 5, "x", 1), ("a1", None, "x", 1)]
        insert = n != 2
        for a, b, v, seq in sorted((x for x in batch if None not in x[:2]), key=lambda x: x[3]):
            if insert or (a, b) in state:
                state[a, b] = (v, seq)
        for _ in range(2):                                   # the second time changes nothing more
            BT.apply_batch(spark, path, spark.createDataFrame(batch, SCHEMA), ["k1", "k2"], ["seq"], buckets, insert)
            assert rows_of(spark, path, base.schema) == sorted((*k, *v) for k, v in state.items())


def test_one_bucket_is_written(spark, scratch_dir):
    path = scratch_dir + "/t"
    base = spark.range(500).selectExpr("concat('u', id % 9) AS k1", "id AS k2", "'old' AS v", "0L AS seq")
    BT.create(base, ["k1", "k2"], path, 16)
    before = files(path)
    edit = spark.createDataFrame([("u3", 3, "new", 7), ("u3", 3, "newer", 8)], SCHEMA)
    touched = BT.apply_batch(spark, path, edit, ["k1", "k2"], ["seq"], 16)
    after = files(path)
    changed = {d for d, f in before.keys() ^ after.keys()}
    assert len(touched) == 1 and changed == {f"/_bucket={touched[0]}"}
    assert all(before[x] == after[x] for x in before.keys() & after.keys()) and len(before.keys() & after.keys()) >= 15
    assert ("u3", 3, "newer", 8) in rows_of(spark, path, edit.schema) and BT.read(spark, path, edit.schema).count() == 500
    assert BT.apply_batch(spark, path, spark.createDataFrame([], SCHEMA), ["k1", "k2"], ["seq"], 16) == []
    assert BT.apply_batch(spark, path, spark.createDataFrame([("none", 1, "x", 1)], SCHEMA), ["k1", "k2"], ["seq"], 16, insert=False) == []
    assert files(path) == after
