"""Places by box against plain comparison of coordinates."""

import random

import pytest
from pyspark.sql import functions as F

from hostlens.functions.wkb import st_point
from hostlens.operators import places as PL


def rows_read(df):
    """Rows that the scan handed on after skipping row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    r = random.Random(2)
    rows = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(4000)]
    rows += [(10_000 + i, 13.4, 52.5) for i in range(2000)]                          # one place holds a third
    rows += [(20_000, -180.0, -90.0), (20_001, 180.0, 90.0), (20_002, 0.0, 0.0), (20_003, 400.0, -95.0), (20_004, None, 1.0)]
    path = str(tmp_path_factory.mktemp("p") / "points")
    df = spark.createDataFrame(rows, "id long, x double, y double")
    PL.land_points(df.withColumn("geometry", st_point(F.col("x"), F.col("y"))), path, row_group_bytes=20_000)
    return rows, spark.read.parquet(path)


BOXES = [(-10, 35, 30, 60), (13.4, 52.5, 13.4, 52.5), (-180, -90, 180, 90), (170, -20, -170, 20), (0, 0, 0, 0), (100, 10, 100.001, 10.001), (-180, 89.9, 180, 90), (300, -95, 500, -91)]


@pytest.mark.parametrize("box", BOXES)
def test_box(points, box):
    rows, table = points
    w, s, e, n = box
    want = [i for i, x, y in rows if x is not None and s <= y <= n and (w <= x <= e if w <= e else x >= w or x <= e)]
    assert sorted(r["id"] for r in PL.in_box(table, *box).collect()) == sorted(want)


@pytest.mark.parametrize("box", BOXES[:7])
def test_ranges_are_few_and_cover(box):
    w, s, e, n = box
    spans = [(w, e)] if w <= e else [(w, 180.0), (-180.0, e)]
    r = random.Random(1)
    for a, b in spans:
        ranges = PL.box_ranges(a, s, b, n)
        assert len(ranges) <= PL.MOST_RANGES and all(x <= y for x, y in ranges) and all(p[1] + 1 < q[0] for p, q in zip(ranges, ranges[1:]))
        for _ in range(200):
            x, y = PL._strip(r.uniform(a, b), -180, 180), PL._strip(r.uniform(s, n), -90, 90)
            number = sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(PL.BITS))
            assert any(low <= number <= high for low, high in ranges)


def test_row_groups_outside_the_box_are_not_read(points):
    rows, table = points
    found = PL.in_box(table, 100, 10, 130, 40)
    inside = found.count()
    assert 0 < inside < 200 and rows_read(found) < 2000 < len(rows) - 4000 + 3000
    assert "PushedFilters" in found._jdf.queryExecution().executedPlan().toString()


def test_bad_box(points):
    with pytest.raises(ValueError):
        PL.in_box(points[1], 0, 10, 1, 5)


def test_partitions_go_by_the_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(PL, "ROWS_A_TASK", 100)
    df = spark.range(2000).select("id", st_point(F.col("id") / 100, F.col("id") / 200).alias("geometry"))
    PL.land_points(df, str(tmp_path / "points"))
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "points")).groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 15 and max(sizes) <= 300
