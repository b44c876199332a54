"""WKB points and the map gates."""

import math
import struct

from pyspark.sql import functions as F

from hostlens.functions.wkb import st_point, st_x, st_y
from hostlens.operators import geo


def wkb(x, y, little=True, srid=None):
    o = "<" if little else ">"
    t = 1 | (0x20000000 if srid is not None else 0)
    body = struct.pack(o + "I", t) + (struct.pack(o + "I", srid) if srid is not None else b"")
    return bytes([1 if little else 0]) + body + struct.pack(o + "dd", x, y)


def test_decode_both_orders_srid_and_edge_cases(spark):
    pts = [(1.5, -2.25), (0.0, 0.0), (-180.0, 89.999999), (1e-300, -1e300), (5e-324, 3.0)]
    rows = []
    for i, (x, y) in enumerate(pts):
        rows.append((i, bytearray(wkb(x, y, True))))
        rows.append((i, bytearray(wkb(x, y, False))))
        rows.append((i, bytearray(wkb(x, y, True, 4326))))
        rows.append((i, bytearray(wkb(x, y, False, 4326))))
    df = spark.createDataFrame(rows, "i INT, g BINARY")
    for r in df.select("i", st_x(F.col("g")).alias("x"), st_y(F.col("g")).alias("y")).collect():
        assert (r.x, r.y) == pts[r.i]


def test_non_points_and_nan_are_null(spark):
    line = bytes([1]) + struct.pack("<I", 2) + struct.pack("<I", 0)
    empty = wkb(math.nan, math.nan)
    df = spark.createDataFrame([(bytearray(line),), (bytearray(empty),), (None,), (bytearray(b"\x01"),)],
                               "g BINARY")
    got = df.select(st_x(F.col("g")), st_y(F.col("g"))).collect()
    assert all(r[0] is None and r[1] is None for r in got)


def test_encode_round_trip(spark):
    df = spark.createDataFrame([(12.345, -67.89), (-0.5, 1e-10)], "x DOUBLE, y DOUBLE")
    for le in (True, False):
        out = df.select("x", "y", st_point(F.col("x"), F.col("y"), le).alias("g"))
        for r in out.select("x", "y", st_x(F.col("g")).alias("dx"), st_y(F.col("g")).alias("dy"),
                            "g").collect():
            assert (r.dx, r.dy) == (r.x, r.y)
            assert bytes(r.g) == wkb(r.x, r.y, le)
    srid = df.select(st_point(F.col("x"), F.col("y"), True, srid=4326).alias("g")).first().g
    assert bytes(srid) == wkb(12.345, -67.89, True, 4326)


def test_traceability_gate(spark):
    ok = spark.createDataFrame([(1.0, 2.0, "SAMN1"), (3.0, 4.0, "GB2.1")], "lon DOUBLE, lat DOUBLE, sample_id STRING")
    assert geo.check_traceability(ok) is None
    bad = spark.createDataFrame([(1.0, 2.0, "SAMN1"), (3.0, 4.0, None)], "lon DOUBLE, lat DOUBLE, sample_id STRING")
    assert geo.check_traceability(bad) == geo.MISSING_VALUE_MSG
    assert geo.check_traceability(ok.drop("sample_id")) == geo.MISSING_COLUMN_MSG


def test_chart_gate_counts_points(spark):
    from hostlens.operators.frames import chart_has_points
    df = spark.createDataFrame([(None, 1.0), (None, None)], "x DOUBLE, y DOUBLE")
    r = chart_has_points(df, ["x", "y"]).first()
    assert (r.x, r.y) == (0, 1)


def test_every_kind_of_double_decodes_exactly(spark):
    import random

    r = random.Random(3)
    values = [struct.unpack(">d", r.randbytes(8))[0] for _ in range(3000)] + [r.uniform(-180, 180) for _ in range(3000)]
    values += [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan]
    rows = [(i, bytearray(wkb(v, -v, i % 2 == 0, 4326 if i % 3 == 0 else None))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i INT, g BINARY").select("i", st_x(F.col("g")).alias("x"), st_y(F.col("g")).alias("y"))
    for row in df.collect():
        for got, want in ((row.x, values[row.i]), (row.y, -values[row.i])):
            assert got is None if math.isnan(want) else struct.pack(">d", got) == struct.pack(">d", want)


def test_batches_of_every_kind(spark):
    """Nulls, NaN, short values, byte orders and codes side by side, as ``struct`` writes and reads them."""
    import random

    r = random.Random(5)
    rows = [(i, r.choice([None, math.nan, r.uniform(-180, 180)]), r.uniform(-90, 90) if i % 5 else None, r.choice([True, False, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "i INT, x DOUBLE, y DOUBLE, le BOOLEAN")
    for srid in (None, 4326):
        for row in df.select("*", st_point(F.col("x"), F.col("y"), F.col("le"), srid).alias("g")).collect():
            known = all(v is not None and not math.isnan(v) for v in (row.x, row.y))
            assert row.g == (wkb(row.x, row.y, bool(row.le), srid) if known else None)
    values = [None if i % 7 == 0 else bytearray(wkb(float(i), -float(i), i % 2 == 0, 4326 if i % 3 == 0 else None)[:r.choice([0, 3, 20, 21, 24, 25, 99])]) for i in range(500)]
    for row in spark.createDataFrame([*enumerate(values)], "i INT, g BINARY").repartition(3).select("i", st_x(F.col("g")).alias("x"), st_y(F.col("g")).alias("y")).collect():
        whole = values[row.i] is not None and len(values[row.i]) >= (25 if row.i % 3 == 0 else 21)
        assert (row.x, row.y) == ((float(row.i), -float(row.i)) if whole else (None, None))


def test_no_python_loop_over_points():
    """A batch's cost is that of numpy: hundreds of thousands of points take far less than a second each way."""
    import time

    import numpy as np
    import pyarrow as pa

    from hostlens.functions import wkb as W

    n = 400_000
    xy = pa.array(np.arange(n, dtype=float))
    t = time.perf_counter()
    g = W._encode.func(xy, xy, pa.array(np.arange(n) % 2 == 0), pa.nulls(n, pa.int32()))
    back = W._st_x.func(g)
    assert back.equals(xy) and time.perf_counter() - t < 1.5
