"""Well-known-binary points as Spark column expressions.

Spark 4.1 has no ``ST_X``/``ST_Y``.  A WKB point is

    byte 0      byte order (00 big endian, 01 little endian)
    bytes 1-4   geometry type (1 = point; EWKB sets 0x20000000 when a
                4-byte SRID follows the type word)
    then        x, y as IEEE-754 doubles in that byte order

Coordinates are decoded and encoded by vectorised functions over Arrow
batches (numpy reads and writes the bytes of a whole batch at once); whether a value
is a point with coordinates at all is a test of a few bytes and stays a
built-in expression.  NULL, non-point, short input and NaN coordinates
(``POINT EMPTY``) give NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EWKB_SRID_FLAG = 0x20000000


def _swap_bytes16(h: Column) -> Column:
    """Reverse the byte order of a 16-hex-digit string."""
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])


def _swap_bytes8(h: Column) -> Column:
    return F.concat(*[F.substring(h, 7 - 2 * i, 2) for i in range(4)])


def _layout(wkb: Column) -> tuple[Column, Column, Column, Column]:
    """(hex, little-endian flag, offset of x, is-point flag) of a WKB value."""
    h = F.hex(wkb)
    order = F.substring(h, 1, 2)
    little = order == "01"
    tw = F.conv(F.when(little, _swap_bytes8(F.substring(h, 3, 8)))
                .otherwise(F.substring(h, 3, 8)), 16, 10).cast("bigint")
    srid = tw.bitwiseAND(F.lit(_EWKB_SRID_FLAG)) != 0
    start = F.when(srid, F.lit(19)).otherwise(F.lit(11))
    ok = (order.isin("00", "01") & (tw.bitwiseAND(F.lit(0xFFFF)) == 1)
          & (F.length(h) >= start + F.lit(31)))
    return h, little, start, ok


def has_coordinates(wkb: Column) -> Column:
    """Whether a WKB/EWKB value is a point whose coordinates are numbers."""
    h, little, start, ok = _layout(wkb)

    def number(which: int) -> Column:
        raw = F.substr(h, start + F.lit(16 * which), F.lit(16))
        big = F.when(little, _swap_bytes16(raw)).otherwise(raw)
        # NaN: exponent bits all set and a mantissa that is not zero
        return ~(F.substring(big, 1, 3).isin("7FF", "FFF") & (F.substring(big, 4, 13) != "0" * 13))

    return F.coalesce(ok & number(0) & number(1), F.lit(False))


def _decode(wkb: pa.Array) -> np.ndarray:
    """x and y of a batch of WKB values, NaN where there is none."""
    wkb = wkb.cast(pa.large_binary())
    out = np.full((len(wkb), 2), np.nan)
    _, offsets, data = wkb.buffers()
    if not len(wkb) or data is None:
        return out
    ends = np.frombuffer(offsets, dtype=np.int64)[wkb.offset:wkb.offset + len(wkb) + 1]
    sizes = np.where(wkb.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    at = np.flatnonzero(sizes >= 21)
    if len(at):
        # a short last value is read on into zeros
        bytes_ = np.concatenate([np.frombuffer(data, dtype=np.uint8)[:ends[-1]], np.zeros(25, dtype=np.uint8)])
        head, size = bytes_[ends[at][:, None] + np.arange(25)], sizes[at]
        for order, end in ((0, ">"), (1, "<")):
            kind = np.ascontiguousarray(head[:, 1:5]).view(end + "u4").ravel()
            srid = (kind & _EWKB_SRID_FLAG) != 0
            for flag, start in ((False, 5), (True, 9)):
                use = (head[:, 0] == order) & ((kind & 0xFFFF) == 1) & (srid == flag) & (size >= start + 16)
                out[at[use]] = np.ascontiguousarray(head[use, start:start + 16]).view(end + "f8")
    return out


def _numbers(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))


@F.arrow_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def _point(wkb: pa.Array) -> pa.Array:
    xy = _decode(wkb)
    return pa.StructArray.from_arrays([_numbers(xy[:, 0]), _numbers(xy[:, 1])], names=["x", "y"])


@F.arrow_udf(T.DoubleType())
def _st_x(wkb: pa.Array) -> pa.Array:
    return _numbers(_decode(wkb)[:, 0])


@F.arrow_udf(T.DoubleType())
def _st_y(wkb: pa.Array) -> pa.Array:
    return _numbers(_decode(wkb)[:, 1])


def st_x(wkb: Column) -> Column:
    """Longitude (x) of a WKB/EWKB point; NULL when not a point."""
    return _st_x(wkb)


def st_y(wkb: Column) -> Column:
    """Latitude (y) of a WKB/EWKB point; NULL when not a point."""
    return _st_y(wkb)


def register_functions(spark: SparkSession) -> None:
    """``ST_X`` and ``ST_Y`` for SQL text."""
    spark.udf.register("ST_X", _st_x)
    spark.udf.register("ST_Y", _st_y)


@F.arrow_udf(T.BinaryType())
def _encode(x: pa.Array, y: pa.Array, little: pa.Array, srid: pa.Array) -> pa.Array:
    """WKB values of a batch, written side by side into one buffer."""
    xy = np.column_stack([v.cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (x, y)])
    known = ~np.isnan(xy).any(axis=1)
    le = little.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    coded, code = srid.is_valid().to_numpy(zero_copy_only=False), srid.fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.where(known, np.where(coded, 25, 21), 0))])
    data = np.zeros(ends[-1], dtype=np.uint8)
    for order, end in ((False, ">"), (True, "<")):
        for has_code in (False, True):
            at = np.flatnonzero(known & (le == order) & (coded == has_code))
            if len(at):
                words = [np.full(len(at), 1 | (_EWKB_SRID_FLAG if has_code else 0)), *([code[at]] if has_code else [])]
                parts = [np.full((len(at), 1), int(order), dtype=np.uint8),
                         *[w.astype(end + ("i4" if i else "u4")).reshape(-1, 1).view(np.uint8) for i, w in enumerate(words)],
                         np.ascontiguousarray(xy[at]).astype(end + "f8").view(np.uint8)]
                body = np.hstack(parts)
                data[ends[at][:, None] + np.arange(body.shape[1])] = body
    valid = pa.py_buffer(np.packbits(known, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(known), [valid, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def st_point(x: Column, y: Column, little_endian: Column | bool = True,
             srid: int | None = None) -> Column:
    """WKB point (EWKB when ``srid`` is given) from two doubles; NULL (or NaN)
    in → NULL.  Used to land geometry in tests and derived tables."""
    le = F.lit(little_endian) if isinstance(little_endian, bool) else little_endian
    return _encode(x.cast("double"), y.cast("double"), le, F.lit(srid).cast("int"))


def with_point_coords(df: DataFrame, geom: str, x_name: str = "lon",
                      y_name: str = "lat") -> DataFrame:
    """``df`` plus the x/y of its WKB column, both from one decoding.  It is
    marked nondeterministic so that a filter on the coordinates is not pushed
    below it, which would decode twice."""
    return (df.withColumn("_xy", _point.asNondeterministic()(F.col(geom)))
            .withColumn(x_name, F.col("_xy.x")).withColumn(y_name, F.col("_xy.y")).drop("_xy"))
