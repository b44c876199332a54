"""Observations by place.

Points are landed with their coordinates, decoded once, and a cell: the bits of
quantised longitude and latitude interleaved, so that places near each
other have near numbers.  The table is range-partitioned and sorted by cell.  A box
becomes a few ranges of cells, a bounded number whatever the box, which
reach the scan as filters: files and row groups outside them are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.wkb import with_point_coords
from hostlens.session import partitions_for

BITS = 16                 # of each coordinate
MOST_RANGES = 48
ROW_GROUP_BYTES = 8 << 20
ROWS_A_TASK = 500_000     # that a task sorts


def _spread(v: Column) -> Column:
    """The lower 16 bits of a number, a zero after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def _step(value: Column, low: float, high: float) -> Column:
    """Number of the strip that a coordinate lies in; beyond the ends, the last one."""
    top = (1 << BITS) - 1
    return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((value - low) / ((high - low) / (1 << BITS))))).cast("bigint")


def cell(lon: Column, lat: Column) -> Column:
    """Cell number (32 bits) of a place; null if a coordinate is."""
    return _spread(_step(lon, -180.0, 180.0)).bitwiseOR(F.shiftleft(_spread(_step(lat, -90.0, 90.0)), 1))


def land_points(host: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write the observations that have a point, with lon, lat and cell, in order of cell."""
    points = with_point_coords(host, "geometry").where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("cell", cell(F.col("lon"), F.col("lat")))
    n = partitions_for(host.sparkSession, host.count(), ROWS_A_TASK)
    # more places than one cell holds are split by their coordinates
    points.repartitionByRange(n, "cell", "lon", "lat").sortWithinPartitions("cell").write.option("parquet.block.size", row_group_bytes).parquet(path)


def _strip(value: float, low: float, high: float) -> int:
    return max(0, min((1 << BITS) - 1, int((value - low) // ((high - low) / (1 << BITS)))))


def box_ranges(west: float, south: float, east: float, north: float, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of cells that cover a box: squares are split, the largest first, while
    they lie partly outside and there is room; neighbours are joined."""
    x0, x1 = _strip(west, -180.0, 180.0), _strip(east, -180.0, 180.0)
    y0, y1 = _strip(south, -90.0, 90.0), _strip(north, -90.0, 90.0)
    done, level = [], [(0, 0, BITS)]                   # corner and size (as a power of two) of a square

    def number(x: int, y: int) -> int:
        return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(BITS))

    def outside(x, y, k):
        return x > x1 or y > y1 or x + (1 << k) <= x0 or y + (1 << k) <= y0

    def inside(x, y, k):
        return x0 <= x and y0 <= y and x + (1 << k) - 1 <= x1 and y + (1 << k) - 1 <= y1

    while level:
        split = [(x + dx, y + dy, k - 1) for x, y, k in level if k and not inside(x, y, k)
                 for dx in (0, 1 << k - 1) for dy in (0, 1 << k - 1) if not outside(x + dx, y + dy, k - 1)]
        whole = [(x, y, k) for x, y, k in level if not k or inside(x, y, k)]
        if len(done) + len(whole) + len(split) > most:
            done += level
            break
        done, level = done + whole, split
    out: list[tuple[int, int]] = []
    for low, high in sorted((number(x, y), number(x, y) + (1 << 2 * k) - 1) for x, y, k in done):
        if out and out[-1][1] + 1 == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def in_box(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows of landed points inside a box, its edges included; a box whose west lies
    east of its east crosses the date line."""
    if south > north:
        raise ValueError("south of the box lies north of its north")
    spans = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    keep = F.lit(False)
    for w, e in spans:
        cells = F.lit(False)
        for low, high in box_ranges(w, south, e, north):
            cells = cells | F.col("cell").between(low, high)
        keep = keep | (cells & F.col("lon").between(w, e) & F.col("lat").between(south, north))
    return points.where(keep)
