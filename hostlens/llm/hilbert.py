"""Sharding by a Hilbert curve over document metadata (DataFrame functions only).

Four metadata dimensions (language, source, size, document id) are quantised
to a few bits each.  Documents are ordered by their cell's place on the
Hilbert curve and the order is cut into runs of equal row count, so each run
covers a compact block of every dimension and a reader can skip whole files
by any of them.

The global position of a row comes from counts, not from one global sort:
cells -> running total over blocks of cells -> running total inside a cell
over slices by hash of id and text -> row number inside a slice.  No window
ever holds more than one slice of one cell, however common a source is and
however the ids are spread.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 4


def _tables(n: int) -> tuple[list[int], list[int], list[int]]:
    """Per n-bit word w: inverse of the Gray code, entry point and direction
    of the w-th sub-cube of the curve."""
    size = 1 << n
    gray = [w ^ (w >> 1) for w in range(size)]
    inverse = [gray.index(g) for g in range(size)]
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(size)]

    def trailing_ones(w: int) -> int:
        return 0 if not w & 1 else 1 + trailing_ones(w >> 1)

    direction = [0 if w == 0 else trailing_ones(w if w & 1 else w - 1) % n for w in range(size)]
    return inverse, entry, direction


def hilbert_index(coords: list[str], bits: int) -> Column:
    """Place on the Hilbert curve of integer columns ``coords`` (each below
    ``2**bits``): one fold over the bit planes, highest first, that carries the
    entry corner and the direction of the current sub-cube."""
    n, mask = len(coords), (1 << len(coords)) - 1
    inverse, entry, direction = _tables(n)

    def pick(table: list[int], at: str) -> str:
        return f"element_at(array({','.join(map(str, table))}), int({at}) + 1)"

    plane = " | ".join(f"shiftleft(shiftright(`{c}`, i) & 1, {j})" for j, c in enumerate(coords))
    turned = f"(({plane}) ^ s.e)"
    right = f"((shiftright({turned}, s.d + 1) | shiftleft({turned}, {n} - s.d - 1)) & {mask})"
    w = pick(inverse, right)
    e = pick(entry, "t.w")
    left = f"((shiftleft({e}, t.d + 1) | shiftright({e}, {n} - t.d - 1)) & {mask})"
    # the inner transform names w once, so the next state can use it three times
    step = (f"element_at(transform(array(named_struct('e', s.e, 'd', s.d, 'h', s.h, 'w', {w})), "
            f"t -> named_struct('e', t.e ^ {left}, 'd', int((t.d + {pick(direction, 't.w')} + 1) % {n}), "
            f"'h', shiftleft(t.h, {n}) | t.w)), 1)")
    return F.expr(f"aggregate(sequence({bits - 1}, 0, -1), named_struct('e', 0, 'd', 0, 'h', bigint(0)), "
                  f"(s, i) -> {step}, s -> s.h)")


def hilbert_shards(docs: DataFrame, n_shards: int = 24, bits: int = 5, slice_bits: int = 10,
                   carry: bool = False) -> DataFrame:
    """Deal ``docs`` (doc_id, text, lang, source) into ``n_shards`` runs of the curve.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, curve
    (cell number on the curve), shard and slot (place in the shard, from 0).
    Shards differ by one row at most.  With ``carry`` the input's own columns
    come first instead of doc_id; columns of the same names as the added ones
    are replaced.

    Nulls: text counts as empty, lang and source as '', doc_id is below all
    others.  Repeated rows and equal ids each keep a slot of their own, ordered
    by checksum and size, then as they come (such rows are alike).  The id
    dimension is cut at quantiles, so ids may be any numbers; ids of other types
    are dealt over it by checksum.  An empty input gives no rows.  Extra columns
    never matter: the input travels in one struct.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    levels = 1 << bits

    def code(name: str) -> Column:
        return F.pmod(F.crc32(F.coalesce(F.col(name), F.lit("")).cast("binary")), F.lit(levels)).cast("int")

    if isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        # compared as doubles, which keeps the order; levels - 1 numbers come to the driver
        ids = docs.select(F.col("doc_id").cast("double").alias("k"))
        cuts = sorted(set(ids.approxQuantile("k", [i / levels for i in range(1, levels)], 0.25 / levels)))
        passed = [(F.col("doc_id").cast("double") >= F.lit(c)).cast("int") for c in cuts]
        at = F.coalesce(functools.reduce(Column.__add__, passed), F.lit(0)) if passed else F.lit(0)
    else:
        at = code("doc_id")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry else ["doc_id"])]).alias("r"),
        F.col("doc_id").alias("k"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        code("lang").alias("x0"), code("source").alias("x1"), at.alias("x3"),
    ).select(
        "r", "k", "size", "crc", "x0", "x1",
        F.least(F.lit(levels - 1), F.floor(F.log2("size") * 1.5)).cast("int").alias("x2"), "x3",
        F.pmod(F.xxhash64("k", "crc"), F.lit(1 << slice_bits)).cast("int").alias("part"),
    )
    cell = ["x0", "x1", "x2", "x3"]
    slices = rows.groupBy(*cell, "part").agg(F.count("*").alias("n"))
    # at most 2**(bits*DIMS) cells however many rows there are; the curve is computed once per cell
    cells = slices.groupBy(*cell).agg(F.sum("n").alias("n")).withColumn("curve", hilbert_index(cell, bits))
    block = F.shiftright("curve", bits * DIMS // 2)
    blocks = cells.groupBy(block.alias("block")).agg(F.sum("n").alias("n"))  # at most 2**(bits*DIMS/2) rows
    run = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"),
                           F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("block").orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("block", block).join(blocks, "block").select(
        *cell, "curve", "total", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"))
    within = Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(*cell, "part", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("skip")).join(
        starts, cell).select(*cell, "part", "curve", "total", (F.col("start") + F.col("skip")).alias("start"))
    each = Window.partitionBy(*cell, "part").orderBy("k", "crc", "size")
    ranked = rows.withColumn("i", F.row_number().over(each)).join(offsets, [*cell, "part"])
    rank = F.col("start") + F.col("i") - 1
    out = ranked.select("r", "size", "crc", "curve", rank.alias("rank"), "total",
                        F.expr(f"int((start + i - 1) * {n_shards} div total)").alias("shard"))
    slot = F.expr(f"rank - (shard * total + {n_shards - 1}) div {n_shards}")
    added = {"size": F.col("size"), "text_crc32": F.col("crc"), "curve": F.col("curve"),
             "shard": F.col("shard"), "slot": slot}
    kept = [c for c in (docs.columns if carry else ["doc_id"]) if c not in added]
    return out.select(*[F.col("r").getField(c).alias(c) for c in kept], *[v.alias(c) for c, v in added.items()])
