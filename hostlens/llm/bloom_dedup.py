"""Exact deduplication in two passes over Bloom filters.

Pass 1 looks for hashes that may occur more than once.  Each task streams the
hashes of its texts through a filter of its own and sends every hash on once,
and once more when it saw it again; dealt by hash, the same filter runs over
what all tasks sent.  What either filter has seen before is a possible
repeat, and these few hashes fill the filter that pass 2 asks.

Pass 2 reads the texts again and asks the filter inside the scan.  Rows that
it does not know are alone and pass straight through.  Only the others
shuffle: they are grouped by the SHA-256 of the normalised text, which decides.
A false alarm of a filter costs a shuffled row, never a wrong result.

The filter of pass 2 is cut into segments by the upper bits of the hash.  It
has ``BITS`` bits per repeated hash and ``MAX_SEGMENTS`` segments (64 MB) at
most; beyond that it lets more rows through to the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import checkpointed, drop_stored, join_hot, lowered, mix64, stored, width

BITS = 16                       # bits of filter per hash
PROBES = 4                      # bits that one hash sets
SEGMENT_WORDS = 1024            # 64-bit words of a segment: 2^16 bits, so 16 bits of a hash name one
MAX_SEGMENTS = 8192             # 64 MB
_TOLD = 100_000


class Seen:
    """Bloom filter that grows: a full layer is followed by one of twice its size."""

    def __init__(self, bits: int = 20):
        self.layers, self.free = [(bits, np.zeros(1 << bits - 3, dtype=np.uint8))], (1 << bits) // BITS

    @staticmethod
    def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
        return [mix64(h + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits) for j in range(1, PROBES + 1)]

    def add(self, h: np.ndarray) -> np.ndarray:
        """Take in distinct hashes; which of them may have been there before."""
        known = np.zeros(len(h), dtype=bool)
        for bits, layer in self.layers:
            here = np.ones(len(h), dtype=bool)
            for s in self._slots(h, bits):
                here &= (layer[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            known |= here
        new = h[~known]
        if len(new) > self.free:
            bits = self.layers[-1][0] + 1
            while (1 << bits) // BITS < len(new):
                bits += 1
            self.layers.append((bits, np.zeros(1 << bits - 3, dtype=np.uint8)))
            self.free = (1 << bits) // BITS
        self.free -= len(new)
        bits, layer = self.layers[-1]
        for s in self._slots(new, bits):
            np.bitwise_or.at(layer, s >> np.uint64(3), np.uint8(1) << (s & np.uint64(7)).astype(np.uint8))
        return known


def _look(only_again: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pass hashes on: each once, and once more as ``again`` when it may have come
    before.  A repeat already reported (``told``, exact) is left out, so a hash
    that a third of the rows share leaves a task twice."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, told = Seen(), np.empty(0, dtype=np.uint64)
        for b in batches:
            h, at, n = np.unique(b["h"].to_numpy().view(np.uint64), return_inverse=True, return_counts=True)
            again = seen.add(h) | (n > 1)
            if "again" in b:
                np.logical_or.at(again, at, b["again"].to_numpy(dtype=bool))
            out = again & ~np.isin(h, told) if only_again else ~again | ~np.isin(h, told)
            told = np.union1d(told, h[again])
            if len(told) > _TOLD:
                told = told[:0]
            yield pd.DataFrame({"h": h[out].view(np.int64), "again": again[out]})
    return run


def repeated_hashes(hashes: DataFrame) -> DataFrame:
    """h of ``hashes`` that may occur more than once (all that do, and a few others)."""
    once = hashes.mapInPandas(_look(False), "h long, again boolean")
    return once.repartition(width(hashes.sparkSession), "h").mapInPandas(_look(True), "h long, again boolean").select("h")


def _segment(h: str, segments: int) -> Column:
    return F.shiftrightunsigned(h, 64 - (segments.bit_length() - 1)) if segments > 1 else F.lit(0).cast("long")


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(SEGMENT_WORDS * 64, dtype=bool)
    g = group["g"].to_numpy().view(np.uint64)
    for j in range(PROBES):
        bits[(g >> np.uint64(16 * j)) & np.uint64(0xFFFF)] = True
    return pd.DataFrame({"seg": group["seg"].iloc[:1], "words": [np.packbits(bits, bitorder="little").view(np.int64)]})


def _holds(g: str) -> Column:
    """Whether all bits of a hash are set in the segment ``words``."""
    hit = F.lit(True)
    for j in range(PROBES):
        slot = F.shiftrightunsigned(g, 16 * j).bitwiseAND(F.lit(0xFFFF)).cast("int")
        hit &= F.getbit(F.get("words", F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))) == 1
    return F.coalesce(hit, F.lit(False))


def exact_dedup(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Groups of documents (doc_id, text) whose texts are equal after lower-casing A-Z.

    One row per input row: doc_id, keep_id (of the row that stays), group_size,
    kept, text_sha256 of the normalised text; with ``carry`` also ``row``, a
    struct of all input columns.

    Of equal texts the row with the largest doc_id stays; of rows that tie in
    that too, exactly one.  A null text is the empty text, a null doc_id is
    smaller than any other (keep_id is null in a group of such rows).  Repeated
    rows are rows of their own and all but one of them go.  doc_id may be of
    any type that has an order; texts of any length are hashed whole, inside
    the scan.  An empty table gives no rows; other columns are only carried.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").alias("id"), lowered("text").alias("norm"), *([F.struct("*").alias("row")] if carry else []))
    repeated, path = stored(repeated_hashes(src.select(F.xxhash64("norm").alias("h"))))
    segments = 1 << max(repeated.count() * BITS // (SEGMENT_WORDS * 64), 1).bit_length() - 1
    segments = min(segments, MAX_SEGMENTS)
    known = checkpointed(repeated.select(_segment("h", segments).alias("seg"), F.xxhash64("h").alias("g"))
                         .groupBy("seg").applyInPandas(_fill, "seg long, words array<long>"))
    drop_stored(spark, path)
    # at most MAX_SEGMENTS rows of 8 KB
    asked = (src.withColumn("h", F.xxhash64("norm")).withColumn("g", F.xxhash64("h")).withColumn("seg", _segment("h", segments))
             .join(F.broadcast(known), "seg", "left").withColumn("hit", _holds("g")))
    own = [c for c in src.columns if c != "norm"]
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("sha")
    alone = asked.where("NOT hit").select(*own, sha).selectExpr(
        "*", "id AS keep_id", "1L AS group_size", "true AS kept")
    maybe = checkpointed(asked.where("hit").select(*own, sha, F.monotonically_increasing_id().alias("rid")))
    groups = checkpointed(maybe.groupBy("sha").agg(F.max(F.struct("id", "rid")).alias("top"), F.count("*").alias("size")))
    found = join_hot(maybe, groups, "sha", "size", maybe.count()).select(
        *own, "sha", F.col("top.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("rid") == F.col("top.rid")).alias("kept"))
    return alone.unionByName(found).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                                           F.col("sha").alias("text_sha256"), *(["row"] if carry else []))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole and with all their columns."""
    return exact_dedup(docs, carry=True).where("kept").select("row.*")
