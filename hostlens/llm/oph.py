"""Document fingerprints: one-permutation MinHash.

Every 5-word shingle of a text is hashed once; the upper bits of the hash name
a bin, and each bin keeps its least hash.  An empty bin takes the value of the
first full bin in its own fixed random order of bins (optimal densification:
the order does not depend on the text, so two texts borrow alike).  The lowest
``BITS`` bits of each bin are packed.  Two fingerprints agree in a bin by
chance with probability 2**-BITS, which the likeness corrects for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm.common import WordHashes, mix64, shingle_hashes, width, words_of

BINS = 256
BITS = 4
SHINGLE = 5
AREAS = 8        # ranges of doc_id for each task
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def _orders(bins: int) -> np.ndarray:
    """Rank of bin t in the order in which bin i looks for a full bin."""
    i = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins) + np.uint64(1)
    return mix64(mix64(i * np.uint64(0xD1342543DE82EF95))).argsort(axis=1).argsort(axis=1).astype(np.int16)


class Fingerprinter:
    """Makes and compares fingerprints (hex text; '' for a text without words)."""

    def __init__(self):
        self._hash, self._rank = WordHashes(), _orders(BINS)

    def codes(self, text: str | None) -> np.ndarray | None:
        """The BITS lowest bits of every bin, or None without words."""
        words = words_of(text)
        if not words:
            return None
        h = np.sort(shingle_hashes(self._hash.of(words), SHINGLE))
        at = (h >> _SHIFT).astype(np.intp)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        full = at[first]
        bins = np.empty(BINS, dtype=np.uint64)
        bins[full] = h[first]
        if len(full) < BINS:
            empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
            donor = self._rank[np.ix_(empty, full)].argmin(axis=1)
            bins[empty] = h[first][donor]
        return (bins & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def pack(codes: np.ndarray | None) -> str:
    if codes is None:
        return ""
    bits = np.unpackbits(codes[:, None], axis=1)[:, 8 - BITS:]
    return np.packbits(bits.ravel()).tobytes().hex()


def unpack(fingerprint: str) -> np.ndarray | None:
    if not fingerprint:
        return None
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)).reshape(BINS, BITS)
    return (bits << np.arange(BITS - 1, -1, -1, dtype=np.uint8)).sum(axis=1).astype(np.uint8)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity without the matches due to chance; texts
    without words are alike and unlike all others."""
    if a is None or b is None:
        return float(a is b)
    chance = 2.0 ** -BITS
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row (doc_id, text); null text is empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fp = Fingerprinter()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [pack(fp.codes(t)) for t in b["text"]]})

    schema = T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.StringType())])
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows (k, doc_id, text, area, guest) so dealt and sorted that each own row
    (guest false) of an area is followed by the next document in descending
    doc_id order; the last one of all by the first.

    Areas are ranges of doc_id between quantiles, a few for each task.  The head of
    each area is sent to the area before it as well, so no area needs to wait for
    another.
    """
    spark, least = docs.sparkSession, -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(least)).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = width(spark)
    m = n * AREAS
    cuts = rows.select("k").approxQuantile("k", [i / m for i in range(1, m)], 0.25 / m)  # m - 1 numbers
    # quantiles are doubles: one at 2^63 lies above all ids
    edges = np.array(sorted({int(c) for c in cuts if c < 2.0 ** 63}), dtype=np.int64)

    @F.pandas_udf("int")
    def area(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(), side="right").astype(np.int32))

    heads = sorted(((r["area"], r["k"]) for r in rows.select(area("k").alias("area"), "k").groupBy("area").agg(
        F.max("k").alias("k")).collect()), reverse=True)  # one row per area
    guest_of = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}  # the first head goes to the last area

    @F.pandas_udf("array<int>")
    def dealt(k: pd.Series) -> pd.Series:
        own = np.searchsorted(edges, k.to_numpy(), side="right")
        return pd.Series([[int(o)] if (g := guest_of.get(x)) is None else [int(o), g] for o, x in zip(own, k)])

    return (rows.select("k", "doc_id", "text", F.posexplode(dealt("k")).alias("copy", "area"))
            .withColumn("guest", F.col("copy") > 0).drop("copy")
            .repartitionByRange(n, "area").sortWithinPartitions("area", "guest", F.desc("k"), "text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document, by descending doc_id; after
    the last comes the first.  Reads doc_id and text.

    Null text counts as empty (fingerprint ''); a null doc_id comes last; rows
    of equal doc_id follow one another by text; a table of one row is its own
    next document; an empty table gives no rows.  Texts are read whole.
    """
    import hashlib

    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fp, before = Fingerprinter(), None
        for b in batches:
            out = []
            for area, guest, doc_id, text in zip(b["area"], b["guest"], b["doc_id"], b["text"]):
                codes = fp.codes(text)
                if before is not None and before[0] == area and not before[1]:
                    _, _, id0, text0, codes0 = before
                    cut = len(text0) // 3
                    edited = text0[:len(text0) - cut] + text[:cut]
                    other = fp.codes(edited)
                    out.append((id0, len(text0), hashlib.sha256(edited.encode("utf-8")).hexdigest(), pack(codes0),
                                pack(other), likeness(codes0, other), likeness(codes0, codes)))
                before = (area, guest, doc_id, text, codes)
            got = pd.DataFrame(out, columns=schema.names)
            got["doc_id"] = got["doc_id"].astype("Int64")
            yield got

    return _with_next(docs.select("doc_id", "text")).mapInPandas(run, schema)
