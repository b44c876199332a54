"""Dimension enrichment (J1) and the as-of join Spark has no operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens.session import cut_lineage


def enrich(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Observations joined to a dimension (e.g. taxonomy).  The side to
    broadcast is the planner's choice: by ``spark.sql.autoBroadcastJoinThreshold``
    (bytes), or by AQE from the measured size; beyond it the join shuffles."""
    return big.join(small, list(on), how)


def lookup_join(left: DataFrame, right: DataFrame, key: str, parts: int = 10_000) -> DataFrame:
    """Left join with a table that has each key once, which no hot key brings into one task.

    Keys that more than one in ``parts`` rows of ``left`` hold, ``parts`` keys at
    most, are joined by broadcast; only the rest shuffles."""
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot = cut_lineage(counts.where(F.col("_n") > left.count() // parts).select(key))
    known = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    usual = left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    return left.join(F.broadcast(hot), key, "left_semi").join(known, key, "left").unionByName(usual)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str,
              right_cols: Sequence[str], left_key: Sequence[str],
              bucket_seconds: int = 3600) -> DataFrame:
    """For each left row, the latest right row with the same ``by`` keys and
    ``right.ts <= left.ts`` (left outer: NULLs when there is none).

    Skew-safe: rows are cut into (by, time bucket) groups.  Inside a bucket
    the last right row is carried forward over a sorted window; a left row
    with no right row before it in its bucket takes the last right row of
    the nearest earlier bucket, found on the per-bucket aggregate (one row
    per key and bucket), never on the raw rows.  ``right_cols`` are returned
    prefixed with ``r_``; ``left_key`` is a unique key of ``left``."""
    by = list(by)
    us = F.lit(bucket_seconds * 1_000_000)
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / us)
    payload = F.struct(F.col(ts).alias("_rts"), *[F.col(c).alias(f"r_{c}") for c in right_cols])
    lcols = left.columns
    L = left.select(*[F.col(c) for c in lcols], bucket.alias("_b"),
                    F.struct(*[F.col(c) for c in left_key]).alias("_lid"))
    R = right.select(*[F.col(c) for c in by], F.col(ts), bucket.alias("_b"), payload.alias("_p"))

    # 1. inside the bucket
    u = L.select(*by, F.col(ts).alias("_t"), "_b", "_lid", F.lit(0).alias("_side"),
                 F.lit(None).cast(R.schema["_p"].dataType).alias("_p")) \
        .unionByName(R.select(*by, F.col(ts).alias("_t"), "_b", F.lit(None).cast(L.schema["_lid"].dataType).alias("_lid"),
                              F.lit(1).alias("_side"), "_p"))
    # right rows before left rows at equal times; among right rows at one
    # time the largest payload wins (deterministic ties)
    w = (Window.partitionBy(*by, "_b").orderBy(F.col("_t"), F.col("_side").desc(), F.col("_p"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = (u.withColumn("_in", F.last("_p", ignorenulls=True).over(w))
              .filter(F.col("_side") == 0).select("_lid", "_in"))

    # 2. nearest earlier bucket, from one row per (by, bucket)
    # payload structs start with the time, so max() is the latest (ties as above)
    last_in_bucket = R.groupBy(*by, "_b").agg(F.max("_p").alias("_last"))
    left_buckets = L.select(*by, "_b").distinct()
    keys = left_buckets.select(*by, "_b", F.lit(None).cast(R.schema["_p"].dataType).alias("_last")) \
        .unionByName(last_in_bucket)
    # a left bucket sorts before the right rows of the same bucket, so the
    # frame ending one row earlier only sees strictly earlier buckets
    wb = (Window.partitionBy(*by).orderBy("_b", F.col("_last").isNotNull())
          .rowsBetween(Window.unboundedPreceding, -1))
    prev = (keys.withColumn("_prev", F.last("_last", ignorenulls=True).over(wb))
            .filter(F.col("_last").isNull()).select(*by, "_b", "_prev"))

    out = (L.join(inside, "_lid", "left").join(prev, [*by, "_b"], "left")
           .withColumn("_m", F.coalesce("_in", "_prev")))
    return out.select(*lcols, *[F.col(f"_m.r_{c}").alias(f"r_{c}") for c in right_cols],
                      F.col("_m._rts").alias(f"r_{ts}"))
