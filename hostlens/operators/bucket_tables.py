"""Batches of edits applied to a stored table, touched buckets only.

The table is Parquet, partitioned by a hash bucket of its key.  A batch of upserts
reads only the buckets its keys fall into and writes only these, by dynamic
partition overwrite; the files of all other buckets stay as they are.
The rows that go on unchanged are found by an anti-join with the batch's keys, so only
the batch is aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def create(df: DataFrame, key: Sequence[str], path: str, buckets: int) -> None:
    """Write ``df`` to a path that does not exist yet.  ``key`` is unique."""
    df.withColumn(BUCKET, _bucket(key, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table; ``schema`` is that of the rows it was made of."""
    return _stored(spark, path, schema).drop(BUCKET)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)


def apply_batch(spark: SparkSession, path: str, batch: DataFrame, key: Sequence[str], order: Sequence[str], buckets: int,
                insert: bool = True) -> list[int]:
    """Apply a batch of edits (whole rows of the table, ``order`` columns included) and
    return the buckets that were written.

    Per key the edit with the greatest ``order`` counts and replaces the stored row; a new
    key is added, or with ``insert`` false changes nothing.  Edits without a full key are
    left out.  A batch that is applied again changes nothing more.  ``buckets`` is the
    number the table was made with."""
    key = list(key)
    known = batch.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).withColumn(BUCKET, _bucket(key, buckets))
    touched = sorted(r[0] for r in known.select(BUCKET).distinct().collect())       # at most ``buckets`` numbers
    base = _stored(spark, path, batch.schema).where(F.col(BUCKET).isin(touched))
    if not insert:
        known = known.join(base.select(*key), key, "left_semi")
        touched = sorted(r[0] for r in known.select(BUCKET).distinct().collect())
        base = base.where(F.col(BUCKET).isin(touched))
    if not touched:
        return []
    values = [c for c in known.columns if c not in key]
    last = known.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row")).select(
        *key, *[F.col("_row")[c].alias(c) for c in values])
    out = base.join(last.select(*key), key, "left_anti").unionByName(last)
    out.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched
