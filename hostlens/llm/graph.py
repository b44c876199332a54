"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """Root (least node) of every node that is not a root itself, from ``edges``
    (u, v; any order, repeats and loops allowed).  Returns u, v with v the root.

    Large star: every node hands its larger neighbours to its least one; small
    star: every node hands its smaller neighbours to its least one.  The table
    never grows beyond one row per edge and the rounds go with the logarithm
    of the longest path.  Each round is written to the shared folder.
    """
    def key(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e, path = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    now = key(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, (e, path) = path, stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        drop_stored(edges.sparkSession, old)
        before, now = now, key(e)
        if now == before:
            break
    return e
