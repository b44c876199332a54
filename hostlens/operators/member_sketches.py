"""How many distinct members a taxon has, from stored sketches.

Distinct counts do not add up, sketches do: one HyperLogLog sketch of the members is
stored per finest group (family, genus, month), and any coarser question merges
sketches instead of reading observations again.  New observations are added as
further sketches of their own batch, the old ones stay as they are.

With ``LG_K`` = 14 a sketch takes 16 KB at most, errs by 0.8 % (one standard error) and
is exact for some hundred members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 14


def add_batch(observations: DataFrame, groups: list[str], member: str, path: str, batch: str) -> None:
    """Store the sketches of a batch of observations below ``path``.  A batch that is
    stored again replaces itself.  Null members do not count; null groups are groups."""
    (observations.groupBy(*groups).agg(F.count("*").alias("n_rows"), F.hll_sketch_agg(F.col(member), F.lit(LG_K)).alias("members"))
     .write.mode("overwrite").parquet(f"{path}/batch={batch}"))


def members(spark: SparkSession, path: str, levels: list[list[str]], where: str | None = None) -> DataFrame:
    """Distinct members and rows at several levels at once: for each list of group
    columns one row per group, the other columns null and not in ``level``.

    ``where`` selects groups first (a range of months, say).  Reads sketches only."""
    stored = spark.read.option("basePath", path).parquet(path)
    stored = stored.where(where) if where else stored
    columns = list(dict.fromkeys(c for level in levels for c in level))
    # the finest groups first, so that each batch's sketches are merged once for all levels
    finest = stored.groupBy(*columns).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("members", F.lit(True)).alias("members"))
    sets = [[F.col(c) for c in level] for level in levels]
    merged = finest.groupingSets(sets, *columns).agg(
        F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]).alias("level"),
        F.sum("n_rows").alias("n_rows"), F.hll_union_agg("members", F.lit(True)).alias("members"))
    return merged.select("level", *columns, "n_rows", F.hll_sketch_estimate("members").alias("n_members"))
