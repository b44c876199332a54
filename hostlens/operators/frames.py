"""Chart/table frames and frame verbs.

Each returns a small, aggregated DataFrame (or a row-preserving one for the
row verbs); drawing is left to the caller.  Totals needed for shares and
bin widths are scalar subqueries (``DataFrame.scalar()``): Spark computes
them as separate partial+final aggregates and inlines the value, so no
single-partition window or cross join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_size(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """A2/A5 ``groupby(k).size()``: NULL keys dropped, sorted by key."""
    return (df.filter(F.col(key).isNotNull())
            .groupBy(key).agg(F.count(F.lit(1)).alias(name))
            .orderBy(key))


def group_count(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """A1 ``GROUP BY k, COUNT(*)``: NULL keys form their own group."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def category_share(df: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """A4 pie frame: count and share of the total per category."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, digits))


def histogram(df: DataFrame, col: str, bins: int = 10, digits: int = 6) -> DataFrame:
    """Equal-width bins between min and max; the top edge falls in the
    last bin.  Empty bins are not emitted (as a bar of height 0 is not drawn)."""
    x = F.col(col).cast("double")
    # one pass for both bounds, one subquery; a row carries them to its bin
    bounds = df.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, width = F.col("b.lo"), (F.col("b.hi") - F.col("b.lo")) / F.lit(float(bins))
    place = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1))).cast("int")
    return (df.filter(F.col(col).isNotNull()).select(x.alias("x"), bounds.alias("b"))
            .groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("b").alias("b"))
            .select("bin", "n", F.round(lo + F.col("bin") * width, digits).alias("bin_lo"),
                    F.round(lo + (F.col("bin") + 1) * width, digits).alias("bin_hi")))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """pandas ``value_counts``: NULLs dropped, count per value."""
    return group_count(df.filter(F.col(col).isNotNull()), col, "count")


def nlargest(df: DataFrame, n: int, col: str, tiebreak: Sequence[str]) -> DataFrame:
    """Top-n by ``col``; ties broken by ``tiebreak`` (pandas keeps first).
    Planned as TakeOrderedAndProject: per-partition top-n, then a merge."""
    return df.orderBy(F.col(col).desc(), *[F.col(c).asc() for c in tiebreak]).limit(n)


def describe(df: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    """``describe()`` in long form: one row per column with count, mean, std,
    min, max, computed in a single aggregate pass."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"),
                     F.col(f"{c}__count").alias("count"),
                     F.round(F.col(f"{c}__mean"), digits).alias("mean"),
                     F.round(F.col(f"{c}__std"), digits).alias("std"),
                     F.col(f"{c}__min").alias("min"),
                     F.col(f"{c}__max").alias("max")) for c in cols]
    return wide.select(F.inline(F.array(*rows)))


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """``pivot_table(aggfunc='size', fill_value=0)`` with a fixed column list
    (listing the values avoids an extra distinct job)."""
    return (df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
            .fillna(0, subset=list(values)))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str],
         var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """``melt``: one row per (id, variable)."""
    return df.unpivot(list(ids), list(values), var_name, value_name)


def running_total(df: DataFrame, partition: Sequence[str], order: Sequence[str],
                  value: str, name: str) -> DataFrame:
    """``groupby(...).cumsum()`` within bounded partitions."""
    w = (Window.partitionBy(*partition).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.sum(value).over(w))


def distinct_count(df: DataFrame, key: str, col: str, name: str,
                   approx_rsd: float | None = None) -> DataFrame:
    """Distinct members per group.  Exact by default (Catalyst's two-level
    distinct aggregate); with ``approx_rsd`` a HyperLogLog++ sketch of that
    relative standard deviation, merged map-side, for very large groups."""
    if approx_rsd is not None:
        return df.groupBy(key).agg(F.approx_count_distinct(col, approx_rsd).alias(name))
    return df.groupBy(key).agg(F.countDistinct(col).alias(name))


def chart_has_points(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M3: per-column non-null counts; the chart gate passes when any > 0."""
    return df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
