"""Row numbering without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row
into one task.  Here it is computed from a range-partitioned sort instead:

1. only the sort-key columns are range-partitioned (``repartitionByRange``:
   sampled boundaries; a hot group is split across ranges);
2. a local row number inside each range partition (local sort, then the
   row counter of ``monotonically_increasing_id``; no window, no shuffle);
3. per-partition row counts (one row per partition) prefix-summed and
   broadcast back — the broadcast side is bounded by the partition count;
4. the ranks are joined back to the full rows on the (unique) sort key.

Steps 2 and 3 must see the same ranges, and a second sampling could draw
other boundaries, so the sorted keys are checkpointed to the shared folder
and both steps read that copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens.operators.joins import lookup_join
from hostlens.session import cut_lineage

OrderSpec = str | tuple[str, bool]


def _specs(order: Sequence[OrderSpec]) -> list[tuple[str, bool]]:
    return [(o, True) if isinstance(o, str) else (o[0], bool(o[1])) for o in order]


def _sort_cols(specs: list[tuple[str, bool]], prefix: str = ""):
    return [F.col(prefix + c).asc_nulls_first() if asc else F.col(prefix + c).desc_nulls_last()
            for c, asc in specs]


def global_rank(df: DataFrame, order: Sequence[OrderSpec], name: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in the total order ``order``.

    ``order`` lists column names, or ``(name, ascending)`` pairs; it must be a
    total order (end it with a unique key)."""
    specs = _specs(order)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*[F.col(c).alias(f"_k{i}") for i, (c, _) in enumerate(specs)])
    kspecs = [(f"_k{i}", asc) for i, (_, asc) in enumerate(specs)]
    sort = _sort_cols(kspecs)
    # inside a range partition the position needs no window (and no second
    # shuffle): after a local sort, monotonically_increasing_id() counts rows
    # in iterator order on top of (partition id << 33)
    local = cut_lineage(
        keys.repartitionByRange(n, *sort).sortWithinPartitions(*sort)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id()
                    - F.shiftleft(F.col("_pid").cast("bigint"), 33) + F.lit(1)))
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
        .alias("_off"))
    ranks = (local.join(F.broadcast(offsets), "_pid")
             .select(*[c for c, _ in kspecs],
                     (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local")).alias(name)))
    cond = None
    for i, (c, _) in enumerate(specs):
        eq = df[c].eqNullSafe(ranks[f"_k{i}"])
        cond = eq if cond is None else cond & eq
    return df.join(ranks, cond).drop(*[c for c, _ in kspecs])


def group_rank(df: DataFrame, by: str, order: Sequence[OrderSpec], name: str = "rank") -> DataFrame:
    """1-based position of each row among the rows of equal ``by`` (null ones count
    as equal), in the total order ``order``.

    The position over all rows by (``by``, ``order``) less that of the group's first
    row, so no window holds a group, however large one is."""
    ranked = cut_lineage(global_rank(df, [by, *order], name="_at"))
    first = ranked.groupBy(by).agg(F.min("_at").alias("_first"))
    known = first.where(F.col(by).isNotNull())
    none = first.where(F.col(by).isNull()).select("_first").first()         # one row
    start = F.coalesce("_first", F.lit(none["_first"] if none else None).cast("bigint"))
    return lookup_join(ranked, known, by).withColumn(name, F.col("_at") - start + 1).drop("_at", "_first")
