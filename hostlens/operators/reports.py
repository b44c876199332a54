"""Error reports with the log lines that led up to them.

An as-of top-n join: each report gets the last n lines of its month at or before
its time.  Lines are numbered over the whole log by a range sort, and every n
consecutive ones become one row with an array.  The as-of join finds the number of a
report's last line, so its n lines lie in at most two of these rows, whatever
the month holds: two lookups per report instead of n rows, and no window over a
month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.operators.joins import asof_join
from hostlens.operators.ordering import global_rank
from hostlens.session import cut_lineage

RECENT = 200


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def with_recent_logs(reports: DataFrame, lines: DataFrame, report_id: str = "id", at: str = "created_at", n: int = RECENT,
                     bucket_seconds: int = 3600) -> DataFrame:
    """``reports`` plus ``recent_logs``, the last ``n`` lines of their month up to
    their time, oldest first (an empty array if there is none).

    lines: month, ts, line_key (unique in a month) and line.  Lines of equal time
    go by line_key.  Lines without a time or month are left out, a report
    without a time gets no lines.  ``report_id`` is unique."""
    if n < 1:
        raise ValueError("n must be at least 1")
    timed = lines.where("ts IS NOT NULL AND month IS NOT NULL").select("month", "ts", "line_key", "line")
    ranked = cut_lineage(global_rank(timed, ["month", "ts", "line_key"], name="pos"))
    block = F.expr(f"(pos - 1) DIV {n}")
    # n lines in each array
    blocks = cut_lineage(ranked.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "month", "line"))).alias("lines")))
    asked = reports.select(F.col(report_id).alias("id"), F.col(at).alias("ts"), month_of(F.col(at)).alias("month"))
    last = asof_join(asked.where("ts IS NOT NULL"), ranked.select("month", "ts", "pos"), ["month"], "ts", ["pos"], ["id"], bucket_seconds) \
        .where("r_pos IS NOT NULL").select("id", "month", F.col("r_pos").alias("last"), F.expr(f"(r_pos - 1) DIV {n}").alias("block"))
    before = blocks.select((F.col("block") + 1).alias("block"), F.col("lines").alias("earlier"))
    found = last.join(blocks, "block").join(before, "block", "left")
    both = F.concat(F.coalesce("earlier", F.expr("array()").cast(blocks.schema["lines"].dataType)), "lines")
    recent = F.transform(F.filter(both, lambda x: (x.pos <= F.col("last")) & (x.pos > F.col("last") - n) & (x.month == F.col("month"))), lambda x: x.line)
    found = found.select(F.col("id").alias(report_id), recent.alias("recent_logs"))
    kept = [c for c in reports.columns if c != "recent_logs"]
    return reports.select(*kept).join(found, report_id, "left").withColumn(
        "recent_logs", F.coalesce("recent_logs", F.array().cast("array<string>")))
