"""Per-turn bookkeeping as table jobs (A10, A11, W1, W2, T1 batch twin).

Inputs are a tool-call table (``call_id, conv_id, turn, round, ts, tool,
success, ...``), its artifacts (one row per artifact, ``pos`` inside the
call) and a message table.  Call order inside a turn is (round, ts,
call_id); "first seen" means the smallest (round, ts, call_id, pos).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.text import PUBMED_URL

DEFAULT_MAX_TOOL_CALLS = 7
DEFAULT_CONTEXT_TURNS = 5

_TURN = ["conv_id", "turn"]


def source_items(artifacts: DataFrame) -> DataFrame:
    """Artifacts of successful calls as (kind, item) rows: wiki URL, PubMed
    URL built from each PMID, NCBI URL."""
    pub = F.concat(F.lit(PUBMED_URL.split("{}")[0]), F.col("pmid").cast("string"), F.lit("/"))
    kind = (F.when(F.col("type") == "url", F.lit("wiki"))
            .when(F.col("type") == "pubmed", F.lit("pubmed"))
            .when(F.col("type") == "ncbi_taxonomy", F.lit("ncbi")))
    item = F.when(F.col("type") == "pubmed", pub).otherwise(F.col("url"))
    return (artifacts.filter(F.col("success"))
            .select(*_TURN, kind.alias("kind"), item.alias("item"),
                    F.struct("round", "ts", "call_id", "pos").alias("at"))
            .filter(F.col("kind").isNotNull()))


def turn_sources(artifacts: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """A10 in long form: each distinct source of a turn with its first-seen
    rank, and (given ``calls``) every executed code snippet in call order,
    not deduplicated (kind ``code``).  Dedup is an aggregate (map-side
    combined); a turn is bounded by the call budget, so its rank is a plain
    window over it."""
    first = (source_items(artifacts)
             .groupBy(*_TURN, "kind", "item").agg(F.min("at").alias("first_at")))
    if calls is not None:
        codes = executed_codes(calls).select(
            *_TURN, F.lit("code").alias("kind"), F.col("code").alias("item"),
            F.struct("round", "ts", "call_id", F.lit(0).alias("pos")).alias("first_at"))
        first = first.unionByName(codes)
    w = Window.partitionBy(*_TURN, "kind").orderBy("first_at")
    return first.withColumn("rank", F.row_number().over(w).cast("bigint")).drop("first_at")


def real_pmids(artifacts: DataFrame) -> DataFrame:
    """PMIDs returned by successful searches of each turn (distinct text)."""
    return (artifacts.filter(F.col("success") & (F.col("type") == "pubmed"))
            .select(*_TURN, F.col("pmid").cast("string").alias("pmid")).distinct())


def executed_codes(calls: DataFrame) -> DataFrame:
    """Code snippets of successful calls, not deduped: SQL ones prefixed
    ``-- SQL (tool)``."""
    code = F.when(F.col("sql").isNotNull(),
                  F.concat(F.lit("-- SQL ("), F.col("tool"), F.lit(")\n"), F.col("sql"))) \
        .otherwise(F.col("code"))
    return calls.filter(F.col("success") & code.isNotNull()) \
        .select(*_TURN, "round", "ts", "call_id", code.alias("code"))


def turn_summary(calls: DataFrame) -> DataFrame:
    """Calls used, ok/failed, figures and SQL snippets per turn."""
    ok = F.col("success")
    return calls.groupBy(*_TURN).agg(
        F.count(F.lit(1)).alias("calls_used"),
        F.count_if(ok).alias("ok_calls"),
        F.count_if(~ok).alias("failed_calls"),
        F.count_if(ok & (F.col("tool") == "create_map")).alias("figures"),
        F.count_if(ok & (F.col("tool") == "query_host_sql")).alias("snippets"))


def call_numbering(calls: DataFrame, max_calls: int = DEFAULT_MAX_TOOL_CALLS) -> DataFrame:
    """Calls numbered within a turn; the budget is tested once per round
    *before* the round runs, so a round may overshoot.  ``over_budget`` marks
    calls of rounds that start with ``>= max_calls`` calls already used.

    A turn is bounded by the call budget plus one round, so both numbers
    are windows over the turn and share one shuffle."""
    turn = Window.partitionBy(*_TURN)
    before = turn.orderBy("round").rangeBetween(Window.unboundedPreceding, -1)
    return (calls.withColumn("call_no", F.row_number().over(turn.orderBy("round", "ts", "call_id")).cast("bigint"))
            .withColumn("used_before", F.count(F.lit(1)).over(before))
            .withColumn("over_budget", F.col("used_before") >= max_calls))


def context_window(messages: DataFrame, max_turns: int = DEFAULT_CONTEXT_TURNS,
                   conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Keep user messages and assistant messages without tool calls,
    then the last ``2 * max_turns`` messages of each conversation (``<= 0``
    keeps all).  ``row_number() <= k`` is planned with a WindowGroupLimit,
    which keeps at most k rows per conversation in each map task before the
    shuffle, so a long conversation does not travel whole."""
    has_calls = F.col("tool_calls").isNotNull() if "tool_calls" in messages.columns else F.lit(False)
    kept = messages.filter((F.col("role") == "user") | ((F.col("role") == "assistant") & ~has_calls))
    if max_turns <= 0:
        return kept
    w = Window.partitionBy(conv).orderBy(F.col(order).desc())
    return (kept.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= 2 * max_turns).drop("_rn"))


def turn_rollup(events: DataFrame, window: str = "1 day") -> DataFrame:
    """T1 batch twin: per user and event-time window, calls and outcomes,
    duplicates (same event id) ignored."""
    dedup = events.dropDuplicates(["event_id"])
    ok = F.col("event_type") != "error"
    return (dedup.groupBy("user_id", F.window("ts", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_events"), F.count_if(ok).alias("n_ok"),
                 F.count_if(~ok).alias("n_failed"))
            .select("user_id", F.col("w.start").cast("string").alias("window_start"),
                    "n_events", "n_ok", "n_failed"))
