"""Structured Streaming twins of the turn rollup (T1) and the log feed.

The reference streams one turn's events to a browser; a Spark user builds
the same folds over an append-only feed: event-time windows that drop repeats
and close by timer once the watermark has passed them (the last open windows of
a finite replay are not emitted), turns that close on their last event, and
counts in ``update`` mode.  Rows and checkpoints live under ``spark.checkpoint.dir`` by
name, so a stream that is started again resumes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hostlens.session import ensure_checkpoint_dir
from hostlens.sources.files import parse_log_lines, tool_events

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WindowRollup(StatefulProcessor):
    """One window of one user: drops repeats, counts, and closes by timer.

    State: the counts, and the event ids seen, packed into buckets so that a batch
    reads and writes only the buckets of its own ids.  The timer at the window's
    end emits the one row of the window and clears all of it.  What arrives for a
    window whose end the watermark has passed finds it closed and is ignored, so an
    emitted window never changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._counts = handle.getValueState("counts", "n LONG, ok LONG")
        self._seen = handle.getMapState("seen", "bucket INT", "ids BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, end = key
        if int(end.timestamp() * 1000) <= timerValues.getCurrentWatermarkInMs():
            return iter(())
        old = self._counts.get()
        n, ok = old if old is not None else (0, 0)
        if old is None:
            self._handle.registerTimer(int(end.timestamp() * 1000))
        for batch in rows:
            batch = batch.drop_duplicates("event_id")
            ids, good = batch["event_id"].to_numpy(dtype=np.int64), batch["ok"].to_numpy(dtype=bool)
            bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(int)        # 64 buckets
            for j in np.unique(bucket):
                mine = bucket == j
                held = self._seen.getValue((int(j),)) if self._seen.containsKey((int(j),)) else None
                known = np.frombuffer(held[0], dtype=np.int64) if held is not None else np.empty(0, dtype=np.int64)
                new = ~np.isin(ids[mine], known)
                if new.any():
                    self._seen.updateValue((int(j),), (np.concatenate([known, ids[mine][new]]).tobytes(),))
                    n, ok = n + int(new.sum()), ok + int(good[mine][new].sum())
        self._counts.update((n, ok))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, ok = self._counts.get()
        self._counts.clear()
        self._seen.clear()
        user, end = key
        yield pd.DataFrame({"user_id": [user], "end": [end], "n_events": [n], "n_ok": [ok], "n_failed": [n - ok]})

    def close(self) -> None:
        pass


def turn_rollup_stream(spark: SparkSession, events_dir: str, window: str = "1 day",
                       watermark: str = "1 day", max_files: int | None = None) -> DataFrame:
    """Per user and event-time window, events and outcomes, one row per window,
    emitted when the watermark passes its end (append mode).  Repeated event
    ids count once; events older than that change nothing.  Rows without an
    event id, user or time are left out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    ev = reader.parquet(events_dir).where("event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL")
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need TIMESTAMP
    keyed = ev.withWatermark("ts", watermark).select(
        "user_id", "ts", "event_id", F.coalesce(F.col("event_type") != "error", F.lit(False)).alias("ok"), F.window("ts", window).end.alias("end"))
    closed = keyed.groupBy("user_id", "end").transformWithStateInPandas(
        WindowRollup(), "user_id LONG, end TIMESTAMP, n_events LONG, n_ok LONG, n_failed LONG", "Append", "EventTime")
    return closed.select("user_id", (F.col("end") - F.expr(f"INTERVAL {window}")).alias("window_start"), "n_events", "n_ok", "n_failed")


def tool_log_stream(spark: SparkSession, logs_dir: str, window: str = "1 hour",
                    watermark: str = "1 hour") -> DataFrame:
    """Counts of TOOL_CALL / TOOL_OK / TOOL_FAIL per tool and hour from
    an append-only log folder."""
    lines = spark.readStream.text(logs_dir)
    ev = tool_events(parse_log_lines(lines)).filter(F.col("ts").isNotNull())
    return (ev.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "tool", "marker")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("hour"), "tool", "marker", "n"))


# Fixed values that must equal the reference's event types.
TURN_END = ("done", "saved")
TURN_EVENTS_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("ok", T.BooleanType()),
])
_TURN_OUT = "conv_id LONG, turn LONG, calls LONG, ok_calls LONG, failed_calls LONG, figures LONG, errors LONG, ended STRING"


def turn_close_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """T1 by turn: the events of a turn are folded until ``done`` or ``saved``
    closes it; one row per turn is emitted then (``ended`` names the event),
    or with ``ended = 'timeout'`` once the watermark has passed the turn's
    last event.  Repeated events (same seq) count once; events that come
    after the end are ignored, so a closed turn never changes.

    The state holds the seqs seen (bounded by the call budget) and counters;
    a closed turn keeps its mark until the watermark passes."""
    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, calls, ok, bad, figures, errors, ended, last = (
            state.get if state.exists else ("", 0, 0, 0, 0, 0, "", 0))
        known = set(seen.split(",")) if seen else set()

        def row(how: str) -> pd.DataFrame:
            return pd.DataFrame([(*key, calls, ok, bad, figures, errors, how)],
                                columns=["conv_id", "turn", "calls", "ok_calls", "failed_calls", "figures", "errors", "ended"])

        if state.hasTimedOut:
            state.remove()
            if not ended:
                yield row("timeout")
            return
        was_open = not ended
        for b in batches:
            for e in b.sort_values("seq").itertuples():
                last = max(last, int(e.ts.timestamp() * 1000))
                if ended or str(e.seq) in known:
                    continue
                known.add(str(e.seq))
                calls += e.type == "tool_call"
                ok += e.type == "tool_result" and bool(e.ok)
                bad += e.type == "tool_result" and not e.ok
                figures += e.type == "figure"
                errors += e.type == "error"
                if e.type in TURN_END:
                    ended = e.type
        state.update((",".join(sorted(known)), calls, ok, bad, figures, errors, ended, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        if ended and was_open:
            yield row(ended)

    return (events.withWatermark("ts", watermark).groupBy("conv_id", "turn").applyInPandasWithState(
        fold, _TURN_OUT, "seen STRING, calls LONG, ok LONG, bad LONG, figures LONG, errors LONG, ended STRING, last LONG",
        "append", GroupStateTimeout.EventTimeTimeout))


def run_to_table(df: DataFrame, table: str, output_mode: str = "update",
                 checkpoint: str | None = None) -> DataFrame:
    """Drain everything available (``availableNow``) into the folder of
    ``table`` below ``spark.checkpoint.dir`` and return all rows written so
    far, with their ``epoch``.

    The stream's checkpoint has the table's name: a later run goes on where
    the last one stopped.  A batch writes its own epoch's folder, whole, so
    one that is run again after a failure replaces its rows.  In ``update``
    mode the caller folds the rows with ``latest_rows``."""
    spark = df.sparkSession
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{table}"
    schema = T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/epoch={epoch}")

    q = (df.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint or f"{home}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{home}/rows")


def latest_rows(updates: DataFrame, key: list[str]) -> DataFrame:
    """Fold ``update``-mode output: the row of the latest epoch per key."""
    cols = [c for c in updates.columns if c not in key and c != "epoch"]
    return (updates.groupBy(*key)
            .agg(F.max_by(F.struct(*cols), F.col("epoch")).alias("_r"))
            .select(*key, *[F.col("_r")[c].alias(c) for c in cols]))
