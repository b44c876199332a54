"""Streaming twins equal their batch jobs."""

import os

from pyspark.sql import functions as F

from hostlens.operators import turns as TU
from hostlens.sources.files import parse_log_lines, tool_events
from hostlens.streaming import jobs as ST

SF = "/root/testdata/sf0.001"


def test_turn_rollup_stream_equals_batch(spark, scratch_dir):
    src = os.path.join(scratch_dir, "events")
    os.makedirs(src)
    ev = spark.read.parquet(f"{SF}/events.parquet")
    # replay as several files, with every event of one file delivered twice
    ev.repartition(4).write.mode("overwrite").parquet(os.path.join(src, "part"))
    dup = ev.filter(F.col("event_type") == "click")
    dup.write.mode("overwrite").parquet(os.path.join(src, "dups"))
    # one event far ahead closes every other window
    last = ev.orderBy(F.desc("ts")).limit(1).withColumns({"event_id": F.lit(-1).cast("bigint"), "user_id": F.lit(-1).cast("bigint"), "ts": F.expr("ts + INTERVAL 90 DAYS")})
    stamp = 2_000_000_000
    last.coalesce(1).write.parquet(os.path.join(src, "ahead"))
    for f in os.listdir(os.path.join(src, "ahead")):
        os.utime(os.path.join(src, "ahead", f), (stamp, stamp))
    stream = ST.turn_rollup_stream(spark, os.path.join(src, "*"), window="1 day", watermark="30 days",
                                   max_files=2)
    got = ST.run_to_table(stream, f"t1_rollup-{os.path.basename(scratch_dir)}", "append") \
        .withColumn("window_start", F.col("window_start").cast("timestamp_ntz").cast("string"))
    batch = TU.turn_rollup(ev, "1 day")
    cols = ["user_id", "window_start", "n_events", "n_ok", "n_failed"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_tool_log_stream_counts(spark, scratch_dir):
    d = os.path.join(scratch_dir, "logs")
    os.makedirs(d)
    lines = []
    for i in range(40):
        tool = ["query_host_sql", "pubmed_search"][i % 2]
        lines.append(f"2026-01-02 0{i % 3}:10:{i % 60:02d} | INFO | TOOL_CALL #{i % 7 + 1}/7 | {tool} | call_id={i}")
        marker = "TOOL_OK" if i % 5 else "TOOL_FAIL"
        lines.append(f"2026-01-02 0{i % 3}:11:{i % 60:02d} | INFO | {marker} | {tool} | done")
    lines.append("not a log line")
    with open(os.path.join(d, "agent_2026-01.log"), "w") as f:
        f.write("\n".join(lines) + "\n")
    stream = ST.tool_log_stream(spark, d, window="1 hour", watermark="2 hours")
    got = ST.latest_rows(ST.run_to_table(stream, f"t2_tools-{os.path.basename(scratch_dir)}"), ["hour", "tool", "marker"])
    batch = (tool_events(parse_log_lines(spark.read.text(d))).filter(F.col("ts").isNotNull())
             .groupBy(F.window("ts", "1 hour").start.alias("hour"), "tool", "marker")
             .agg(F.count(F.lit(1)).alias("n")))
    key = ["hour", "tool", "marker", "n"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))
    assert got.agg(F.sum("n")).first()[0] == 80


def test_late_events_never_change_a_closed_window(spark, scratch_dir):
    """Arrivals: two events of a day; one three days on, which closes that day; then an
    event of the closed day, a repeat, and an event of a day still open with a repeat of
    its own; at last one far ahead.  The closed day is emitted once, as it was."""
    import datetime as dt

    from hostlens.streaming.jobs import EVENTS_SCHEMA

    src = os.path.join(scratch_dir, "feed")
    os.makedirs(src)
    t0 = dt.datetime(2024, 1, 10, 12, 0, 0)

    stamp = [1_700_000_000]

    def drop(name, rows):
        # the file source orders files by modification time; give each drop a
        # later time so arrival order does not depend on clock resolution
        out = os.path.join(src, name)
        spark.createDataFrame(rows, EVENTS_SCHEMA).coalesce(1).write.parquet(out)
        stamp[0] += 60
        for f in os.listdir(out):
            os.utime(os.path.join(out, f), (stamp[0], stamp[0]))

    drop("a", [(1, t0, 7, "click", 1.0, "{}"), (2, t0 + dt.timedelta(hours=1), 7, "error", 1.0, "{}")])
    drop("b", [(3, t0 + dt.timedelta(days=3), 7, "click", 1.0, "{}")])        # moves the watermark on
    drop("c", [(9, t0 + dt.timedelta(days=3, hours=1), 7, "click", 1.0, "{}")])
    drop("d", [(4, t0 - dt.timedelta(hours=1), 7, "click", 1.0, "{}"),      # late: its day is closed
               (2, t0 + dt.timedelta(hours=1), 7, "error", 1.0, "{}"),      # late and a repeat
               (3, t0 + dt.timedelta(days=3), 7, "click", 1.0, "{}"),       # a repeat in an open day
               (5, t0 + dt.timedelta(days=3, hours=2), 7, "error", 1.0, "{}"),
               (6, t0 + dt.timedelta(days=2, hours=2), 8, "click", 1.0, "{}"),
               (None, t0 + dt.timedelta(days=3), 7, "click", 1.0, "{}")])
    name = f"t1_late-{os.path.basename(scratch_dir)}"

    def run():
        stream = ST.turn_rollup_stream(spark, os.path.join(src, "*"), window="1 day", watermark="1 day", max_files=1)
        rows = ST.run_to_table(stream, name, "append").collect()
        return sorted((r.user_id, str(r.window_start)[:10], r.n_events, r.n_ok, r.n_failed) for r in rows)

    closed = (7, "2024-01-10", 2, 1, 1)
    assert run() == [closed]
    drop("e", [(7, t0 + dt.timedelta(days=30), 9, "click", 1.0, "{}")])
    drop("f", [(8, t0 + dt.timedelta(days=31), 9, "click", 1.0, "{}")])
    # the stream goes on where it stopped; every day appears once
    assert run() == [closed, (7, "2024-01-13", 3, 2, 1), (8, "2024-01-12", 1, 1, 0)]


def test_turns_close_and_streams_resume(spark, scratch_dir):
    """Turns close on done or saved, repeats and late events change nothing, an
    open turn ends by timeout; a second run of the same name only sees new files."""
    import datetime as dt

    src, name = os.path.join(scratch_dir, "turns"), f"turns-{os.path.basename(scratch_dir)}"
    os.makedirs(src)
    t0 = dt.datetime(2024, 1, 10, 12)

    def put(rows):
        spark.createDataFrame([(c, t, s, t0 + dt.timedelta(minutes=m), k, None, ok) for c, t, s, m, k, ok in rows],
                              ST.TURN_EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def run():
        events = spark.readStream.schema(ST.TURN_EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        rows = ST.run_to_table(ST.turn_close_stream(events, "10 minutes"), name, "append").drop("epoch").collect()
        return sorted(map(tuple, rows))

    put([(1, 1, 1, 0, "tool_call", None), (1, 1, 2, 1, "tool_result", True), (1, 1, 2, 1, "tool_result", True),
         (1, 1, 3, 2, "figure", None), (2, 1, 1, 0, "tool_call", None)])
    assert run() == []
    put([(1, 1, 4, 3, "tool_call", None), (1, 1, 5, 3, "tool_result", False), (1, 1, 6, 4, "done", None)])
    closed = (1, 1, 2, 1, 1, 1, 0, "done")
    assert run() == [closed]
    put([(1, 1, 7, 4, "tool_call", None), (3, 9, 1, 5, "error", None), (3, 9, 2, 6, "saved", None)])      # after the end
    assert run() == [closed, (3, 9, 0, 0, 0, 0, 1, "saved")]
    put([(4, 1, 1, 600, "tool_call", None)])                                                               # moves the watermark on
    put([(4, 1, 2, 601, "done", None)])
    assert run() == [closed, (2, 1, 1, 0, 0, 0, 0, "timeout"), (3, 9, 0, 0, 0, 0, 1, "saved"), (4, 1, 1, 0, 0, 0, 0, "done")]
