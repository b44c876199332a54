"""Turn jobs: context window, history filter, budget, sources fold."""

from datetime import datetime, timedelta

from hostlens.operators import turns as TU


def test_context_window(spark):
    rows = []
    for i in range(1, 6):
        rows.append((1, 2 * i, "user", f"q{i}"))
        rows.append((1, 2 * i + 1, "assistant", f"a{i}"))
    msgs = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    got = [r.text for r in TU.context_window(msgs, 2).orderBy("turn").collect()]
    assert got == ["q4", "a4", "q5", "a5"]
    assert TU.context_window(msgs, 0).count() == 10


def test_history_filter(spark):
    msgs = spark.createDataFrame([
        (1, 1, "user", "q", None), (1, 2, "assistant", None, "call"), (1, 3, "tool", "r", None),
        (1, 4, "system", "s", None), (1, 5, "assistant", "final", None)],
        "conv_id BIGINT, turn BIGINT, role STRING, text STRING, tool_calls STRING")
    got = [r.turn for r in TU.context_window(msgs, 0).orderBy("turn").collect()]
    assert got == [1, 5]


def test_call_numbering_budget_is_per_round(spark):
    t0 = datetime(2024, 1, 1)
    rows = []
    cid = 0
    for rnd, n in [(1, 4), (2, 4), (3, 2)]:       # 4 + 4 calls, then 2 more
        for i in range(n):
            cid += 1
            rows.append((cid, 1, 1, rnd, t0 + timedelta(minutes=cid)))
    calls = spark.createDataFrame(rows, "call_id BIGINT, conv_id BIGINT, turn BIGINT, round BIGINT, ts TIMESTAMP")
    out = {r.call_id: r for r in TU.call_numbering(calls, 7).collect()}
    assert [out[i].call_no for i in range(1, 11)] == list(range(1, 11))
    # round 2 starts with 4 used (< 7) so it runs whole and overshoots to 8
    assert not any(out[i].over_budget for i in range(1, 9))
    assert all(out[i].over_budget for i in (9, 10))


def test_sources_fold_first_seen_order(spark):
    t0 = datetime(2024, 1, 1)
    arts = spark.createDataFrame([
        (1, 1, 1, 1, t0, True, 0, "url", "https://w/B", None),
        (2, 1, 1, 1, t0 + timedelta(seconds=1), True, 0, "url", "https://w/A", None),
        (3, 1, 1, 2, t0, True, 0, "url", "https://w/B", None),
        (4, 1, 1, 2, t0, False, 0, "url", "https://w/C", None),
        (5, 1, 1, 2, t0, True, 0, "pubmed", None, 123),
        (5, 1, 1, 2, t0, True, 1, "pubmed", None, 123),
    ], "call_id BIGINT, conv_id BIGINT, turn BIGINT, round BIGINT, ts TIMESTAMP, success BOOLEAN, "
       "pos INT, type STRING, url STRING, pmid BIGINT")
    got = sorted((r.kind, r.rank, r.item) for r in TU.turn_sources(arts).collect())
    assert got == [("pubmed", 1, "https://pubmed.ncbi.nlm.nih.gov/123/"),
                   ("wiki", 1, "https://w/B"), ("wiki", 2, "https://w/A")]


def test_turn_summary(spark):
    calls = spark.createDataFrame([(1, 1, "query_host_sql", True), (1, 1, "create_map", True),
                                   (1, 1, "pubmed_search", False)],
                                  "conv_id BIGINT, turn BIGINT, tool STRING, success BOOLEAN")
    r = TU.turn_summary(calls).first()
    assert (r.calls_used, r.ok_calls, r.failed_calls, r.figures, r.snippets) == (3, 2, 1, 1, 1)


def test_code_snippets_not_deduped_sql_prefixed(spark):
    t0 = datetime(2024, 1, 1)
    calls = spark.createDataFrame([
        (1, 1, 1, 1, t0, "query_host_sql", True, "SELECT 1", None),
        (2, 1, 1, 1, t0 + timedelta(seconds=1), "query_dataframe", True, None, "result = df"),
        (3, 1, 1, 2, t0, "query_host_sql", True, "SELECT 1", None),
        (4, 1, 1, 2, t0, "query_host_sql", False, "SELECT 2", None),
    ], "call_id BIGINT, conv_id BIGINT, turn BIGINT, round BIGINT, ts TIMESTAMP, tool STRING, "
       "success BOOLEAN, sql STRING, code STRING")
    arts = spark.createDataFrame([], "call_id BIGINT, conv_id BIGINT, turn BIGINT, round BIGINT, "
                                     "ts TIMESTAMP, success BOOLEAN, pos INT, type STRING, url STRING, pmid BIGINT")
    got = sorted((r.rank, r.item) for r in TU.turn_sources(arts, calls).collect())
    assert got == [(1, "-- SQL (query_host_sql)\nSELECT 1"), (2, "result = df"),
                   (3, "-- SQL (query_host_sql)\nSELECT 1")]
