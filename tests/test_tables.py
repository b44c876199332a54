"""Account-store jobs (cases from the reference's database tests)."""

import pytest
from pyspark.sql import functions as F

from hostlens.operators import tables as T

USERS = "email STRING, first_name STRING, last_name STRING, role STRING, created_at STRING, last_login STRING"
CONVS = "id BIGINT, user_email STRING, title STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
MSGS = "id BIGINT, conversation_id BIGINT, role STRING, content STRING, payload_json STRING, created_at TIMESTAMP"


def users(spark):
    return spark.createDataFrame([
        ("a@lab.org", "Ann", "A", "user", "2024-01-01", None),
        ("b@lab.org", "Bob", "B", "admin", "2024-01-02", None),
    ], USERS)


def convs(spark):
    from datetime import datetime
    return spark.createDataFrame([
        (1, "a@lab.org", "first", datetime(2024, 1, 1), datetime(2024, 1, 1)),
        (2, "a@lab.org", "second", datetime(2024, 1, 2), datetime(2024, 1, 2)),
        (3, "b@lab.org", "bob's", datetime(2024, 1, 3), datetime(2024, 1, 3)),
    ], CONVS)


def msgs(spark):
    from datetime import datetime
    return spark.createDataFrame([
        (10, 1, "user", "q", None, datetime(2024, 2, 1)),
        (11, 1, "assistant", "a", '{"pubmed_urls": ["u1", "u2"], "figures": []}', datetime(2024, 2, 2)),
        (12, 3, "user", "q", None, datetime(2024, 2, 3)),
    ], MSGS)


def test_users_with_counts(spark):
    rows = {r.email: r for r in T.users_with_counts(users(spark), convs(spark)).collect()}
    assert rows["a@lab.org"].n_conversations == 2
    assert rows["b@lab.org"].n_conversations == 1
    assert "password_hash" not in T.users_with_counts(users(spark), convs(spark)).columns
    none = T.users_with_counts(users(spark), convs(spark).limit(0))
    assert {r.n_conversations for r in none.collect()} == {0}


def test_touch_moves_conversation_to_top(spark):
    touched = T.touch_from_messages(convs(spark), msgs(spark))
    mine = touched.filter(F.col("user_email") == "a@lab.org")
    listed = T.conversation_list(mine, " A@LAB.org ")
    order = [r.id for r in listed.collect()]
    assert order == [1, 2]          # conversation 1 got a newer message


def test_cascade_and_set_null(spark):
    gone = users(spark).filter(F.col("email") == "a@lab.org")
    conv_left, msg_left = T.cascade_delete(gone, convs(spark), msgs(spark))
    assert sorted(r.id for r in conv_left.collect()) == [3]
    assert sorted(r.id for r in msg_left.collect()) == [12]
    reports = spark.createDataFrame([(1, "a@lab.org"), (2, "b@lab.org")], "id BIGINT, user_email STRING")
    kept = {r.id: r.user_email for r in T.set_null_on_delete(reports, gone).collect()}
    assert kept == {1: None, 2: "b@lab.org"}


def test_orphans(spark):
    parent = users(spark).filter(F.col("role") == "admin")
    orphans = T.orphans(convs(spark), parent, "user_email", "email")
    assert sorted(r.id for r in orphans.collect()) == [1, 2]
    owned = T.owned(convs(spark), parent, "user_email", "email")
    assert [r.id for r in owned.collect()] == [3]


def test_payload_round_trip(spark):
    m = T.decode_payload(msgs(spark)).filter(F.col("id") == 11).first()
    assert m.pubmed_urls == ["u1", "u2"] and m.figures == [] and m.ncbi_urls is None
    df = spark.createDataFrame([(["f"], None, ["p1", "p2"], None, ["c"])],
                               ", ".join(f"{k} ARRAY<STRING>" for k in T.PAYLOAD_KEYS))
    js = df.select(T.encode_payload(df).alias("j")).first().j
    back = T.decode_payload(df.select(F.lit(1).alias("id"), F.lit(js).alias("payload_json"))).first()
    assert back.pubmed_urls == ["p1", "p2"] and back.wikipedia_urls is None


def test_status_changes(spark):
    from datetime import datetime
    reports = spark.createDataFrame([(1, "open", datetime(2024, 1, 1))],
                                    "id BIGINT, status STRING, created_at TIMESTAMP")
    changes = spark.createDataFrame([(1, 1, "in_progress"), (2, 999, "done"), (3, 1, "bogus")],
                                    "change_id BIGINT, id BIGINT, status STRING")
    out, rej = T.apply_status_changes(reports, changes, F.current_timestamp())
    assert out.first().status == "in_progress"
    assert {(r.id, r.reason) for r in rej.collect()} == {(999, "unknown_id"), (1, "invalid_status")}
    with pytest.raises(ValueError):
        T.report_list(reports, "bogus")


def test_upsert_last_value_wins(spark):
    base = spark.createDataFrame([("a", "x", 0), ("b", "y", 0)], "k STRING, v STRING, seq INT")
    batch = spark.createDataFrame([("a", "x1", 1), ("a", "x2", 2), ("c", "z", 1)], "k STRING, v STRING, seq INT")
    got = {r.k: r.v for r in T.upsert_latest(base, batch, ["k"], ["seq"]).collect()}
    assert got == {"a": "x2", "b": "y", "c": "z"}


def test_user_search_and_stats(spark):
    assert {r.email for r in T.user_search(users(spark), " ANN ").collect()} == {"a@lab.org"}
    assert T.user_search(users(spark), "  ").count() == 2
    stats = {(r.metric, r.key): r.n for r in T.platform_stats(users(spark), convs(spark), msgs(spark)).collect()}
    assert stats[("users_total", None)] == 2 and stats[("users_by_role", "admin")] == 1
    assert stats[("messages_total", None)] == 3


def test_email_rule(spark):
    df = spark.createDataFrame([(" Ann@Gmail.com ",), ("a@lab.org",), ("nope",), ("x@localhost",)], "e STRING")
    got = [r[0] for r in df.select(T.email_rule(F.col("e"))).collect()]
    assert got == ["blocked_domain", None, "invalid", "invalid"]


def test_platform_stats_with_an_unknown_role(spark):
    users = spark.createDataFrame([("a", "user"), ("b", None)], "email STRING, role STRING")
    none = spark.createDataFrame([], "id BIGINT")
    rows = [tuple(r) for r in T.platform_stats(users, none, none).collect()]
    assert sorted(rows, key=str) == sorted([("users_by_role", "user", 1), ("users_by_role", None, 1), ("users_total", None, 2),
                                            ("conversations_total", None, 0), ("messages_total", None, 0)], key=str)
