"""Account-store jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.operators import bucket_tables as BT
from hostlens.operators import reports as RP
from hostlens.operators import tables as T
from hostlens.operators.ordering import global_rank, group_rank
from hostlens.plans.common import oracle, session
from hostlens.plans.registry import query
from hostlens.sources.tables import fingerprint, landed, read_table

# Users removed in the deletion scenarios: every admin.
_DELETED = "SELECT email FROM users WHERE role = 'admin'"
_USERS_AFTER = ("users_after AS (SELECT u.* FROM users u WHERE NOT EXISTS "
                "(SELECT 1 FROM users d WHERE d.role = 'admin' AND d.email = u.email))")


def _deleted(spark):
    return spark.sql(_DELETED)


def _users_after(spark):
    return spark.table("users").join(_deleted(spark), "email", "left_anti")


def _ts(c):
    return F.col(c).cast("string").alias(c)


@query("users_with_counts", oracle("""
SELECT u.email, u.first_name, u.last_name, u.role, u.created_at, u.last_login,
       (SELECT COUNT(*) FROM conv_list c WHERE c.user_email = u.email) AS n_conversations
FROM users u
""", "users", "conv_list"))
def users_with_counts(spark, sf_dir):
    session(spark, sf_dir, land=False)
    return T.users_with_counts(spark.table("users"), spark.table("conv_list"))


@query("orphan_rows", oracle("WITH " + _USERS_AFTER + """
SELECT c.id, c.user_email FROM conv_list c
WHERE c.user_email IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users_after u WHERE u.email = c.user_email)
""", "users", "conv_list"))
def orphan_rows(spark, sf_dir):
    session(spark, sf_dir, land=False)
    return T.orphans(spark.table("conv_list"), _users_after(spark), "user_email", "email") \
        .select("id", "user_email")


@query("owned_rows", oracle("WITH " + _USERS_AFTER + """
SELECT c.id, c.user_email FROM conv_list c
WHERE EXISTS (SELECT 1 FROM users_after u WHERE u.email = c.user_email)
""", "users", "conv_list"))
def owned_rows(spark, sf_dir):
    session(spark, sf_dir, land=False)
    return T.owned(spark.table("conv_list"), _users_after(spark), "user_email", "email") \
        .select("id", "user_email")


@query("cascade_delete", oracle("""
SELECT 'message' AS kind, m.id, m.conversation_id FROM messages m
WHERE m.conversation_id NOT IN (
  SELECT c.id FROM conv_list c JOIN users u ON c.user_email = u.email WHERE u.role = 'admin')
UNION ALL
SELECT 'conversation', c.id, c.id FROM conv_list c
WHERE c.user_email NOT IN (SELECT email FROM users WHERE role = 'admin')
""", "users", "conv_list", "messages"))
def cascade_delete(spark, sf_dir):
    session(spark, sf_dir, land=False)
    convs, msgs = T.cascade_delete(_deleted(spark), spark.table("conv_list"), spark.table("messages"))
    return msgs.select(F.lit("message").alias("kind"), "id", "conversation_id").unionByName(
        convs.select(F.lit("conversation").alias("kind"), "id", F.col("id").alias("conversation_id")))


@query("set_null_on_delete", oracle("""
SELECT r.id, CASE WHEN r.user_email IN (SELECT email FROM users WHERE role = 'admin')
                  THEN NULL ELSE r.user_email END AS user_email
FROM reports r
""", "users", "reports"))
def set_null_on_delete(spark, sf_dir):
    session(spark, sf_dir, land=False)
    return T.set_null_on_delete(spark.table("reports"), _deleted(spark)).select("id", "user_email")


@query("platform_stats", oracle("""
SELECT 'users_by_role' AS metric, role AS key, COUNT(*) AS n FROM users GROUP BY role
UNION ALL SELECT 'users_total', NULL, COUNT(*) FROM users
UNION ALL SELECT 'conversations_total', NULL, COUNT(*) FROM conv_list
UNION ALL SELECT 'messages_total', NULL, COUNT(*) FROM messages
""", "users", "conv_list", "messages"))
def platform_stats(spark, sf_dir):
    session(spark, sf_dir, land=False)
    return T.platform_stats(spark.table("users"), spark.table("conv_list"), spark.table("messages"))


_LIST_USER = "  User7@Example.ORG "


@query("conversation_list", oracle("""
SELECT id, title, CAST(created_at AS VARCHAR) AS created_at, CAST(updated_at AS VARCHAR) AS updated_at,
       ROW_NUMBER() OVER (ORDER BY updated_at DESC, id DESC) AS rank
FROM conv_list WHERE user_email = 'user7@example.org'
""", "conv_list"))
def conversation_list(spark, sf_dir):
    session(spark, sf_dir, land=False)
    out = T.conversation_list(spark.table("conv_list"), _LIST_USER.strip().lower())
    return global_rank(out, [("updated_at", False), ("id", False)]).select("id", "title", _ts("created_at"), _ts("updated_at"), "rank")


def _joined(c):
    return F.array_join(F.col(c), "|").alias(c)


@query("message_list", oracle("""
SELECT id, conversation_id, role, content, CAST(created_at AS VARCHAR) AS created_at,
       array_to_string(CAST(json_extract(payload_json, '$.ncbi_urls') AS VARCHAR[]), '|') AS ncbi_urls,
       array_to_string(CAST(json_extract(payload_json, '$.figures') AS VARCHAR[]), '|') AS figures,
       array_to_string(CAST(json_extract(payload_json, '$.pubmed_urls') AS VARCHAR[]), '|') AS pubmed_urls,
       array_to_string(CAST(json_extract(payload_json, '$.wikipedia_urls') AS VARCHAR[]), '|') AS wikipedia_urls,
       array_to_string(CAST(json_extract(payload_json, '$.executed_codes') AS VARCHAR[]), '|') AS executed_codes,
       ROW_NUMBER() OVER (PARTITION BY conversation_id ORDER BY id) AS rank
FROM messages
""", "messages"))
def message_list(spark, sf_dir):
    session(spark, sf_dir, land=False)
    decoded = T.decode_payload(spark.table("messages"))
    return group_rank(decoded, "conversation_id", ["id"]).select(
        "id", "conversation_id", "role", "content", _ts("created_at"), *[_joined(k) for k in T.PAYLOAD_KEYS], "rank")


@query("report_list_by_status", oracle("""
SELECT id, user_email, question, answer, comment, CAST(created_at AS VARCHAR) AS created_at,
       CAST(updated_at AS VARCHAR) AS updated_at, status,
       array_to_string(COALESCE(CAST(json(executed_codes) AS VARCHAR[]), []), '|') AS executed_codes,
       array_to_string(COALESCE(CAST(json(recent_logs) AS VARCHAR[]), []), '|') AS recent_logs,
       len(COALESCE(CAST(json(recent_logs) AS VARCHAR[]), [])) AS n_logs,
       ROW_NUMBER() OVER (ORDER BY id DESC) AS rank
FROM reports WHERE status = 'open'
""", "reports"))
def report_list_by_status(spark, sf_dir):
    session(spark, sf_dir, land=False)
    out = global_rank(T.report_list(spark.table("reports"), "open"), [("id", False)])
    return out.select("id", "user_email", "question", "answer", "comment", F.col("created_at").cast("string").alias("created_at"),
                      F.col("updated_at").cast("string").alias("updated_at"), "status", _joined("executed_codes"), _joined("recent_logs"),
                      F.size("recent_logs").cast("bigint").alias("n_logs"), "rank")


@query("open_report_count", oracle(
    "SELECT COUNT(*) FILTER (WHERE status = 'open') AS n_open, COUNT(*) AS n_reports FROM reports",
    "reports"))
def open_report_count(spark, sf_dir):
    session(spark, sf_dir, land=False)
    return spark.table("reports").agg(F.count_if(F.col("status") == "open").alias("n_open"),
                                      F.count(F.lit(1)).alias("n_reports"))


@query("user_search", oracle("""
SELECT email, first_name, last_name FROM users
WHERE contains(lower(COALESCE(email, '')), 'user12') OR contains(lower(COALESCE(first_name, '')), 'user12')
   OR contains(lower(COALESCE(last_name, '')), 'user12')
""", "users"))
def user_search(spark, sf_dir):
    session(spark, sf_dir, land=False)
    return T.user_search(spark.table("users"), "  USER12 ").select("email", "first_name", "last_name")


# -- U1: upsert batches derived from the user table ----------------------------------
_UPSERT_BATCHES = """
SELECT email, upper(first_name) AS first_name, role, last_login, 1 AS seq FROM users WHERE role = 'dev'
UNION ALL
SELECT email, first_name, 'user' AS role, '2024-06-01' AS last_login, 2 AS seq FROM users WHERE last_login IS NULL
UNION ALL
SELECT concat('new', CAST(user_key AS STRING), '@example.org') AS email, first_name, 'user' AS role,
       NULL AS last_login, 1 AS seq FROM users WHERE role = 'dev'
"""


@query("upsert_latest", oracle("WITH batches AS (" + _UPSERT_BATCHES + """),
allrows AS (SELECT email, first_name, role, last_login, 0 AS seq FROM users UNION ALL SELECT * FROM batches)
SELECT email, first_name, role, last_login, seq FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY email ORDER BY seq DESC) AS rn FROM allrows) x
WHERE rn = 1
""", "users"))
def upsert_latest(spark, sf_dir):
    session(spark, sf_dir, land=False)
    base = spark.table("users").select("email", "first_name", "role", "last_login",
                                       F.lit(0).alias("seq"))
    batches = spark.sql(_UPSERT_BATCHES)
    return T.upsert_latest(base, batches, ["email"], ["seq"])


@query("upsert_buckets", oracle("WITH batches AS (" + _UPSERT_BATCHES + """),
allrows AS (SELECT email, first_name, role, last_login, 0 AS seq FROM users UNION ALL SELECT * FROM batches)
SELECT email, first_name, role, last_login, seq FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY email ORDER BY seq DESC) AS rn FROM allrows) x
WHERE rn = 1
""", "users"))
def upsert_buckets(spark, sf_dir):
    session(spark, sf_dir, land=False)
    base = spark.table("users").select("email", "first_name", "role", "last_login", F.lit(0).alias("seq"))

    def write(path):
        BT.create(base, ["email"], path, 16)
        BT.apply_batch(spark, path, spark.sql(_UPSERT_BATCHES), ["email"], ["seq"], 16)

    return BT.read(spark, landed(spark, f"users-{fingerprint(spark, sf_dir, ('customer',), 'buckets-v1')}", write), base.schema)


# -- U2: report status changes derived from orders -----------------------------------
_CHANGES = """
SELECT o_orderkey * 4 AS change_id, o_orderkey AS id, 'in_progress' AS status
FROM orders WHERE o_orderpriority = '2-HIGH'
UNION ALL
SELECT o_orderkey * 4 + 1, o_orderkey, 'done' FROM orders
WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 300000
UNION ALL
SELECT o_orderkey * 4 + 2, o_orderkey + 1000000000, 'done' FROM orders WHERE o_orderpriority = '3-MEDIUM'
UNION ALL
SELECT o_orderkey * 4 + 3, o_orderkey, 'bogus' FROM orders
WHERE o_orderpriority = '5-LOW' AND o_totalprice > 400000
"""


def _apply(spark, sf_dir):
    session(spark, sf_dir, land=False)
    changes = spark.sql(_CHANGES)
    touched = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return T.apply_status_changes(spark.table("reports"), changes, touched)


@query("apply_changes", oracle("WITH changes AS (" + _CHANGES + """),
latest AS (SELECT id, arg_max(status, change_id) AS new_status FROM changes
           WHERE status IN ('open', 'in_progress', 'done') AND id IN (SELECT id FROM reports) GROUP BY id)
SELECT r.id, COALESCE(l.new_status, r.status) AS status,
       CAST(CASE WHEN l.new_status IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00'
                 ELSE r.updated_at END AS VARCHAR) AS updated_at
FROM reports r LEFT JOIN latest l ON r.id = l.id
""", "reports"))
def apply_changes(spark, sf_dir):
    out, _ = _apply(spark, sf_dir)
    return out.select("id", "status", F.col("updated_at").cast("string").alias("updated_at"))


@query("rejected_changes", oracle("WITH changes AS (" + _CHANGES + """)
SELECT change_id, id, 'invalid_status' AS reason FROM changes
WHERE status NOT IN ('open', 'in_progress', 'done')
UNION ALL
SELECT change_id, id, 'unknown_id' AS reason FROM changes
WHERE status IN ('open', 'in_progress', 'done') AND id NOT IN (SELECT id FROM reports)
""", "reports"))
def rejected_changes(spark, sf_dir):
    _, rejects = _apply(spark, sf_dir)
    return rejects


@query("touch_from_messages", oracle("""
SELECT c.id, CAST(GREATEST(c.updated_at, m.last_at) AS VARCHAR) AS updated_at
FROM conv_list c LEFT JOIN (SELECT conversation_id, MAX(created_at) AS last_at FROM messages
                            GROUP BY conversation_id) m ON c.id = m.conversation_id
""", "conv_list", "messages"))
def touch_from_messages(spark, sf_dir):
    session(spark, sf_dir, land=False)
    out = T.touch_from_messages(spark.table("conv_list"), spark.table("messages"))
    return out.select("id", F.col("updated_at").cast("string").alias("updated_at"))


_RENAMES = """
SELECT o_orderkey * 2 AS change_id, o_orderkey AS id, concat('  renamed ', o_orderpriority) AS title,
       o_orderdate + INTERVAL 1 DAY AS changed_at FROM orders WHERE o_orderkey % 3 = 0
UNION ALL
SELECT o_orderkey * 2 + 1, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '   ' ELSE 'last' END, o_orderdate + INTERVAL 2 DAY
FROM orders WHERE o_orderkey % 9 = 0
"""


@query("rename_and_touch", oracle("WITH renames AS (" + _RENAMES + """),
last AS (SELECT id, title, changed_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY change_id DESC) AS rn FROM renames) x WHERE rn = 1)
SELECT c.id, CASE WHEN l.id IS NULL THEN c.title WHEN trim(l.title) = '' THEN 'New conversation' ELSE trim(l.title) END AS title,
       CAST(COALESCE(l.changed_at, c.updated_at) AS VARCHAR) AS updated_at
FROM conv_list c LEFT JOIN last l ON l.id = c.id
""", "conv_list"))
def rename_and_touch(spark, sf_dir):
    session(spark, sf_dir, land=False)
    out = T.rename_conversations(spark.table("conv_list"), spark.sql(_RENAMES))
    return out.select("id", "title", _ts("updated_at"))


_USER_CHANGES = """
SELECT user_key * 4 AS change_id, email, 'dev' AS role, NULL AS last_login FROM users WHERE user_key % 5 = 0
UNION ALL
SELECT user_key * 4 + 1, concat(' ', upper(email)), NULL, '2024-07-01' FROM users WHERE user_key % 4 = 0
UNION ALL
SELECT user_key * 4 + 2, email, 'owner', '2024-08-01' FROM users WHERE user_key % 10 = 0
UNION ALL
SELECT user_key * 4 + 3, concat('no-', email), 'admin', NULL FROM users WHERE user_key % 50 = 0
"""


@query("set_roles", oracle("WITH changes AS (SELECT change_id, lower(trim(email)) AS email, role, last_login FROM (" + _USER_CHANGES + """) c),
ok AS (SELECT * FROM changes WHERE role IS NULL OR role IN ('user', 'dev', 'admin')),
rejected AS (SELECT email, COUNT(*) AS n FROM (
    SELECT email FROM changes WHERE role NOT IN ('user', 'dev', 'admin')
    UNION ALL SELECT email FROM ok WHERE email NOT IN (SELECT email FROM users)) r GROUP BY email)
SELECT COALESCE(u.email, r.email) AS email,
       COALESCE((SELECT arg_max(role, change_id) FROM ok WHERE ok.email = u.email AND ok.role IS NOT NULL), u.role) AS role,
       COALESCE((SELECT arg_max(last_login, change_id) FROM ok WHERE ok.email = u.email AND ok.last_login IS NOT NULL), u.last_login) AS last_login,
       COALESCE(r.n, 0) AS n_rejected
FROM users u FULL JOIN rejected r ON r.email = u.email
""", "users"))
def set_roles(spark, sf_dir):
    session(spark, sf_dir, land=False)
    users, rejects = T.apply_user_changes(spark.table("users"), spark.sql(_USER_CHANGES))
    n = rejects.groupBy("email").agg(F.count(F.lit(1)).alias("n_rejected"))
    return users.join(n, "email", "full").select("email", "role", "last_login", F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"))


# a reply to every user turn that is a conversation's last, and one message nobody owns
_NEW_MESSAGES = """
SELECT conv_id * 100 + turn AS seq, conv_id AS conversation_id, 'assistant' AS role, concat('re: ', text) AS content,
       TIMESTAMP '2024-03-01 00:00:00' + CAST(turn AS INTEGER) * INTERVAL 1 MINUTE AS created_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) x
WHERE rn = 1 AND role = 'user'
UNION ALL SELECT -1, -5, 'user', 'lost', TIMESTAMP '2024-03-01 00:00:00'
"""


@query("append_messages", oracle("WITH added AS (" + _NEW_MESSAGES + """),
known AS (SELECT * FROM added WHERE conversation_id IN (SELECT id FROM conv_list)),
rows AS (
  SELECT id, conversation_id, role, content, payload_json, created_at FROM messages
  UNION ALL
  SELECT (SELECT max(id) FROM messages) + ROW_NUMBER() OVER (ORDER BY seq), conversation_id, role, content,
         concat('{"figures":[],"ncbi_urls":["n', CAST(seq AS VARCHAR), '"]}'), created_at FROM known)
SELECT r.id, r.conversation_id, r.role, r.content, r.payload_json, CAST(r.created_at AS VARCHAR) AS created_at,
       CAST(GREATEST(c.updated_at, t.last) AS VARCHAR) AS conversation_updated_at
FROM rows r LEFT JOIN conv_list c ON c.id = r.conversation_id
LEFT JOIN (SELECT conversation_id, max(created_at) AS last FROM known GROUP BY conversation_id) t ON t.conversation_id = c.id
""", "messages", "conv_list"))
def append_messages(spark, sf_dir):
    session(spark, sf_dir, land=False)
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("array<string>")
    new = spark.sql(_NEW_MESSAGES).select(
        "seq", "conversation_id", "role", "content", "created_at", empty.alias("figures"), none.alias("wikipedia_urls"),
        none.alias("pubmed_urls"), F.array(F.concat(F.lit("n"), F.col("seq").cast("string"))).alias("ncbi_urls"), none.alias("executed_codes"))
    messages, conversations = T.append_messages(spark.table("messages").drop("turn"), spark.table("conv_list"), new)
    touched = conversations.select(F.col("id").alias("conversation_id"), F.col("updated_at").cast("string").alias("conversation_updated_at"))
    return messages.join(touched, "conversation_id", "left").select(
        "id", "conversation_id", "role", "content", "payload_json", _ts("created_at"), "conversation_updated_at")


# -- F14: addresses found in documents, checked against the domain rule -----------------
_EMAIL_RE = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
_BLOCKED_SQL = ", ".join(f"'{d}'" for d in T.BLOCKED_EMAIL_DOMAINS)


@query("email_domain_rule", f"""
SELECT doc_id, email, split_part(email, '@', -1) AS domain,
       CASE WHEN NOT contains(split_part(email, '@', -1), '.') THEN 'invalid'
            WHEN split_part(email, '@', -1) IN ({_BLOCKED_SQL}) THEN 'blocked_domain' END AS verdict
FROM (SELECT doc_id, lower(trim(unnest(regexp_extract_all(text, '{_EMAIL_RE}')))) AS email FROM documents) x
""")
def email_domain_rule(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    # only texts with an '@' can hold an address: a cheap substring test
    # spares the regex scan of the others (same result)
    found = docs.filter(F.col("text").contains("@")).select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(_EMAIL_RE), 0)).alias("raw"))
    email = F.lower(F.trim("raw"))
    return found.select("doc_id", email.alias("email"), T.email_domain(email).alias("domain"),
                        T.email_rule(email).alias("verdict"))


# every error event files a report; every event is a line of its month's log
LOG_LINES_SQL = """
SELECT event_id, ts, substring(CAST(ts AS VARCHAR(30)), 1, 7) AS month,
       concat(substring(CAST(ts AS VARCHAR(30)), 1, 19), ' | ', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END, ' | ',
              event_type, ' by ', CAST(user_id AS VARCHAR(20))) AS line
FROM events
"""


@query("report_recent_logs", f"""
WITH lines AS ({LOG_LINES_SQL}),
l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY month ORDER BY ts, event_id) AS pos FROM lines),
r AS (SELECT l.event_id AS report_id, l.month, MAX(pos) OVER (PARTITION BY l.month ORDER BY l.ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last,
             event_type FROM l JOIN (SELECT event_id, event_type FROM events) e USING (event_id))
SELECT report_id, COUNT(*) AS n_lines, MIN(l.line) AS least_line, sha256(string_agg(l.line, chr(10) ORDER BY l.pos)) AS lines_sha256
FROM (SELECT * FROM r WHERE event_type = 'error') r JOIN l ON l.month = r.month AND l.pos <= r.last AND l.pos > r.last - 200
GROUP BY report_id
""")
def report_recent_logs(spark, sf_dir):
    read_table(spark, sf_dir, "events").createOrReplaceTempView("events")
    lines = spark.sql(LOG_LINES_SQL).withColumnRenamed("event_id", "line_key")
    reports = spark.table("events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    out = RP.with_recent_logs(reports, lines)
    return out.select(F.col("id").alias("report_id"), F.size("recent_logs").cast("bigint").alias("n_lines"),
                      F.array_min("recent_logs").alias("least_line"),
                      F.sha2(F.array_join("recent_logs", "\n").cast("binary"), 256).alias("lines_sha256"))
