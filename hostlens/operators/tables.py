"""Account-store jobs as batch table operators.

The reference edits single SQLite rows; here a batch of edits is applied to
a table and the result is a new table version (written elsewhere with
``write.mode("overwrite")`` to a fresh path, never in place).

Skew: "last value wins" uses ``max_by`` aggregates, which combine map-side,
instead of a window over the key, so a key with many edits is not moved into
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.operators.ordering import global_rank

# Fixed values that must equal the reference's.
VALID_ROLES = ("user", "dev", "admin")
REPORT_STATUSES = ("open", "in_progress", "done")
PAYLOAD_KEYS = ("figures", "wikipedia_urls", "pubmed_urls", "ncbi_urls", "executed_codes")
BLOCKED_EMAIL_DOMAINS = (
    "gmail.com", "googlemail.com",
    "outlook.com", "outlook.fr", "hotmail.com", "hotmail.fr", "live.com", "live.fr", "msn.com",
    "yahoo.com", "yahoo.fr", "ymail.com",
    "icloud.com", "me.com", "mac.com",
    "aol.com",
    "proton.me", "protonmail.com",
    "gmx.com", "gmx.fr", "gmx.de",
    "orange.fr", "wanadoo.fr", "free.fr", "sfr.fr", "laposte.net", "bbox.fr",
    "yandex.com", "yandex.ru", "mail.com", "zoho.com",
)

REPORT_FIELDS = ("question", "answer", "comment", "created_at", "updated_at")

PAYLOAD_SCHEMA = ", ".join(f"{k} ARRAY<STRING>" for k in PAYLOAD_KEYS)


# -- J2 -------------------------------------------------------------------------
def users_with_counts(users: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every user with its conversation count (zero kept), ordered by
    creation time; the count is pre-aggregated per owner (map-side combine)
    before the join, and the order is a distributed range sort."""
    counts = conversations.groupBy(F.col("user_email").alias("email")) \
        .agg(F.count(F.lit(1)).alias("n_conversations"))
    cols = ["email", "first_name", "last_name", "role", "created_at", "last_login"]
    return (users.select(*cols).join(counts, "email", "left")
            .withColumn("n_conversations", F.coalesce("n_conversations", F.lit(0).cast("bigint")))
            .orderBy("created_at", "email"))


# -- J3 / J4 / J5 -------------------------------------------------------------------
def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent (FK violations); NULL keys are not orphans."""
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.filter(F.col(child_key).isNotNull()) \
        .join(p, F.col(child_key) == F.col("_pk"), "left_anti")


def owned(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.join(p, F.col(child_key) == F.col("_pk"), "left_semi")


def cascade_delete(deleted_users: DataFrame, conversations: DataFrame,
                   messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleting users removes their conversations and those conversations'
    messages: two chained anti joins.  Returns (conversations, messages)."""
    gone = deleted_users.select(F.col("email").alias("_gone")).distinct()
    dead_conv = conversations.join(gone, F.col("user_email") == F.col("_gone"), "left_semi") \
        .select(F.col("id").alias("_dead"))
    conv_left = conversations.join(gone, F.col("user_email") == F.col("_gone"), "left_anti")
    msg_left = messages.join(dead_conv, F.col("conversation_id") == F.col("_dead"), "left_anti")
    return conv_left, msg_left


def set_null_on_delete(rows: DataFrame, deleted_users: DataFrame, fk: str = "user_email") -> DataFrame:
    """Rows survive the deletion of their owner, with the owner set to NULL."""
    gone = deleted_users.select(F.col("email").alias("_gone"), F.lit(True).alias("_hit")).distinct()
    return (rows.join(gone, F.col(fk) == F.col("_gone"), "left")
            .withColumn(fk, F.when(F.col("_hit"), F.lit(None).cast("string")).otherwise(F.col(fk)))
            .drop("_gone", "_hit"))


# -- A3 / A9 ----------------------------------------------------------------------------
def platform_stats(users: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Totals in long form (metric, key, n): users per role and in total from
    one ROLLUP pass, then conversation and message counts."""
    by_role = users.rollup("role").agg(F.count(F.lit(1)).alias("n"), F.grouping("role").alias("_all"))
    users_part = by_role.select(
        F.when(F.col("_all") == 1, F.lit("users_total")).otherwise(F.lit("users_by_role"))
        .alias("metric"), F.col("role").alias("key"), "n")
    conv = conversations.agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("conversations_total").alias("metric"), F.lit(None).cast("string").alias("key"), "n")
    msg = messages.agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("messages_total").alias("metric"), F.lit(None).cast("string").alias("key"), "n")
    return users_part.unionByName(conv).unionByName(msg)


# -- P9 / P11 / L2 / L3 / L4 / P12 ----------------------------------------------------------------
def user_search(users: DataFrame, q: str | None) -> DataFrame:
    """Case-insensitive literal substring in email, first or last name; a
    blank query returns everyone."""
    needle = (q or "").strip().lower()
    if not needle:
        return users
    hit = F.lit(False)
    for c in ("email", "first_name", "last_name"):
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle)
    return users.filter(hit)


def conversation_list(conversations: DataFrame, email: str) -> DataFrame:
    """One user's conversations, most recently updated first."""
    mine = conversations.filter(F.col("user_email") == F.lower(F.lit(email.strip())))
    return mine.select("id", "title", "created_at", "updated_at").orderBy(F.desc("updated_at"), F.desc("id"))


def decode_payload(messages: DataFrame) -> DataFrame:
    """Spread the payload's five optional arrays beside role and content;
    an absent key stays NULL."""
    p = F.from_json(F.col("payload_json"), PAYLOAD_SCHEMA)
    return messages.select("*", *[p[k].alias(k) for k in PAYLOAD_KEYS]).drop("payload_json")


def encode_payload(df: DataFrame) -> Column:
    """Inverse of ``decode_payload``: NULL arrays are left out of the JSON."""
    return F.to_json(F.struct(*[F.col(k) for k in PAYLOAD_KEYS]))


def report_list(reports: DataFrame, status: str | None = None) -> DataFrame:
    """Reports newest first, optionally of one status (validated); the two
    JSON array columns parsed, NULL → empty array."""
    if status:
        if status not in REPORT_STATUSES:
            raise ValueError(f"invalid status: {status!r}")
        reports = reports.filter(F.col("status") == status)
    empty = F.array().cast("array<string>")
    parsed = reports.select(
        "id", "user_email", *[c for c in REPORT_FIELDS if c in reports.columns], "status",
        F.coalesce(F.from_json("executed_codes", "ARRAY<STRING>"), empty).alias("executed_codes"),
        F.coalesce(F.from_json("recent_logs", "ARRAY<STRING>"), empty).alias("recent_logs"))
    return parsed.orderBy(F.desc("id"))


# -- U1 / U2 / U3 ---------------------------------------------------------------------------
def upsert_latest(base: DataFrame, batches: DataFrame, key: Sequence[str],
                  order: Sequence[str]) -> DataFrame:
    """``ON CONFLICT(key) DO UPDATE`` for a whole batch: per key the row with
    the greatest ``order`` wins.  ``base`` and ``batches`` share a schema
    that includes the ``order`` columns (base rows carry the lowest)."""
    rows = base.unionByName(batches)
    value_cols = [c for c in rows.columns if c not in key]
    win = rows.groupBy(*key).agg(
        F.max_by(F.struct(*value_cols), F.struct(*order)).alias("_row"))
    return win.select(*key, *[F.col("_row")[c].alias(c) for c in value_cols])


def apply_status_changes(reports: DataFrame, changes: DataFrame,
                         touched_at: Column) -> tuple[DataFrame, DataFrame]:
    """Report status changes (``change_id, id, status``) applied as one batch.

    Per report the latest valid change wins; invalid statuses and unknown ids
    are returned as rejects with a reason.  Returns (new_reports, rejects)."""
    valid = F.col("status").isin(*REPORT_STATUSES)
    known = changes.join(reports.select(F.col("id").alias("_rid")),
                         F.col("id") == F.col("_rid"), "left_semi")
    rejects = (changes.filter(~valid).select("change_id", "id", F.lit("invalid_status").alias("reason"))
               .unionByName(changes.filter(valid).join(known.select("change_id"), "change_id", "left_anti")
                            .select("change_id", "id", F.lit("unknown_id").alias("reason"))))
    latest = (known.filter(valid).groupBy("id")
              .agg(F.max_by("status", "change_id").alias("_new_status")))
    out = (reports.join(latest, "id", "left")
           .withColumn("updated_at", F.when(F.col("_new_status").isNotNull(), touched_at)
                       .otherwise(F.col("updated_at" if "updated_at" in reports.columns else "created_at")))
           .withColumn("status", F.coalesce("_new_status", "status"))
           .drop("_new_status"))
    return out, rejects


def touch_from_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """A conversation's ``updated_at`` becomes its newest message time when
    that is later (per-conversation max, map-side combined)."""
    last = messages.groupBy(F.col("conversation_id").alias("id")) \
        .agg(F.max("created_at").alias("_last"))
    return (conversations.join(last, "id", "left")
            .withColumn("updated_at", F.greatest(F.col("updated_at").cast("timestamp"), F.col("_last")))
            .drop("_last"))


def rename_conversations(conversations: DataFrame, renames: DataFrame, new_title: str = "New conversation") -> DataFrame:
    """Titles changed by ``renames`` (change_id, id, title, changed_at): per conversation
    the latest change wins, a blank title becomes ``new_title``, and the
    conversation is touched at the time of the change."""
    last = renames.groupBy("id").agg(F.max_by(F.struct("title", "changed_at"), "change_id").alias("_new"))
    title = F.trim(F.coalesce(F.col("_new.title"), F.lit("")))
    changed = F.col("_new").isNotNull()
    return (conversations.join(last, "id", "left")
            .withColumn("title", F.when(changed, F.when(title == "", F.lit(new_title)).otherwise(title)).otherwise(F.col("title")))
            .withColumn("updated_at", F.when(changed, F.col("_new.changed_at")).otherwise(F.col("updated_at").cast("timestamp_ntz")))
            .drop("_new"))


def apply_user_changes(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Role and last-login updates (``change_id, email, role, last_login``; a null
    field is left alone) as one batch.  Returns (new_users, rejects): a role
    outside VALID_ROLES or an unknown email is rejected with a reason, and the
    whole change with it.  Per field the latest valid change wins."""
    c = changes.withColumn("email", F.lower(F.trim("email")))
    bad = F.col("role").isNotNull() & ~F.col("role").isin(*VALID_ROLES)
    known = c.join(users.select("email").distinct(), "email", "left_semi")
    rejects = (c.filter(bad).select("change_id", "email", F.lit("invalid_role").alias("reason"))
               .unionByName(c.filter(~bad).join(users.select("email").distinct(), "email", "left_anti")
                            .select("change_id", "email", F.lit("unknown_email").alias("reason"))))
    latest = known.filter(~bad).groupBy("email").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("change_id"))).alias(f"_{f}") for f in ("role", "last_login")])
    out = users.join(latest, "email", "left")
    for f in ("role", "last_login"):
        out = out.withColumn(f, F.coalesce(f"_{f}", f)).drop(f"_{f}")
    return out.select(*users.columns), rejects


def append_messages(messages: DataFrame, conversations: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``new`` messages (seq, conversation_id, role, content, the five payload
    arrays, created_at) added to the table: ids go on from the largest one in
    ``seq`` order, the payload is encoded, messages of unknown conversations
    are dropped, and the conversations are touched.  Returns
    (new_messages, new_conversations).

    Ids need one order over the batch; ``seq`` must be unique."""
    top = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]  # one number
    kept = new.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    rows = (global_rank(kept, ["seq"], name="_n").withColumn("id", F.col("_n") + F.lit(top))
            .withColumn("payload_json", encode_payload(kept)).select(*messages.columns))
    return messages.unionByName(rows), touch_from_messages(conversations, rows)


# -- F14 ----------------------------------------------------------------------------------------
def email_rule(email: Column) -> Column:
    """NULL when acceptable, else 'invalid' or 'blocked_domain'."""
    e = F.lower(F.trim(email))
    domain = F.element_at(F.split(e, "@"), -1)
    bad_shape = ~e.contains("@") | ~domain.contains(".")
    return (F.when(bad_shape, F.lit("invalid"))
            .when(domain.isin(*BLOCKED_EMAIL_DOMAINS), F.lit("blocked_domain")))


def email_domain(email: Column) -> Column:
    return F.element_at(F.split(F.lower(F.trim(email)), "@"), -1)
