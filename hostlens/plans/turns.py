"""Per-turn jobs: sources fold, summary, call numbering, context window,
tolerant arguments, sanitising, search keyword, event rollup."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.functions import args as A
from hostlens.operators import turns as TU
from hostlens.plans.common import oracle, session
from hostlens.plans.registry import query
from hostlens.sources.tables import read_table

_SOURCES_ORACLE = """
WITH items AS (
  SELECT conv_id, turn, CASE type WHEN 'url' THEN 'wiki' WHEN 'pubmed' THEN 'pubmed' ELSE 'ncbi' END AS kind,
         CASE WHEN type = 'pubmed' THEN concat('https://pubmed.ncbi.nlm.nih.gov/', CAST(pmid AS VARCHAR), '/')
              ELSE url END AS item, round, ts, call_id, pos
  FROM artifacts WHERE success),
firsts AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, turn, kind, item ORDER BY round, ts, call_id, pos) AS rn
  FROM items)
SELECT conv_id, turn, kind, item,
       ROW_NUMBER() OVER (PARTITION BY conv_id, turn, kind ORDER BY round, ts, call_id, pos) AS rank
FROM (SELECT conv_id, turn, kind, item, round, ts, call_id, pos FROM firsts WHERE rn = 1
      UNION ALL
      SELECT conv_id, turn, 'code', CASE WHEN sql IS NOT NULL THEN concat('-- SQL (', tool, ')
', sql)
                                         ELSE code END, round, ts, call_id, 0
      FROM tool_calls WHERE success AND COALESCE(sql, code) IS NOT NULL) u
"""


@query("turn_sources", oracle(_SOURCES_ORACLE, "artifacts"))
def turn_sources(spark, sf_dir):
    session(spark, sf_dir, land=False)
    return TU.turn_sources(spark.table("artifacts"), spark.table("tool_calls"))


@query("turn_summary", oracle("""
SELECT conv_id, turn, COUNT(*) AS calls_used, COUNT(*) FILTER (WHERE success) AS ok_calls,
       COUNT(*) FILTER (WHERE NOT success) AS failed_calls,
       COUNT(*) FILTER (WHERE success AND tool = 'create_map') AS figures,
       COUNT(*) FILTER (WHERE success AND tool = 'query_host_sql') AS snippets
FROM tool_calls GROUP BY conv_id, turn
""", "tool_calls"))
def turn_summary(spark, sf_dir):
    session(spark, sf_dir, land=False)
    return TU.turn_summary(spark.table("tool_calls"))


@query("tool_call_numbering", oracle("""
WITH per_round AS (SELECT conv_id, turn, round, COUNT(*) AS n FROM tool_calls GROUP BY conv_id, turn, round),
before AS (SELECT conv_id, turn, round,
                  CAST(COALESCE(SUM(n) OVER (PARTITION BY conv_id, turn ORDER BY round
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before
           FROM per_round)
SELECT c.call_id, c.conv_id, c.turn, c.round,
       ROW_NUMBER() OVER (PARTITION BY c.conv_id, c.turn ORDER BY c.round, c.ts, c.call_id) AS call_no,
       b.used_before, b.used_before >= 7 AS over_budget
FROM tool_calls c JOIN before b ON c.conv_id = b.conv_id AND c.turn = b.turn AND c.round = b.round
""", "tool_calls"))
def tool_call_numbering(spark, sf_dir):
    session(spark, sf_dir, land=False)
    calls = spark.table("tool_calls").select("call_id", "conv_id", "turn", "round", "ts")
    out = TU.call_numbering(calls, TU.DEFAULT_MAX_TOOL_CALLS)
    return out.select("call_id", "conv_id", "turn", "round", "call_no",
                      F.col("used_before").cast("bigint").alias("used_before"), "over_budget")


@query("context_window", """
SELECT conv_id, turn, role FROM (
  SELECT conv_id, turn, role, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
  FROM conversations WHERE role IN ('user', 'assistant')) x
WHERE rn <= 4
""")
def context_window(spark, sf_dir):
    msgs = read_table(spark, sf_dir, "conversations")
    return TU.context_window(msgs, max_turns=2).select("conv_id", "turn", "role")


@query("context_window_all", """
SELECT conv_id, turn, role, text AS content FROM conversations WHERE role IN ('user', 'assistant')
""")
def context_window_all(spark, sf_dir):
    msgs = read_table(spark, sf_dir, "conversations")
    return TU.context_window(msgs, max_turns=0).select("conv_id", "turn", "role",
                                                        F.col("text").alias("content"))


@query("turn_rollup", """
SELECT user_id, CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, COUNT(*) AS n_events,
       COUNT(*) FILTER (WHERE event_type <> 'error') AS n_ok,
       COUNT(*) FILTER (WHERE event_type = 'error') AS n_failed
FROM (SELECT DISTINCT ON (event_id) * FROM events) e
GROUP BY user_id, date_trunc('day', ts)
""")
def turn_rollup(spark, sf_dir):
    return TU.turn_rollup(read_table(spark, sf_dir, "events"), "1 day")


# -- F6 / F7 / F8 ------------------------------------------------------------------------
# Raw argument texts shaped from each call: valid, cut, duplicated keys,
# garbage, long strings, non-string values.
CALL_ARGS_SQL = """
SELECT call_id, tool,
  CASE call_id % 6
    WHEN 0 THEN raw_args
    WHEN 1 THEN substring(raw_args, 1, length(raw_args) - 1)
    WHEN 2 THEN concat('{"search_term": "', tool, ' ', CAST(k AS STRING), '", "k": ', CAST(k AS STRING),
                       ', "k": ', CAST(k + 1 AS STRING))
    WHEN 3 THEN concat('garbage ', tool)
    WHEN 4 THEN concat('{"query": "', repeat(concat(tool, '  '), 6), '", "name": "x"}')
    ELSE concat('{"name": ', CAST(k AS STRING), ', "query": "   "}')
  END AS raw
FROM tool_calls
"""

_P = A.PAIR_PATTERN
_PARSED_ORACLE = f"""
WITH ca AS ({CALL_ARGS_SQL}),
valid AS (SELECT call_id, tool, raw, unnest(json_keys(raw)) AS key FROM ca WHERE json_valid(raw)),
v1 AS (SELECT call_id, tool, key, json_extract_string(raw, concat('$."', key, '"')) AS value,
              json_type(raw, concat('$."', key, '"')) = 'VARCHAR' AS is_str FROM valid),
broken AS (SELECT call_id, tool, raw, regexp_extract_all(raw, '{_P}', 1) AS ks,
                  regexp_extract_all(raw, '{_P}', 2) AS vs FROM ca WHERE NOT json_valid(raw)),
b1 AS (SELECT call_id, tool, unnest(ks) AS key, unnest(vs) AS lit, unnest(range(len(ks))) AS i
       FROM broken WHERE len(ks) > 0),
b2 AS (SELECT call_id, tool, key,
              CASE WHEN lit = 'null' THEN NULL WHEN lit LIKE '"%' THEN substring(lit, 2, length(lit) - 2)
                   ELSE lit END AS value, lit LIKE '"%' AS is_str,
              ROW_NUMBER() OVER (PARTITION BY call_id, key ORDER BY i DESC) AS rn FROM b1),
parsed AS (
  SELECT call_id, tool, key, value, is_str FROM v1
  UNION ALL SELECT call_id, tool, key, value, is_str FROM b2 WHERE rn = 1
  UNION ALL SELECT call_id, tool, '_raw', raw, TRUE FROM broken WHERE len(ks) = 0)
"""


def _parsed(spark, sf_dir):
    session(spark, sf_dir, land=False)
    ca = spark.sql(CALL_ARGS_SQL)
    return A.with_parsed_args(ca, "raw").select("call_id", "tool", "args")


def _entries(df, args):
    """(call_id, key, lit) per member of ``args``.  For a plain explode the
    optimizer would test size(args) in a pushed-down filter and so parse
    every text again, several times over."""
    return df.select("call_id", F.explode_outer(args).alias("key", "lit")).filter(F.col("key").isNotNull())


@query("tolerant_json", oracle(_PARSED_ORACLE + "SELECT call_id, key, value FROM parsed", "tool_calls"))
def tolerant_json(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return _entries(p, F.col("args")) \
        .select("call_id", "key", A.arg_text(F.col("lit")).alias("value"))


# Tool parameter schemas: fixed values that must equal the reference's tools.
TOOL_SCHEMAS = [
    ("wikipedia_search", ["search_term", "wikipedia_limit"], ["search_term"]),
    ("pubmed_search", ["query", "max_results"], ["query"]),
    ("ncbi_taxonomy_search", ["name"], ["name"]),
    ("query_host_sql", ["sql", "preview_rows"], ["sql"]),
    ("query_dataframe", ["code", "preview_rows"], ["code"]),
    ("create_visualization", ["code"], ["code"]),
    ("create_map", ["code"], ["code"]),
]
SERVER_DEFAULTS = {"preview_rows": "50", "wikipedia_limit": "4000"}


def tool_schema_frame(spark):
    return spark.createDataFrame(TOOL_SCHEMAS, "tool STRING, properties ARRAY<STRING>, required ARRAY<STRING>")


_SCHEMA_VALUES = ", ".join(
    f"('{t}', [{', '.join(repr(p) for p in props)}], {len(req)}, '{req[0]}')"
    for t, props, req in TOOL_SCHEMAS)

_SANITIZE_ORACLE = _PARSED_ORACLE + f""",
schemas AS (SELECT * FROM (VALUES {_SCHEMA_VALUES}) s(tool, props, n_req, req1)),
sizes AS (SELECT call_id, COUNT(*) AS n_keys, bool_and(key = '_raw') AS only_raw FROM parsed GROUP BY call_id),
renamed AS (
  SELECT p.call_id, p.tool, CASE WHEN z.only_raw AND s.n_req = 1 THEN s.req1 ELSE p.key END AS key, p.value
  FROM parsed p JOIN sizes z ON p.call_id = z.call_id JOIN schemas s ON p.tool = s.tool),
defaults AS (
  SELECT c.call_id, c.tool, d.key, d.value FROM (SELECT DISTINCT call_id, tool FROM parsed) c
  CROSS JOIN (VALUES ('preview_rows', '50'), ('wikipedia_limit', '4000')) d(key, value)
  JOIN schemas s ON c.tool = s.tool
  WHERE list_contains(s.props, d.key)
    AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.call_id = c.call_id AND r.key = d.key))
SELECT a.call_id, a.key, a.value FROM (SELECT * FROM renamed UNION ALL SELECT * FROM defaults) a
JOIN schemas s ON a.tool = s.tool
WHERE len(s.props) = 0 OR list_contains(s.props, a.key)
"""


@query("sanitize_args", oracle(_SANITIZE_ORACLE, "tool_calls"))
def sanitize_args(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    schemas = tool_schema_frame(spark)  # 7 fixed rows: broadcast
    defaults = F.create_map(*[x for k, v in SERVER_DEFAULTS.items() for x in (F.lit(k), F.lit(v))])
    j = p.join(F.broadcast(schemas), "tool", "left")
    props = F.coalesce(F.col("properties"), F.array().cast("array<string>"))
    req = F.coalesce(F.col("required"), F.array().cast("array<string>"))
    clean = A.sanitize_args(F.col("args"), props, req, defaults)
    return _entries(j, clean) \
        .select("call_id", "key", A.arg_text(F.col("lit")).alias("value"))


_KEYWORD_ORACLE = _PARSED_ORACLE + """,
cand AS (
  SELECT call_id, regexp_replace(regexp_replace(value, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS txt,
         CASE key WHEN 'search_term' THEN 1 WHEN 'query' THEN 2 ELSE 3 END AS prio
  FROM parsed WHERE key IN ('search_term', 'query', 'name') AND is_str),
best AS (SELECT call_id, arg_min(txt, prio) AS txt FROM cand WHERE txt <> '' GROUP BY call_id)
SELECT c.call_id,
       COALESCE(CASE WHEN length(b.txt) > 80 THEN concat(substring(b.txt, 1, 80), '…') ELSE b.txt END, '')
         AS keyword
FROM (SELECT DISTINCT call_id FROM parsed) c LEFT JOIN best b ON c.call_id = b.call_id
""".replace("\\\\", "\\")


@query("search_keyword", oracle(_KEYWORD_ORACLE, "tool_calls"))
def search_keyword(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return p.select("call_id", A.search_keyword(F.col("args")).alias("keyword"))
