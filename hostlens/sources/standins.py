"""Domain views over the driver's test tables.

The reference works on an observation table ``host``, a taxonomy table and a
small account store (users, conversations, messages, error reports), plus
per-turn tool calls.  The test data is a TPC-H-like star schema, so each
domain view is defined here as a projection/join of those tables.

The definitions are written in the SQL subset that both Spark SQL and DuckDB
accept, so the very same text builds the Spark view and the oracle's CTE.
Spark-only additions (the WKB ``geometry`` column, artifact arrays) are
built from these views in ``tables.py``.

NULLs do not occur in the test data; ``NULLIF``/``CASE`` introduce them on
fixed values so that the NULL semantics of each operator are exercised.
"""

from __future__ import annotations

# -- host: one row per observation -----------------------------------------
# lineitem ⋈ part ⋈ supplier ⋈ nation.  nation is fixed-size (25 rows) and
# is broadcast; part and supplier grow with the data and are left to the
# size-checked planner (autoBroadcastJoinThreshold / AQE).
HOST_SQL = """
SELECT /*+ BROADCAST(n) */
       l.l_orderkey AS obs_order,
       l.l_linenumber AS obs_line,
       p.p_partkey AS tax_id,
       l.l_suppkey AS host_id,
       p.p_brand AS VIRUS_FAMILY,
       NULLIF(p.p_type, 'PROMO') AS VIRUS_GENUS,
       p.p_name AS VIRUS_SPECIES,
       s.s_name AS HOST_TAX_NAME,
       NULLIF(n.n_name, 'NATION_13') AS COUNTRY,
       l.l_returnflag AS DISEASE_STATUS,
       l.l_quantity AS HOST_COUNT,
       l.l_extendedprice AS SCORE,
       l.l_shipdate AS COLLECTION_DATE,
       CASE WHEN l.l_linestatus = 'O' THEN NULL
            ELSE concat('SAMN', CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING))
       END AS primary_id,
       CASE WHEN l.l_linestatus = 'O' AND l.l_linenumber = 7 THEN NULL
            ELSE concat('GB', CAST(l.l_partkey AS STRING), '.', CAST(l.l_linenumber AS STRING))
       END AS secondary_id,
       CASE WHEN l.l_linenumber = 4 THEN NULL
            ELSE ((l.l_partkey * 37 + l.l_suppkey * 11) % 3600) / 1e1 - 18e1 + l.l_discount
       END AS lon_src,
       CASE WHEN l.l_linenumber = 4 THEN NULL
            ELSE ((l.l_orderkey * 13 + l.l_linenumber * 7) % 1780) / 1e1 - 89e0 + l.l_tax
       END AS lat_src
FROM lineitem l
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
"""

# -- taxonomy: one row per taxon (part) --------------------------------------
TAXONOMY_SQL = """
SELECT p_partkey AS tax_id,
       p_name AS ORGANISM_NAME,
       CASE WHEN p_size > 45 THEN concat(p_name, ' ', p_type) ELSE NULL END AS SPECIES_NAME,
       NULLIF(p_brand, 'Brand#25') AS FAMILY_NAME,
       p_type AS GENUS_NAME,
       p_size AS GENOME_COUNT,
       p_retailprice AS GENOME_SIZE
FROM part
"""

# -- account store -----------------------------------------------------------
USERS_SQL = """
SELECT concat('user', CAST(c_custkey AS STRING), '@example.org') AS email,
       split_part(c_name, '#', 1) AS first_name,
       concat('N', split_part(c_name, '#', 2)) AS last_name,
       CASE WHEN c_acctbal >= 9000 THEN 'admin'
            WHEN c_acctbal >= 7000 THEN 'dev' ELSE 'user' END AS role,
       CAST(DATE '2000-01-01' + CAST(c_custkey % 7000 AS INTEGER) AS STRING) AS created_at,
       CASE WHEN c_nationkey = 3 THEN NULL
            ELSE CAST(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS STRING) END AS last_login,
       c_custkey AS user_key
FROM customer
"""

CONV_LIST_SQL = """
SELECT o_orderkey AS id,
       concat('user', CAST(o_custkey AS STRING), '@example.org') AS user_email,
       concat(o_orderpriority, ' #', CAST(o_orderkey AS STRING)) AS title,
       o_orderdate AS created_at,
       o_orderdate AS updated_at
FROM orders
"""

MESSAGES_SQL = """
SELECT conv_id * 100 + turn AS id,
       conv_id AS conversation_id,
       turn,
       role,
       text AS content,
       CASE WHEN role = 'assistant' THEN
            concat('{"figures": [], "pubmed_urls": ["https://pubmed.ncbi.nlm.nih.gov/',
                   CAST(conv_id * 10 + turn AS STRING), '/"], "executed_codes": ["SELECT ',
                   CAST(turn AS STRING), '"]}')
            ELSE NULL END AS payload_json,
       TIMESTAMP '2024-01-01 00:00:00' + CAST(turn AS INTEGER) * INTERVAL 1 MINUTE AS created_at
FROM conversations
"""

REPORTS_SQL = """
SELECT o_orderkey AS id,
       CASE WHEN o_custkey % 17 = 0 THEN NULL
            ELSE concat('user', CAST(o_custkey AS STRING), '@example.org') END AS user_email,
       concat('question ', CAST(o_orderkey AS STRING)) AS question,
       concat('answer ', o_orderpriority) AS answer,
       concat('["SELECT ', CAST(o_custkey AS STRING), '", "df.head()"]') AS executed_codes,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
            ELSE concat('["log ', CAST(o_orderkey AS STRING), '"]') END AS recent_logs,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'done' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('seen: ', o_orderpriority) END AS comment,
       o_orderdate AS created_at,
       o_orderdate + CAST(o_orderkey % 9 AS INTEGER) * INTERVAL 1 DAY AS updated_at
FROM orders
"""

# -- tool calls: one row per call (events) -----------------------------------
# conversation = user, turn = ISO week, round = day of month; within a round
# calls are ordered by (ts, event_id).  k is the number inside props.
TOOL_CALLS_SQL = """
SELECT event_id AS call_id,
       user_id AS conv_id,
       CAST(weekofyear(ts) AS BIGINT) AS turn,
       CAST(dayofmonth(ts) AS BIGINT) AS round,
       ts,
       CASE event_type WHEN 'view' THEN 'wikipedia_search'
                       WHEN 'purchase' THEN 'pubmed_search'
                       WHEN 'click' THEN 'ncbi_taxonomy_search'
                       WHEN 'signup' THEN 'query_host_sql'
                       ELSE 'create_map' END AS tool,
       props AS raw_args,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
       event_type <> 'error' AND value < 18 AS success,
       value,
       CASE WHEN event_type = 'signup'
            THEN concat('SELECT VIRUS_GENUS FROM host WHERE tax_id = ', CAST(regexp_extract(props, '[0-9]+', 0) AS STRING))
       END AS sql,
       CASE WHEN event_type = 'error'
            THEN concat('fig = px.scatter_mapbox(df_host, size=', CAST(regexp_extract(props, '[0-9]+', 0) AS STRING), ')')
       END AS code
FROM events
"""

# Artifacts of each call as flat rows (pos = position within the call).
ARTIFACTS_SQL = """
SELECT call_id, conv_id, turn, round, ts, success, 0 AS pos, 'url' AS type,
       concat('https://en.wikipedia.org/wiki/Topic_', CAST(k AS STRING)) AS url, NULL AS pmid
FROM tool_calls WHERE tool = 'wikipedia_search'
UNION ALL
SELECT call_id, conv_id, turn, round, ts, success, 0 AS pos, 'pubmed' AS type, NULL AS url,
       CAST(k * 1000 + 1 AS BIGINT) AS pmid
FROM tool_calls WHERE tool = 'pubmed_search'
UNION ALL
SELECT call_id, conv_id, turn, round, ts, success, 1 AS pos, 'pubmed' AS type, NULL AS url,
       CAST((k % 10) * 1000 + 2 AS BIGINT) AS pmid
FROM tool_calls WHERE tool = 'pubmed_search'
UNION ALL
SELECT call_id, conv_id, turn, round, ts, success, 0 AS pos, 'ncbi_taxonomy' AS type,
       concat('https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=', CAST(k AS STRING)) AS url,
       NULL AS pmid
FROM tool_calls WHERE tool = 'ncbi_taxonomy_search'
"""

# view name -> defining SQL, in dependency order
STANDIN_VIEWS: dict[str, str] = {
    "host_src": HOST_SQL,
    "taxonomy": TAXONOMY_SQL,
    "users": USERS_SQL,
    "conv_list": CONV_LIST_SQL,
    "messages": MESSAGES_SQL,
    "reports": REPORTS_SQL,
    "tool_calls": TOOL_CALLS_SQL,
    "artifacts": ARTIFACTS_SQL,
}

# The oracle's host has numeric lon/lat where Spark's has WKB geometry.
ORACLE_HOST_SQL = "SELECT * FROM host_src"


def oracle_with(*names: str) -> str:
    """``WITH`` clause defining the named domain views for the DuckDB oracle."""
    order = list(STANDIN_VIEWS)
    needed: set[str] = set()
    deps = {"artifacts": ["tool_calls"], "host": ["host_src"]}

    def add(n: str) -> None:
        if n in needed:
            return
        needed.add(n)
        for d in deps.get(n, []):
            add(d)

    for n in names:
        add(n)
    parts = []
    for n in order:
        if n in needed:
            parts.append(f"{n} AS ({STANDIN_VIEWS[n]})")
    if "host" in needed:
        parts.append(f"host AS ({ORACLE_HOST_SQL})")
    return "WITH " + ",\n".join(parts) + "\n"
