"""Query shapes that the reference passes straight to its SQL engine
(J8, J9, A12, W4, L7, F15).  Each runs as user SQL *through the guard*,
proving the surface; the oracle text is DuckDB's spelling of the same query.

Where Spark and DuckDB spell a query identically one string serves both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.operators import joins as J
from hostlens.plans.common import guarded, oracle, session
from hostlens.plans.registry import query
from hostlens.sources.tables import read_table

# key -> (spark sql, duckdb sql or None when identical, views)
SHAPES: dict[str, tuple[str, str | None, tuple[str, ...]]] = {}


def shape(key: str, spark_sql: str, views: tuple[str, ...], duck_sql: str | None = None) -> None:
    SHAPES[key] = (spark_sql, duck_sql, views)

    def run(spark, sf_dir, _sql=spark_sql):
        return guarded(spark, sf_dir, _sql, land="host" in views)

    run.__name__ = key
    query(key, oracle(duck_sql or spark_sql, *views))(run)


# -- J8: joins -------------------------------------------------------------------
shape("join_inner", """
SELECT t.FAMILY_NAME, t.GENUS_NAME, COUNT(*) AS n_obs
FROM host h JOIN taxonomy t ON h.tax_id = t.tax_id
WHERE h.DISEASE_STATUS = 'R'
GROUP BY t.FAMILY_NAME, t.GENUS_NAME
""", ("host", "taxonomy"))

shape("join_left", """
SELECT t.tax_id, t.ORGANISM_NAME, c.n_obs
FROM taxonomy t
LEFT JOIN (SELECT tax_id, COUNT(*) AS n_obs FROM host
           WHERE COUNTRY = 'NATION_1' GROUP BY tax_id) c
  ON t.tax_id = c.tax_id
""", ("host", "taxonomy"))

shape("join_full", """
SELECT COALESCE(a.COUNTRY, b.COUNTRY) AS country, a.n AS n_brand1, b.n AS n_brand2
FROM (SELECT COUNTRY, COUNT(*) AS n FROM host
      WHERE VIRUS_FAMILY = 'Brand#1' AND DISEASE_STATUS = 'A' AND HOST_COUNT > 45
      GROUP BY COUNTRY) a
FULL OUTER JOIN
     (SELECT COUNTRY, COUNT(*) AS n FROM host
      WHERE VIRUS_FAMILY = 'Brand#2' AND DISEASE_STATUS = 'N' AND HOST_COUNT > 45
      GROUP BY COUNTRY) b
  ON a.COUNTRY = b.COUNTRY
""", ("host",))

shape("join_semi", """
SELECT t.tax_id, t.ORGANISM_NAME
FROM taxonomy t LEFT SEMI JOIN
     (SELECT tax_id FROM host WHERE COUNTRY = 'NATION_2' AND DISEASE_STATUS = 'R') h
  ON t.tax_id = h.tax_id
""", ("host", "taxonomy"), """
SELECT t.tax_id, t.ORGANISM_NAME
FROM taxonomy t
WHERE EXISTS (SELECT 1 FROM host h WHERE h.tax_id = t.tax_id
              AND h.COUNTRY = 'NATION_2' AND h.DISEASE_STATUS = 'R')
""")

shape("join_anti", """
SELECT t.tax_id, t.ORGANISM_NAME
FROM taxonomy t LEFT ANTI JOIN
     (SELECT tax_id FROM host WHERE DISEASE_STATUS = 'R' AND COUNTRY = 'NATION_3') h
  ON t.tax_id = h.tax_id
""", ("host", "taxonomy"), """
SELECT t.tax_id, t.ORGANISM_NAME
FROM taxonomy t
WHERE NOT EXISTS (SELECT 1 FROM host h WHERE h.tax_id = t.tax_id AND h.DISEASE_STATUS = 'R'
                  AND h.COUNTRY = 'NATION_3')
""")

# theta join: taxa against price bands derived from nation (fixed 25 rows,
# broadcast nested-loop over a bounded side)
shape("join_theta", """
SELECT t.tax_id, b.band
FROM taxonomy t
JOIN (SELECT n_nationkey AS band, 900 + n_nationkey * 50 AS lo, 949 + n_nationkey * 50 AS hi
      FROM nation) b
  ON t.GENOME_SIZE >= b.lo AND t.GENOME_SIZE <= b.hi
""", ("taxonomy",))

# -- J9: subqueries ----------------------------------------------------------------
shape("subquery_scalar", """
SELECT VIRUS_GENUS, COUNT(*) AS n
FROM host
GROUP BY VIRUS_GENUS
HAVING COUNT(*) * 6 > (SELECT COUNT(*) FROM host)
""", ("host",))

shape("subquery_in", """
SELECT tax_id, ORGANISM_NAME
FROM taxonomy
WHERE tax_id IN (SELECT tax_id FROM host WHERE COUNTRY = 'NATION_5' AND DISEASE_STATUS = 'A')
""", ("host", "taxonomy"))

shape("subquery_exists", """
SELECT u.email, u.role
FROM users u
WHERE EXISTS (SELECT 1 FROM conv_list c
              WHERE c.user_email = u.email AND c.created_at >= TIMESTAMP '1998-06-01 00:00:00')
""", ("users", "conv_list"))

shape("subquery_derived", """
SELECT g AS VIRUS_GENUS, ROUND(AVG(n), 4) AS avg_per_country, MAX(n) AS max_per_country
FROM (SELECT VIRUS_GENUS AS g, COUNTRY, COUNT(*) AS n FROM host GROUP BY VIRUS_GENUS, COUNTRY) d
GROUP BY g
""", ("host",))

# -- A12: aggregation shapes ---------------------------------------------------------
shape("agg_grouping_sets", """
SELECT DISEASE_STATUS, VIRUS_GENUS, COUNT(*) AS n, ROUND(SUM(HOST_COUNT), 2) AS qty
FROM host
GROUP BY GROUPING SETS ((DISEASE_STATUS, VIRUS_GENUS), (DISEASE_STATUS), ())
""", ("host",))

shape("agg_rollup", """
SELECT VIRUS_FAMILY, DISEASE_STATUS, COUNT(*) AS n, CAST(GROUPING(DISEASE_STATUS) AS BIGINT) AS g_status
FROM host
GROUP BY ROLLUP (VIRUS_FAMILY, DISEASE_STATUS)
""", ("host",))

shape("agg_cube", """
SELECT DISEASE_STATUS, VIRUS_GENUS, COUNT(*) AS n
FROM host
GROUP BY CUBE (DISEASE_STATUS, VIRUS_GENUS)
""", ("host",))

shape("agg_distinct", """
SELECT VIRUS_FAMILY, COUNT(DISTINCT HOST_TAX_NAME) AS n_hosts, COUNT(DISTINCT COUNTRY) AS n_countries
FROM host
GROUP BY VIRUS_FAMILY
""", ("host",))

shape("agg_filter_having", """
SELECT VIRUS_GENUS, COUNT(*) AS n,
       COUNT(*) FILTER (WHERE DISEASE_STATUS = 'R') AS n_r
FROM host
GROUP BY VIRUS_GENUS
HAVING COUNT(*) > 100
""", ("host",))

shape("agg_stats", """
SELECT DISEASE_STATUS,
       ROUND(AVG(SCORE), 4) AS mean_score,
       ROUND(STDDEV_SAMP(SCORE), 4) AS sd_score,
       ROUND(VAR_SAMP(HOST_COUNT), 4) AS var_count,
       MIN(SCORE) AS min_score, MAX(SCORE) AS max_score
FROM host
GROUP BY DISEASE_STATUS
""", ("host",))

shape("agg_listagg", """
SELECT VIRUS_GENUS, listagg(DISTINCT DISEASE_STATUS, ',') WITHIN GROUP (ORDER BY DISEASE_STATUS) AS statuses
FROM host
GROUP BY VIRUS_GENUS
""", ("host",), """
SELECT VIRUS_GENUS, string_agg(DISTINCT DISEASE_STATUS, ',' ORDER BY DISEASE_STATUS) AS statuses
FROM host
GROUP BY VIRUS_GENUS
""")

# -- W4: windows (partitions are bounded: aggregated rows or one observation) ----------
shape("win_rank", """
SELECT VIRUS_GENUS, COUNTRY, n,
       CAST(RANK() OVER (PARTITION BY VIRUS_GENUS ORDER BY n DESC) AS BIGINT) AS rnk,
       CAST(DENSE_RANK() OVER (PARTITION BY VIRUS_GENUS ORDER BY n DESC) AS BIGINT) AS drnk
FROM (SELECT VIRUS_GENUS, COUNTRY, COUNT(*) AS n FROM host GROUP BY VIRUS_GENUS, COUNTRY) c
""", ("host",))

shape("win_lag_lead", """
SELECT obs_order, obs_line, tax_id, host_id, SCORE,
       LAG(SCORE) OVER (PARTITION BY obs_order ORDER BY obs_line, tax_id, host_id) AS prev_score,
       LEAD(SCORE, 1) OVER (PARTITION BY obs_order ORDER BY obs_line, tax_id, host_id) AS next_score,
       FIRST_VALUE(SCORE) OVER (PARTITION BY obs_order ORDER BY obs_line, tax_id, host_id) AS first_score
FROM host
""", ("host",))

shape("win_running_sum", """
SELECT d, n, CAST(SUM(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_n
FROM (SELECT CAST(CAST(COLLECTION_DATE AS DATE) AS STRING) AS d, COUNT(*) AS n FROM host
      GROUP BY CAST(CAST(COLLECTION_DATE AS DATE) AS STRING)) x
""", ("host",))

shape("win_range_frame", """
SELECT VIRUS_GENUS, yr, n,
       CAST(SUM(n) OVER (PARTITION BY VIRUS_GENUS ORDER BY yr RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_3yr
FROM (SELECT VIRUS_GENUS, CAST(year(COLLECTION_DATE) AS BIGINT) AS yr, COUNT(*) AS n FROM host
      GROUP BY VIRUS_GENUS, year(COLLECTION_DATE)) x
""", ("host",))

shape("win_ntile", """
SELECT VIRUS_GENUS, COUNTRY, n,
       CAST(NTILE(4) OVER (PARTITION BY VIRUS_GENUS ORDER BY n DESC, COUNTRY) AS BIGINT) AS quartile
FROM (SELECT VIRUS_GENUS, COUNTRY, COUNT(*) AS n FROM host
      WHERE VIRUS_GENUS IS NOT NULL AND COUNTRY IS NOT NULL GROUP BY VIRUS_GENUS, COUNTRY) c
""", ("host",))

# -- L7: set operations --------------------------------------------------------------
_FAM = "(SELECT {c} FROM host WHERE VIRUS_FAMILY = '{f}' AND DISEASE_STATUS = '{s}')"
shape("set_union", "SELECT HOST_TAX_NAME FROM host WHERE VIRUS_FAMILY = 'Brand#1' AND DISEASE_STATUS = 'R' "
      "UNION SELECT HOST_TAX_NAME FROM host WHERE VIRUS_FAMILY = 'Brand#2' AND DISEASE_STATUS = 'A'",
      ("host",))
shape("set_union_all", "SELECT VIRUS_SPECIES FROM host WHERE VIRUS_FAMILY = 'Brand#1' AND HOST_COUNT > 48 "
      "UNION ALL SELECT VIRUS_SPECIES FROM host WHERE VIRUS_FAMILY = 'Brand#2' AND HOST_COUNT > 48",
      ("host",))
shape("set_intersect", "SELECT HOST_TAX_NAME FROM host WHERE VIRUS_FAMILY = 'Brand#1' "
      "INTERSECT SELECT HOST_TAX_NAME FROM host WHERE VIRUS_FAMILY = 'Brand#2' AND DISEASE_STATUS = 'R'",
      ("host",))
shape("set_except", "SELECT VIRUS_SPECIES, VIRUS_FAMILY FROM host WHERE COUNTRY = 'NATION_1' "
      "EXCEPT SELECT VIRUS_SPECIES, VIRUS_FAMILY FROM host WHERE COUNTRY = 'NATION_2'",
      ("host",))

# -- F15: scalar function families ---------------------------------------------------------
shape("fn_string", """
SELECT tax_id,
       lower(ORGANISM_NAME) AS lo, upper(ORGANISM_NAME) AS up, trim(concat('  ', GENUS_NAME, ' ')) AS tr,
       CAST(length(ORGANISM_NAME) AS BIGINT) AS len, substring(ORGANISM_NAME, 2, 4) AS sub,
       replace(ORGANISM_NAME, ' ', '_') AS rep, concat(GENUS_NAME, '/', ORGANISM_NAME) AS cat,
       lpad(CAST(GENOME_COUNT AS STRING), 4, '0') AS pad, split_part(ORGANISM_NAME, ' ', 2) AS part2,
       CAST(instr(ORGANISM_NAME, 'e') AS BIGINT) AS pos_e, reverse(GENUS_NAME) AS rev, initcap(ORGANISM_NAME) AS cap,
       regexp_replace(ORGANISM_NAME, '[aeiou]', '*') AS masked,
       regexp_extract(ORGANISM_NAME, '([a-z]+) ([a-z]+)', 2) AS second_word,
       ORGANISM_NAME LIKE '%ring' AS is_ring, ORGANISM_NAME ILIKE 'RED%' AS is_red
FROM taxonomy
""", ("taxonomy",), """
SELECT tax_id,
       lower(ORGANISM_NAME) AS lo, upper(ORGANISM_NAME) AS up, trim(concat('  ', GENUS_NAME, ' ')) AS tr,
       CAST(length(ORGANISM_NAME) AS BIGINT) AS len, substring(ORGANISM_NAME, 2, 4) AS sub,
       replace(ORGANISM_NAME, ' ', '_') AS rep, concat(GENUS_NAME, '/', ORGANISM_NAME) AS cat,
       lpad(CAST(GENOME_COUNT AS VARCHAR), 4, '0') AS pad, split_part(ORGANISM_NAME, ' ', 2) AS part2,
       CAST(instr(ORGANISM_NAME, 'e') AS BIGINT) AS pos_e, reverse(GENUS_NAME) AS rev,
       array_to_string(list_transform(string_split(ORGANISM_NAME, ' '),
           lambda x: concat(upper(substring(x, 1, 1)), lower(substring(x, 2)))), ' ') AS cap,
       regexp_replace(ORGANISM_NAME, '[aeiou]', '*', 'g') AS masked,
       regexp_extract(ORGANISM_NAME, '([a-z]+) ([a-z]+)', 2) AS second_word,
       ORGANISM_NAME LIKE '%ring' AS is_ring, ORGANISM_NAME ILIKE 'RED%' AS is_red
FROM taxonomy
""")

shape("fn_date", """
SELECT id,
       CAST(year(created_at) AS BIGINT) AS y, CAST(month(created_at) AS BIGINT) AS m, CAST(day(created_at) AS BIGINT) AS d,
       CAST(CAST(date_trunc('MONTH', created_at) AS DATE) AS STRING) AS month_start,
       CAST(datediff(CAST(created_at AS DATE), DATE '1995-01-01') AS BIGINT) AS days_since,
       CAST(date_add(CAST(created_at AS DATE), 30) AS STRING) AS plus30,
       date_format(created_at, 'yyyy-MM') AS ym,
       CAST(created_at + INTERVAL 36 HOURS AS STRING) AS plus36h,
       CAST(to_timestamp(concat(CAST(CAST(created_at AS DATE) AS STRING), ' 12:30:00')) AS STRING) AS noon
FROM conv_list
""", ("conv_list",), """
SELECT id,
       CAST(year(created_at) AS BIGINT) AS y, CAST(month(created_at) AS BIGINT) AS m, CAST(day(created_at) AS BIGINT) AS d,
       CAST(CAST(date_trunc('month', created_at) AS DATE) AS VARCHAR) AS month_start,
       CAST(date_diff('day', DATE '1995-01-01', CAST(created_at AS DATE)) AS BIGINT) AS days_since,
       CAST(CAST(CAST(created_at AS DATE) + INTERVAL 30 DAY AS DATE) AS VARCHAR) AS plus30,
       strftime(created_at, '%Y-%m') AS ym,
       CAST(created_at + INTERVAL 36 HOUR AS VARCHAR) AS plus36h,
       CAST(strptime(concat(CAST(CAST(created_at AS DATE) AS VARCHAR), ' 12:30:00'), '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS noon
FROM conv_list
""")

shape("fn_math", """
SELECT obs_order, obs_line, tax_id, host_id,
       ROUND(SCORE / 7, 2) AS r, FLOOR(SCORE / 1000) AS f, CEIL(SCORE / 1000) AS c,
       ABS(HOST_COUNT - 25) AS a, ROUND(SQRT(SCORE), 6) AS sq, POWER(HOST_COUNT, 2) AS p2,
       MOD(CAST(HOST_COUNT AS BIGINT), 7) AS md, SIGN(HOST_COUNT - 25) AS sg,
       GREATEST(HOST_COUNT, 10) AS gr, LEAST(HOST_COUNT, 10) AS le, ROUND(LN(SCORE), 6) AS lnv
FROM host
""", ("host",), """
SELECT obs_order, obs_line, tax_id, host_id,
       ROUND(SCORE / 7, 2) AS r, CAST(FLOOR(SCORE / 1000) AS BIGINT) AS f, CAST(CEIL(SCORE / 1000) AS BIGINT) AS c,
       ABS(HOST_COUNT - 25) AS a, ROUND(SQRT(SCORE), 6) AS sq, POWER(HOST_COUNT, 2) AS p2,
       MOD(CAST(HOST_COUNT AS BIGINT), 7) AS md, CAST(SIGN(HOST_COUNT - 25) AS DOUBLE) AS sg,
       GREATEST(HOST_COUNT, 10) AS gr, LEAST(HOST_COUNT, 10) AS le, ROUND(LN(SCORE), 6) AS lnv
FROM host
""")

shape("fn_case", """
SELECT obs_order, obs_line, tax_id, host_id,
       CASE WHEN HOST_COUNT < 10 THEN 'low' WHEN HOST_COUNT < 40 THEN 'mid' ELSE 'high' END AS band,
       COALESCE(COUNTRY, VIRUS_GENUS, 'none') AS where_or_what,
       NULLIF(DISEASE_STATUS, 'N') AS status_or_null,
       DISEASE_STATUS IN ('A', 'R') AS is_ar,
       HOST_COUNT BETWEEN 10 AND 20 AS in_range,
       TRY_CAST(substring(primary_id, 5, 3) AS INT) AS id_prefix
FROM host
""", ("host",))

shape("fn_array", """
SELECT tax_id,
       CAST(size(split(ORGANISM_NAME, ' ')) AS BIGINT) AS n_words,
       element_at(split(ORGANISM_NAME, ' '), 1) AS first_word,
       array_contains(split(ORGANISM_NAME, ' '), 'ring') AS has_ring,
       array_join(array_sort(split(ORGANISM_NAME, ' ')), '|') AS sorted_words,
       array_join(slice(array(GENUS_NAME, ORGANISM_NAME, FAMILY_NAME), 1, 2), '|') AS first_two,
       array_join(transform(split(ORGANISM_NAME, ' '), w -> upper(w)), ' ') AS upper_words,
       CAST(size(filter(split(ORGANISM_NAME, ' '), w -> length(w) > 4)) AS BIGINT) AS n_long,
       CAST(aggregate(transform(split(ORGANISM_NAME, ' '), w -> length(w)), 0, (acc, x) -> acc + x) AS BIGINT) AS letters
FROM taxonomy
""", ("taxonomy",), """
SELECT tax_id,
       len(string_split(ORGANISM_NAME, ' ')) AS n_words,
       string_split(ORGANISM_NAME, ' ')[1] AS first_word,
       list_contains(string_split(ORGANISM_NAME, ' '), 'ring') AS has_ring,
       array_to_string(list_sort(string_split(ORGANISM_NAME, ' ')), '|') AS sorted_words,
       array_to_string(list_slice([GENUS_NAME, ORGANISM_NAME, FAMILY_NAME], 1, 2), '|') AS first_two,
       array_to_string(list_transform(string_split(ORGANISM_NAME, ' '), lambda w: upper(w)), ' ') AS upper_words,
       len(list_filter(string_split(ORGANISM_NAME, ' '), lambda w: length(w) > 4)) AS n_long,
       CAST(list_sum(list_transform(string_split(ORGANISM_NAME, ' '), lambda w: length(w))) AS BIGINT) AS letters
FROM taxonomy
""")

shape("fn_json", """
SELECT event_id,
       CAST(get_json_object(props, '$.k') AS BIGINT) AS k,
       from_json(props, 'k BIGINT').k AS k2,
       to_json(named_struct('id', event_id, 'type', event_type)) AS js
FROM events
""", (), """
SELECT event_id,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       CAST(json_extract(props, '$.k') AS BIGINT) AS k2,
       concat('{"id":', CAST(event_id AS VARCHAR), ',"type":"', event_type, '"}') AS js
FROM events
""")


# -- J1 / J8 as DataFrame operators ---------------------------------------------------------


@query("host_taxonomy_enrich", oracle("""
SELECT h.obs_order, h.obs_line, h.tax_id, h.host_id, t.GENUS_NAME, t.FAMILY_NAME, t.GENOME_SIZE
FROM host h LEFT JOIN taxonomy t ON h.tax_id = t.tax_id
""", "host", "taxonomy"))
def host_taxonomy_enrich(spark, sf_dir):
    s = session(spark, sf_dir)
    h = s.host.select("obs_order", "obs_line", "tax_id", "host_id")
    t = s.taxonomy.select("tax_id", "GENUS_NAME", "FAMILY_NAME", "GENOME_SIZE")
    return J.enrich(h, t, ["tax_id"], "left")


@query("join_asof", """
SELECT p.event_id, p.user_id, v.event_id AS r_event_id, CAST(v.ts AS VARCHAR) AS r_ts
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') v
  ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def join_asof(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    purchases = ev.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    views = ev.filter(F.col("event_type") == "view").select("event_id", "user_id", "ts")
    out = J.asof_join(purchases, views, ["user_id"], "ts", ["event_id"], ["event_id"],
                      bucket_seconds=6 * 3600)
    return out.select("event_id", "user_id", "r_event_id", F.col("r_ts").cast("string").alias("r_ts"))
