"""Guarded SQL, filters, frames, aggregations, limits (G, P, A, L, M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators import frames, guard
from hostlens.operators import member_sketches as MS
from hostlens.plans.common import guarded, oracle, session
from hostlens.plans.registry import query
from hostlens.sources.tables import fingerprint, landed

# -- G1 + A1 + P2: the flagship ---------------------------------------------
GROUP_COUNT_SQL = """
SELECT VIRUS_GENUS, COUNT(*) AS n
FROM host
WHERE VIRUS_FAMILY ILIKE '%brand#1%'
GROUP BY VIRUS_GENUS
"""


@query("guarded_group_count", oracle(GROUP_COUNT_SQL, "host"))
def guarded_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(spark, sf_dir, GROUP_COUNT_SQL)


# -- S2 + P1: explicit projection --------------------------------------------
PROJECTION_SQL = """
SELECT VIRUS_SPECIES, HOST_TAX_NAME, COUNTRY, DISEASE_STATUS
FROM host
WHERE VIRUS_FAMILY ILIKE '%brand#2%'
"""


@query("host_scan_projection", oracle(PROJECTION_SQL, "host"))
def host_scan_projection(spark, sf_dir):
    return guarded(spark, sf_dir, PROJECTION_SQL)


# -- G2: statement audit over a log of statements ------------------------------
# One logged statement per tool call, shaped by tool so that every rule fires.
STATEMENTS_SQL = """
SELECT call_id,
       CASE tool
         WHEN 'wikipedia_search' THEN concat('WITH t AS (SELECT ', CAST(k AS STRING), ' AS v) SELECT v FROM t')
         WHEN 'pubmed_search' THEN concat('SELECT VIRUS_SPECIES FROM host WHERE DISEASE_STATUS ILIKE ''%call%'' AND HOST_COUNT > ', CAST(k AS STRING))
         WHEN 'ncbi_taxonomy_search' THEN concat('select\n*\nfrom host where tax_id = ', CAST(k AS STRING))
         WHEN 'query_host_sql' THEN concat('  (SELECT t.* FROM host t WHERE t.tax_id = ', CAST(k AS STRING), ')')
         ELSE concat('SELECT DISTINCT *, ', CAST(k AS STRING), ' AS k FROM host')
       END AS statement
FROM tool_calls
"""

SQL_AUDIT_ORACLE = """
SELECT call_id,
       CASE WHEN NOT regexp_matches(regexp_replace(statement, '^\\s+|\\s+$', '', 'g'),
                                    '(?i)^\\(?\\s*SELECT\\b') THEN 'select_only'
            WHEN regexp_matches(statement, '(?i)\\b(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|ATTACH|DETACH|COPY|PRAGMA|EXPORT|IMPORT|CALL)\\b') THEN 'forbidden_keyword'
            WHEN regexp_matches(statement, '(?i)SELECT\\s+\\*\\s+FROM') THEN 'select_star'
       END AS rule
FROM statements
""".replace("\\\\", "\\")


@query("sql_audit", oracle("WITH statements AS (" + STATEMENTS_SQL + ")\n" + SQL_AUDIT_ORACLE,
                          "tool_calls"))
def sql_audit(spark, sf_dir):
    session(spark, sf_dir, land=False)
    stmts = spark.sql(STATEMENTS_SQL)
    return stmts.select("call_id", guard.audit_rule(F.col("statement")).alias("rule"))


# -- G3 + A2: callable over df_host --------------------------------------------
FRAME_SQL = """
SELECT VIRUS_GENUS, VIRUS_SPECIES, COUNTRY
FROM host
WHERE VIRUS_FAMILY ILIKE '%brand#2%'
"""


@query("frames_group_size", oracle(
    "SELECT VIRUS_GENUS, COUNT(*) AS n FROM (" + FRAME_SQL + ") d "
    "WHERE VIRUS_GENUS IS NOT NULL GROUP BY VIRUS_GENUS", "host"))
def frames_group_size(spark, sf_dir):
    s = session(spark, sf_dir)
    guard.guarded_sql(s, FRAME_SQL, check_empty=False)
    return guard.query_frames(s, lambda taxo, host: frames.group_size(host, "VIRUS_GENUS"),
                              check_empty=False)


# -- G4: preview counts ----------------------------------------------------------
@query("preview_summary", oracle(
    "SELECT COUNT(*) AS total, LEAST(COUNT(*), 50) AS shown, "
    "GREATEST(COUNT(*) - 50, 0) AS remaining FROM (" + FRAME_SQL + ") d", "host"))
def preview_summary(spark, sf_dir):
    df = guarded(spark, sf_dir, FRAME_SQL)
    return guard.preview_counts(df, guard.DEFAULT_PREVIEW_ROWS)


# -- G6: frame verbs ---------------------------------------------------------------
@query("frame_value_counts", oracle(
    "SELECT COUNTRY, COUNT(*) AS count FROM host WHERE COUNTRY IS NOT NULL GROUP BY COUNTRY",
    "host"))
def frame_value_counts(spark, sf_dir):
    s = session(spark, sf_dir)
    return frames.value_counts(s.host, "COUNTRY")


@query("frame_nlargest", oracle(
    "SELECT obs_order, obs_line, tax_id, host_id, VIRUS_SPECIES, SCORE FROM host "
    "ORDER BY SCORE DESC, obs_order, obs_line, tax_id, host_id LIMIT 10", "host"))
def frame_nlargest(spark, sf_dir):
    s = session(spark, sf_dir)
    h = s.host.select("obs_order", "obs_line", "tax_id", "host_id", "VIRUS_SPECIES", "SCORE")
    return frames.nlargest(h, 10, "SCORE", ["obs_order", "obs_line", "tax_id", "host_id"])


@query("frame_drop_duplicates", oracle(
    "SELECT DISTINCT VIRUS_SPECIES, HOST_TAX_NAME FROM host", "host"))
def frame_drop_duplicates(spark, sf_dir):
    s = session(spark, sf_dir)
    return s.host.select("VIRUS_SPECIES", "HOST_TAX_NAME").dropDuplicates()


@query("frame_fillna", oracle(
    "SELECT obs_order, obs_line, COALESCE(COUNTRY, 'Unknown') AS COUNTRY, "
    "COALESCE(VIRUS_GENUS, 'Unknown') AS VIRUS_GENUS FROM host", "host"))
def frame_fillna(spark, sf_dir):
    s = session(spark, sf_dir)
    return (s.host.select("obs_order", "obs_line", "COUNTRY", "VIRUS_GENUS")
            .fillna("Unknown", subset=["COUNTRY", "VIRUS_GENUS"]))


_DESCRIBE_ONE = ("SELECT '{c}' AS \"column\", COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, "
                 "ROUND(STDDEV_SAMP({c}), 4) AS std, MIN({c}) AS min, MAX({c}) AS max FROM host")


@query("frame_describe", oracle(
    _DESCRIBE_ONE.format(c="HOST_COUNT") + " UNION ALL " + _DESCRIBE_ONE.format(c="SCORE"), "host"))
def frame_describe(spark, sf_dir):
    s = session(spark, sf_dir)
    return frames.describe(s.host, ["HOST_COUNT", "SCORE"])


@query("frame_pivot", oracle(
    "SELECT VIRUS_GENUS, COUNT(*) FILTER (WHERE DISEASE_STATUS = 'A') AS A, "
    "COUNT(*) FILTER (WHERE DISEASE_STATUS = 'N') AS N, "
    "COUNT(*) FILTER (WHERE DISEASE_STATUS = 'R') AS R FROM host GROUP BY VIRUS_GENUS", "host"))
def frame_pivot(spark, sf_dir):
    s = session(spark, sf_dir)
    return frames.pivot_counts(s.host, "VIRUS_GENUS", "DISEASE_STATUS", ["A", "N", "R"])


@query("frame_unpivot", oracle(
    "SELECT obs_order, obs_line, 'HOST_COUNT' AS variable, HOST_COUNT AS value FROM host "
    "UNION ALL SELECT obs_order, obs_line, 'SCORE' AS variable, SCORE AS value FROM host", "host"))
def frame_unpivot(spark, sf_dir):
    s = session(spark, sf_dir)
    h = s.host.select("obs_order", "obs_line", "HOST_COUNT", "SCORE")
    return frames.melt(h, ["obs_order", "obs_line"], ["HOST_COUNT", "SCORE"])


@query("frame_cumsum", oracle(
    "SELECT obs_order, obs_line, tax_id, host_id, HOST_COUNT, SUM(HOST_COUNT) OVER ("
    "PARTITION BY obs_order ORDER BY obs_line, tax_id, host_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_count FROM host",
    "host"))
def frame_cumsum(spark, sf_dir):
    # an observation's lines form a bounded partition (one sample, few lines)
    s = session(spark, sf_dir)
    h = s.host.select("obs_order", "obs_line", "tax_id", "host_id", "HOST_COUNT")
    return frames.running_total(h, ["obs_order"], ["obs_line", "tax_id", "host_id"],
                                "HOST_COUNT", "cum_count")


# -- P2 / P3 / P4 / P6 / P8 / P10 -----------------------------------------------
ILIKE_SQL = """
SELECT obs_order, obs_line, VIRUS_SPECIES, COUNTRY
FROM host
WHERE VIRUS_SPECIES ILIKE '%RiNg%'
"""


@query("ilike_filter", oracle(ILIKE_SQL, "host"))
def ilike_filter(spark, sf_dir):
    return guarded(spark, sf_dir, ILIKE_SQL)


PREDICATE_SQL = """
SELECT obs_order, obs_line, VIRUS_SPECIES, COUNTRY, primary_id
FROM host
WHERE DISEASE_STATUS = 'R' AND COUNTRY IS NOT NULL AND primary_id IS NOT NULL
"""


@query("predicate_filter", oracle(PREDICATE_SQL, "host"))
def predicate_filter(spark, sf_dir):
    return guarded(spark, sf_dir, PREDICATE_SQL)


@query("regex_contains", oracle(
    "SELECT tax_id, SPECIES_NAME FROM taxonomy "
    "WHERE regexp_matches(SPECIES_NAME, '(?i)r[ie]ng|WIDGET s')", "taxonomy"))
def regex_contains(spark, sf_dir):
    # pandas str.contains(term, case=False): a regex; NULL never matches
    s = session(spark, sf_dir)
    term = "r[ie]ng|WIDGET s"
    t = s.taxonomy
    return (t.filter(F.coalesce(F.col("SPECIES_NAME").rlike("(?i)" + term), F.lit(False)))
            .select("tax_id", "SPECIES_NAME"))


COALESCE_SQL = """
SELECT obs_order, obs_line, COALESCE(primary_id, secondary_id) AS sample_id
FROM host
"""


@query("coalesce_sample_id", oracle(COALESCE_SQL, "host"))
def coalesce_sample_id(spark, sf_dir):
    return guarded(spark, sf_dir, COALESCE_SQL)


@query("dropna_subset", oracle(
    "SELECT obs_order, obs_line, COUNTRY, VIRUS_GENUS FROM host "
    "WHERE COUNTRY IS NOT NULL AND VIRUS_GENUS IS NOT NULL", "host"))
def dropna_subset(spark, sf_dir):
    s = session(spark, sf_dir)
    return (s.host.select("obs_order", "obs_line", "COUNTRY", "VIRUS_GENUS")
            .dropna(how="any", subset=["COUNTRY", "VIRUS_GENUS"]))


DISTINCT_SQL = "SELECT DISTINCT VIRUS_FAMILY FROM host"


@query("distinct_values", oracle(DISTINCT_SQL, "host"))
def distinct_values(spark, sf_dir):
    return guarded(spark, sf_dir, DISTINCT_SQL)


# -- A4 / A6 / A7 / A8 -------------------------------------------------------------
@query("category_share", oracle(
    "SELECT VIRUS_GENUS, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM host "
    "WHERE VIRUS_FAMILY = 'Brand#3'), 6) AS share FROM host WHERE VIRUS_FAMILY = 'Brand#3' "
    "GROUP BY VIRUS_GENUS", "host"))
def category_share(spark, sf_dir):
    s = session(spark, sf_dir)
    return frames.category_share(s.host.filter(F.col("VIRUS_FAMILY") == "Brand#3"), "VIRUS_GENUS")


@query("histogram_bins", oracle("""
WITH s AS (SELECT MIN(SCORE) AS lo, MAX(SCORE) AS hi FROM host),
b AS (SELECT CAST(LEAST(FLOOR((SCORE - lo) / ((hi - lo) / 10.0)), 9) AS INTEGER) AS bin, lo, hi
      FROM host, s WHERE SCORE IS NOT NULL)
SELECT bin, COUNT(*) AS n, ROUND(ANY_VALUE(lo) + bin * ((ANY_VALUE(hi) - ANY_VALUE(lo)) / 10.0), 6) AS bin_lo,
       ROUND(ANY_VALUE(lo) + (bin + 1) * ((ANY_VALUE(hi) - ANY_VALUE(lo)) / 10.0), 6) AS bin_hi
FROM b GROUP BY bin
""", "host"))
def histogram_bins(spark, sf_dir):
    s = session(spark, sf_dir)
    return frames.histogram(s.host, "SCORE", bins=10)


@query("species_per_genus", oracle(
    "SELECT VIRUS_GENUS, COUNT(DISTINCT VIRUS_SPECIES) AS n_species FROM host GROUP BY VIRUS_GENUS",
    "host"))
def species_per_genus(spark, sf_dir):
    s = session(spark, sf_dir)
    return frames.distinct_count(s.host, "VIRUS_GENUS", "VIRUS_SPECIES", "n_species")


@query("country_distribution", oracle(
    "SELECT COUNTRY, COUNT(*) AS n, COUNT(DISTINCT COALESCE(primary_id, secondary_id)) AS n_samples "
    "FROM host WHERE VIRUS_FAMILY ILIKE '%brand#1%' GROUP BY COUNTRY", "host"))
def country_distribution(spark, sf_dir):
    s = session(spark, sf_dir)
    h = s.host.filter(F.col("VIRUS_FAMILY").ilike("%brand#1%"))
    return h.groupBy("COUNTRY").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.coalesce("primary_id", "secondary_id")).alias("n_samples"))


# -- L1 / L8 ---------------------------------------------------------------------------
LIMIT_SQL = """
SELECT obs_order, obs_line, tax_id, host_id, VIRUS_SPECIES, SCORE
FROM host
WHERE VIRUS_FAMILY ILIKE '%brand#1%'
ORDER BY SCORE DESC, obs_order, obs_line, tax_id, host_id
LIMIT 1000
"""


@query("limit_topn", oracle(LIMIT_SQL, "host"))
def limit_topn(spark, sf_dir):
    return guarded(spark, sf_dir, LIMIT_SQL)


SORT_NULLS_SQL = """
SELECT COUNTRY, n, CAST(ROW_NUMBER() OVER (ORDER BY COUNTRY ASC NULLS LAST) AS BIGINT) AS rank
FROM (SELECT COUNTRY, COUNT(*) AS n FROM host GROUP BY COUNTRY) c
"""


@query("sort_nulls", oracle(SORT_NULLS_SQL, "host"))
def sort_nulls(spark, sf_dir):
    # the ranking runs over the grouped rows (one per country), not over host
    return guarded(spark, sf_dir, SORT_NULLS_SQL)


_ROLLUP_LEVELS = [["VIRUS_FAMILY", "VIRUS_GENUS"], ["VIRUS_FAMILY"], ["MONTH"], []]


@query("species_sketch_rollup", oracle("""
SELECT concat_ws(',', CASE WHEN GROUPING(VIRUS_FAMILY) = 0 THEN 'VIRUS_FAMILY' END, CASE WHEN GROUPING(VIRUS_GENUS) = 0 THEN 'VIRUS_GENUS' END,
                 CASE WHEN GROUPING(MONTH) = 0 THEN 'MONTH' END) AS level,
       VIRUS_FAMILY, VIRUS_GENUS, MONTH, COUNT(*) AS n_rows, COUNT(DISTINCT VIRUS_SPECIES) AS n_members
FROM (SELECT VIRUS_FAMILY, VIRUS_GENUS, VIRUS_SPECIES, substring(CAST(COLLECTION_DATE AS VARCHAR), 1, 7) AS MONTH FROM host) h
GROUP BY GROUPING SETS ((VIRUS_FAMILY, VIRUS_GENUS), (VIRUS_FAMILY), (MONTH), ())
""", "host"))
def species_sketch_rollup(spark, sf_dir):
    s = session(spark, sf_dir)
    name = f"members-{fingerprint(spark, sf_dir, ('lineitem', 'part', 'supplier', 'nation'), 'hll-v1')}"
    path = landed(spark, name, lambda at: MS.add_batch(
        s.host.select("VIRUS_FAMILY", "VIRUS_GENUS", "VIRUS_SPECIES", F.substring(F.col("COLLECTION_DATE").cast("string"), 1, 7).alias("MONTH")),
        ["VIRUS_FAMILY", "VIRUS_GENUS", "MONTH"], "VIRUS_SPECIES", at, "1"))
    return MS.members(spark, path, _ROLLUP_LEVELS)
