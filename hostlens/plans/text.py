"""Answer-text and display-string jobs over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.functions import text as X
from hostlens.operators import turns as TU
from hostlens.plans.common import oracle, session
from hostlens.plans.registry import query
from hostlens.sources.tables import read_table

# Assistant answers with PMID citations appended (the test texts cite none).
ANSWERS_SQL = """
SELECT id, conversation_id AS conv_id, turn,
       concat(content, ' See PMID: ', CAST(((conversation_id * 7 + turn) % 100) * 1000 + 1 AS STRING),
              ', pmid#', CAST(conversation_id * 1000 + 1 AS STRING), ' and PMID ', CAST(turn * 1000 + 2 AS STRING),
              ' (e.g., on mice models) (see )\n\n\n\nEnd  of\tanswer.  ') AS text
FROM messages WHERE role = 'assistant'
"""

_PMID_ORACLE = """
WITH real AS (SELECT conv_id, turn, list(DISTINCT CAST(pmid AS VARCHAR)) AS pmids
              FROM artifacts WHERE success AND type = 'pubmed' GROUP BY conv_id, turn),
ans AS (""" + ANSWERS_SQL + """),
f AS (SELECT a.id, a.text,
             list_filter(regexp_extract_all(a.text, '(?i)\\bPMID[:\\s#]*([0-9]{5,9})\\b', 1),
                         lambda p: NOT list_contains(COALESCE(r.pmids, []), p)) AS fake
      FROM ans a LEFT JOIN real r ON r.conv_id = a.conv_id AND r.turn = a.turn),
g AS (SELECT id, fake, list_reduce(list_prepend(text, fake),
              lambda acc, p: regexp_replace(acc, concat('(?i)\\bPMID[:\\s#]*', p, '\\b'), '', 'g')) AS t
      FROM f)
SELECT id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    t, '\\(e\\.g\\.\\s*,?\\s*on\\s+[^)]{0,80}\\)', '', 'g'), '\\(see\\s*\\)', '', 'g'),
    '[ \\t]+', ' ', 'g'), '\\n{3,}', '\n\n', 'g'), '^\\s+|\\s+$', '', 'g') AS text,
  array_to_string(fake, ',') AS removed, len(fake) AS n_removed
FROM g
""".replace("\\\\", "\\")


@query("pmid_whitelist", oracle(_PMID_ORACLE, "messages", "artifacts"))
def pmid_whitelist(spark, sf_dir):
    session(spark, sf_dir, land=False)
    answers = spark.sql(ANSWERS_SQL)
    real = TU.real_pmids(spark.table("artifacts")).withColumn("_real", F.lit(True))
    mentions = answers.select("id", "conv_id", "turn",
                              F.posexplode(X.pmid_mentions(F.col("text"))).alias("pos", "pmid"))
    fake = (mentions.join(real, ["conv_id", "turn", "pmid"], "left")
            .filter(F.col("_real").isNull())
            .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "pmid"))).alias("_f"))
            .select("id", F.transform("_f", lambda e: e["pmid"]).alias("fake")))
    j = answers.join(fake, "id", "left").withColumn(
        "fake", F.coalesce("fake", F.array().cast("array<string>")))
    return j.select("id", X.strip_pmids(F.col("text"), F.col("fake")).alias("text"),
                    F.array_join("fake", ",").alias("removed"),
                    F.size("fake").cast("bigint").alias("n_removed"))


_MARKED_SQL = """
SELECT doc_id, concat(text, CASE WHEN doc_id % 3 = 0
  THEN ' receptors【4†L13-L17】 .\n\n\n\nMore  text【1】 , end【】' ELSE '' END) AS text
FROM documents
"""


@query("citation_markers", """
WITH d AS (""" + _MARKED_SQL + """),
n AS (SELECT doc_id, text, len(regexp_extract_all(text, '【[^【】]*】')) AS n_markers FROM d)
SELECT doc_id, n_markers,
  CASE WHEN n_markers > 0 THEN
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      text, '【[^【】]*】', '', 'g'), '[ \\t]+', ' ', 'g'), '\\s+([.,;:!?])', '\\1', 'g'),
      '\\n{3,}', '\n\n', 'g'), '^\\s+|\\s+$', '', 'g')
  ELSE text END AS text
FROM n
""".replace("\\\\", "\\"))
def citation_markers(spark, sf_dir):
    read_table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    d = spark.sql(_MARKED_SQL)
    return d.select("doc_id", X.citation_marker_count(F.col("text")).cast("bigint").alias("n_markers"),
                    X.strip_citation_markers(F.col("text")).alias("text"))


_COLLAPSE = "regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def _cut_sql(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN concat(substring({x}, 1, {n}), '…') ELSE {x} END"


@query("snippet", ("SELECT doc_id, " + _cut_sql(_COLLAPSE.format(x="text"), 120)
                   + " AS snippet FROM documents").replace("\\\\", "\\"))
def snippet(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("conversation_titles", ("""
WITH firsts AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id),
c AS (SELECT conv_id, """ + _COLLAPSE.format(x="COALESCE(q, '')") + """ AS s FROM firsts)
SELECT conv_id, CASE WHEN s = '' THEN 'New conversation' ELSE """ + _cut_sql("s", 48) + """ END AS title
FROM c
""").replace("\\\\", "\\"))
def conversation_titles(spark, sf_dir):
    m = read_table(spark, sf_dir, "conversations")
    firsts = m.filter(F.col("role") == "user").groupBy("conv_id") \
        .agg(F.min_by("text", "turn").alias("q"))
    return firsts.select("conv_id", X.title_from_text(F.col("q")).alias("title"))


@query("content_cap", """
SELECT doc_id, CASE WHEN length(text) > 6000
  THEN concat(substring(text, 1, 6000), '\n\n[...truncated — ', CAST(length(text) - 6000 AS VARCHAR), ' chars omitted]')
  ELSE text END AS capped
FROM documents
""")
def content_cap(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", X.content_cap(F.col("text")).alias("capped"))


@query("source_links", oracle("""
SELECT 'wiki' AS source, CAST(page_id AS VARCHAR) AS key,
       concat('https://en.wikipedia.org/wiki/', replace(regexp_extract(html, '<title>(.*?)</title>', 1), ' ', '_')) AS url
FROM pages
UNION ALL
SELECT DISTINCT 'pubmed', CAST(pmid AS VARCHAR), concat('https://pubmed.ncbi.nlm.nih.gov/', CAST(pmid AS VARCHAR), '/')
FROM artifacts WHERE type = 'pubmed'
UNION ALL
SELECT 'ncbi', CAST(tax_id AS VARCHAR), concat('https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=', CAST(tax_id AS VARCHAR))
FROM taxonomy
""", "artifacts", "taxonomy"))
def source_links(spark, sf_dir):
    session(spark, sf_dir, land=False)
    pages = spark.table("pages")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    wiki = pages.select(F.lit("wiki").alias("source"), F.col("page_id").cast("string").alias("key"),
                        X.wiki_url(title).alias("url"))
    pm = spark.table("artifacts").filter(F.col("type") == "pubmed").select("pmid").distinct()
    pub = pm.select(F.lit("pubmed").alias("source"), F.col("pmid").cast("string").alias("key"),
                    X.pubmed_url(F.col("pmid")).alias("url"))
    ncbi = spark.table("taxonomy").select(F.lit("ncbi").alias("source"),
                                          F.col("tax_id").cast("string").alias("key"),
                                          X.ncbi_url(F.col("tax_id")).alias("url"))
    return wiki.unionByName(pub).unionByName(ncbi)


LINEAGE_SQL = "concat_ws('; ', 'Viruses', FAMILY_NAME, GENUS_NAME, ORGANISM_NAME)"


@query("lineage_explode", oracle(f"""
WITH l AS (SELECT tax_id, string_split({LINEAGE_SQL}, ';') AS parts FROM taxonomy)
SELECT tax_id, depth, ancestor FROM (
  SELECT tax_id, unnest(range(1, len(parts) + 1)) AS depth, trim(unnest(parts)) AS ancestor FROM l) x
WHERE ancestor <> ''
""", "taxonomy"))
def lineage_explode(spark, sf_dir):
    session(spark, sf_dir, land=False)
    t = spark.table("taxonomy").select("tax_id", F.expr(LINEAGE_SQL).alias("lineage"))
    return t.select("tax_id", F.posexplode(X.lineage_items(F.col("lineage"))).alias("pos", "ancestor")) \
        .select("tax_id", (F.col("pos") + 1).cast("bigint").alias("depth"), "ancestor")
