"""Search jobs: name resolution (J6), article lookup (J7), ranked top-k
(L6, W3), substring search with genus fallback (P5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.operators import article_index as IX
from hostlens.operators import closest as CL
from hostlens.operators import regex_search as RX
from hostlens.operators import search as S
from hostlens.operators import taxon_tree as TT
from hostlens.plans.common import oracle, session
from hostlens.plans.registry import query
from hostlens.sources.tables import fingerprint, landed, read_table

_COLLAPSE = "regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_TOKENS = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"

ACRONYM_SQL = ("upper(concat(substring(split_part(ORGANISM_NAME, ' ', 1), 1, 1), "
               "substring(split_part(ORGANISM_NAME, ' ', 2), 1, 1), substring(GENUS_NAME, 1, 1)))")
COMMON_SQL = "concat(lower(GENUS_NAME), ' ', split_part(ORGANISM_NAME, ' ', 2))"

RESOLVE_TERMS_SQL = f"""
SELECT concat('  ', upper(ORGANISM_NAME), ' ') AS term FROM taxonomy
UNION SELECT {ACRONYM_SQL} AS term FROM taxonomy
UNION SELECT {COMMON_SQL} AS term FROM taxonomy
UNION SELECT concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2)) AS term FROM benchmark
"""

_RESOLVE_ORACLE = f"""
WITH terms AS ({RESOLVE_TERMS_SQL}),
names AS (
  SELECT tax_id, ORGANISM_NAME AS name, 'scientific name' AS name_class, 1 AS priority FROM taxonomy
  UNION ALL SELECT tax_id, SPECIES_NAME, 'synonym', 2 FROM taxonomy
  UNION ALL SELECT tax_id, {ACRONYM_SQL}, 'acronym', 3 FROM taxonomy
  UNION ALL SELECT tax_id, {COMMON_SQL}, 'common name', 4 FROM taxonomy),
nk AS (SELECT *, lower({_COLLAPSE.format(x="name")}) AS key FROM names
       WHERE name IS NOT NULL AND regexp_replace(name, '^\\s+|\\s+$', '', 'g') <> ''),
best AS (SELECT key, tax_id, name, name_class, priority FROM (
           SELECT *, ROW_NUMBER() OVER (PARTITION BY key, tax_id ORDER BY priority, name, name_class) AS rn
           FROM nk) x WHERE rn = 1),
q AS (SELECT DISTINCT term, lower({_COLLAPSE.format(x="term")}) AS key FROM terms),
hits AS (SELECT q.term, b.tax_id, b.name, b.name_class,
                ROW_NUMBER() OVER (PARTITION BY q.term ORDER BY b.priority NULLS LAST, b.tax_id) AS rank
         FROM q LEFT JOIN best b ON q.key = b.key)
SELECT term, rank, tax_id, name, name_class, tax_id IS NOT NULL AS found FROM hits WHERE rank <= 5
""".replace("\\\\", "\\")


@query("resolve_names", oracle(_RESOLVE_ORACLE, "taxonomy"))
def resolve_names(spark, sf_dir):
    session(spark, sf_dir, land=False)
    taxa = spark.table("taxonomy")
    names = S.name_table(taxa, "tax_id", {
        "scientific name": F.col("ORGANISM_NAME"),
        "synonym": F.col("SPECIES_NAME"),
        "acronym": F.expr(ACRONYM_SQL),
        "common name": F.expr(COMMON_SQL),
    })
    return S.resolve_names(spark.sql(RESOLVE_TERMS_SQL), names, k=5)


_TOPK_ORACLE = f"""
WITH post AS (SELECT DISTINCT doc_id, token FROM (
                SELECT doc_id, unnest({_TOKENS.format(x="text")}) AS token FROM documents) x),
qt AS (SELECT DISTINCT query_id, token FROM (
         SELECT item_id AS query_id, unnest({_TOKENS.format(x="text")}) AS token FROM benchmark) y),
sc AS (SELECT q.query_id, p.doc_id, COUNT(*) AS score
       FROM qt q JOIN post p ON p.token = q.token
       GROUP BY q.query_id, p.doc_id)
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) z
WHERE rank <= 5
"""


@query("article_topk", _TOPK_ORACLE)
def article_topk(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    bench = read_table(spark, sf_dir, "benchmark")
    return S.search_topk(bench, "item_id", "text", docs, "doc_id", "text", k=5)


_BM25_ORACLE = f"""
WITH post AS (SELECT doc_id, token, COUNT(*) AS tf FROM (
                SELECT doc_id, unnest({_TOKENS.format(x="text")}) AS token FROM documents) x GROUP BY doc_id, token),
size AS (SELECT doc_id, len({_TOKENS.format(x="coalesce(text, '')")}) AS n FROM documents),
whole AS (SELECT COUNT(*) AS n, AVG(n) AS average FROM size),
df AS (SELECT token, COUNT(*) AS df FROM post GROUP BY token),
qt AS (SELECT DISTINCT query_id, token FROM (
         SELECT item_id AS query_id, unnest({_TOKENS.format(x="text")}) AS token FROM benchmark) y),
sc AS (SELECT q.query_id, p.doc_id, ROUND(SUM(
         ln(1 + (whole.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * size.n / whole.average))), 6) AS score
       FROM qt q JOIN post p ON p.token = q.token JOIN df ON df.token = q.token JOIN size ON size.doc_id = p.doc_id, whole
       GROUP BY q.query_id, p.doc_id)
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) z
WHERE rank <= 5
"""


def landed_articles(spark, sf_dir) -> str:
    """Path of the index over the articles."""
    return landed(spark, f"articles-{fingerprint(spark, sf_dir, ('documents',), 'bm25-v1')}", lambda at: IX.build_index(
        read_table(spark, sf_dir, "documents"), "doc_id", "text", at))


@query("article_topk_index", _BM25_ORACLE)
def article_topk_index(spark, sf_dir):
    path = landed_articles(spark, sf_dir)
    return IX.search_index(read_table(spark, sf_dir, "benchmark"), "item_id", "text", path, k=5)


_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
LOOKUP_TERMS_SQL = f"""
SELECT {_TITLE} AS term FROM pages
UNION SELECT concat(split_part({_TITLE}, ' ', 1), ' zz!') AS term FROM pages
"""
_CLEAN = "regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s\\-]', '', 'g')"
_KEY = "lower(" + _COLLAPSE.format(x=_CLEAN) + ")"

_LOOKUP_ORACLE = f"""
WITH terms AS ({LOOKUP_TERMS_SQL}),
raw AS (SELECT page_id, {_TITLE} AS title,
               {_COLLAPSE.format(x="regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS body FROM pages),
arts AS (SELECT page_id, title, body, {_KEY.format(x="title")} AS key FROM raw),
q AS (SELECT DISTINCT term, {_KEY.format(x="term")} AS key FROM terms),
bykey AS (SELECT key, MIN(page_id) AS page_id FROM arts GROUP BY key),
exact AS (SELECT q.term, b.page_id, FALSE AS fuzzy FROM q JOIN bykey b ON q.key = b.key),
rest AS (SELECT * FROM q WHERE term NOT IN (SELECT term FROM exact)),
tok AS (SELECT DISTINCT page_id, token FROM (
          SELECT page_id, unnest({_TOKENS.format(x="title")}) AS token FROM arts) x),
stats AS (SELECT token, COUNT(*) AS df, MIN(page_id) AS first_page FROM tok GROUP BY token),
rt AS (SELECT DISTINCT term, token FROM (SELECT term, unnest({_TOKENS.format(x="key")}) AS token FROM rest) y),
fz AS (SELECT term, first_page AS page_id, TRUE AS fuzzy FROM (
         SELECT rt.term, s.first_page, ROW_NUMBER() OVER (PARTITION BY rt.term ORDER BY s.df, s.first_page) AS rn
         FROM rt JOIN stats s ON rt.token = s.token) z WHERE rn = 1),
hits AS (SELECT * FROM exact UNION ALL SELECT * FROM fz)
SELECT q.term, h.page_id, a.title, h.fuzzy, h.page_id IS NOT NULL AS found,
       CASE WHEN length(a.body) > 4000 THEN concat(substring(a.body, 1, 4000), '... [truncated]')
            ELSE a.body END AS extract
FROM (SELECT DISTINCT term FROM q) q LEFT JOIN hits h ON q.term = h.term LEFT JOIN arts a ON h.page_id = a.page_id
""".replace("\\\\", "\\")


@query("article_lookup", _LOOKUP_ORACLE)
def article_lookup(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    pages.createOrReplaceTempView("pages")
    return S.article_lookup(spark.sql(LOOKUP_TERMS_SQL), pages, limit=4000)


FALLBACK_TERMS_SQL = """
SELECT ORGANISM_NAME AS term FROM taxonomy
UNION SELECT concat(split_part(ORGANISM_NAME, ' ', 1), ' zzz') AS term FROM taxonomy
UNION SELECT substring(ORGANISM_NAME, 3, 2) AS term FROM taxonomy
"""


@query("name_fallback_search", oracle(f"""
WITH terms AS ({FALLBACK_TERMS_SQL}),
hit AS (SELECT t.term, x.tax_id, x.ORGANISM_NAME AS name FROM terms t
        JOIN taxonomy x ON contains(lower(x.ORGANISM_NAME), lower(t.term))),
missed AS (SELECT term FROM terms WHERE term NOT IN (SELECT term FROM hit)),
genus AS (SELECT m.term, x.tax_id, x.ORGANISM_NAME AS name FROM missed m
          JOIN taxonomy x ON contains(lower(x.ORGANISM_NAME), lower(split_part(trim(m.term), ' ', 1))))
SELECT term, 'species' AS match_level, tax_id, name FROM hit
UNION ALL SELECT term, 'genus' AS match_level, tax_id, name FROM genus
""", "taxonomy"))
def name_fallback_search(spark, sf_dir):
    session(spark, sf_dir, land=False)
    return S.name_fallback_search(spark.sql(FALLBACK_TERMS_SQL), spark.table("taxonomy"),
                                  "ORGANISM_NAME", "tax_id")


# anchors, alternation, classes, optional and repeated parts, and a term that only its first word finds
REGEX_TERMS_SQL = """
SELECT concat('^', upper(ORGANISM_NAME), '$') AS term FROM taxonomy
UNION SELECT concat('(', split_part(ORGANISM_NAME, ' ', 1), '|zzz) +(', split_part(ORGANISM_NAME, ' ', 2), '|none)') AS term FROM taxonomy
UNION SELECT concat('[', substring(ORGANISM_NAME, 1, 1), 'qx]', substring(ORGANISM_NAME, 2, 2), '(yy)?', substring(ORGANISM_NAME, 4, 4)) AS term FROM taxonomy
UNION SELECT concat(substring(ORGANISM_NAME, 1, 2), '.*', split_part(ORGANISM_NAME, ' ', 2), '$') AS term FROM taxonomy
UNION SELECT concat(split_part(ORGANISM_NAME, ' ', 1), ' z{2,}') AS term FROM taxonomy
UNION SELECT concat(split_part(ORGANISM_NAME, ' ', 2), '\\\\b|[0-9]+x') AS term FROM taxonomy
"""


@query("name_regex_search", oracle(f"""
WITH terms AS ({REGEX_TERMS_SQL.replace(chr(92) * 2, chr(92))}),
hit AS (SELECT t.term, x.tax_id, x.ORGANISM_NAME AS name FROM terms t
        JOIN taxonomy x ON regexp_matches(x.ORGANISM_NAME, t.term, 'i')),
missed AS (SELECT term FROM terms WHERE term NOT IN (SELECT term FROM hit)),
genus AS (SELECT m.term, x.tax_id, x.ORGANISM_NAME AS name FROM missed m
          JOIN taxonomy x ON regexp_matches(x.ORGANISM_NAME, split_part(trim(m.term), ' ', 1), 'i'))
SELECT term, 'species' AS match_level, tax_id, name FROM hit
UNION ALL SELECT term, 'genus' AS match_level, tax_id, name FROM genus
""", "taxonomy"))
def name_regex_search(spark, sf_dir):
    session(spark, sf_dir, land=False)
    return RX.name_regex_search(spark.sql(REGEX_TERMS_SQL), spark.table("taxonomy"), "ORGANISM_NAME", "tax_id")


# titles as they are, with one to three edits, and with more than may count
TYPO_TERMS_SQL = f"""
SELECT {_TITLE} AS term FROM pages
UNION SELECT concat(substring({_TITLE}, 1, 2), substring({_TITLE}, 4)) AS term FROM pages
UNION SELECT concat(substring({_TITLE}, 1, 5), 'q', substring({_TITLE}, 7), 'x') AS term FROM pages
UNION SELECT concat('z', substring({_TITLE}, 3), 'w') AS term FROM pages
UNION SELECT concat('far away ', {_TITLE}) AS term FROM pages
"""
_PLAIN_KEY = "translate(" + _KEY + f", '{CL.MARKED}', '{CL.PLAIN}')"

_CLOSEST_ORACLE = f"""
WITH terms AS ({TYPO_TERMS_SQL}),
raw AS (SELECT page_id, {_TITLE} AS title, html FROM pages),
arts AS (SELECT page_id, title, {_PLAIN_KEY.format(x="title")} AS key FROM raw),
t AS (SELECT key, length(key) AS l, MIN(page_id) AS page_id FROM arts WHERE key <> '' GROUP BY key),
q AS (SELECT DISTINCT term, {_PLAIN_KEY.format(x="term")} AS key FROM terms),
k AS (SELECT DISTINCT key, length(key) AS n, least(3, length(key) // 4) AS e FROM q WHERE key <> ''),
near AS (SELECT k.key, t.page_id, levenshtein(k.key, t.key) AS edits, e FROM k JOIN t ON t.l BETWEEN n - e AND n + e),
best AS (SELECT key, page_id, edits FROM (
           SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY edits, page_id) AS rn FROM near WHERE edits <= e) x WHERE rn = 1),
body AS (SELECT page_id, title, {_COLLAPSE.format(x="regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS body FROM raw
         WHERE page_id IN (SELECT page_id FROM best))
SELECT q.term, b.page_id, body.title, CAST(b.edits AS BIGINT) AS edits, b.page_id IS NOT NULL AS found,
       CASE WHEN length(body) > 4000 THEN concat(substring(body, 1, 4000), '... [truncated]') ELSE body END AS extract
FROM q LEFT JOIN best b ON b.key = q.key LEFT JOIN body ON body.page_id = b.page_id
""".replace("\\\\", "\\")


@query("article_closest", _CLOSEST_ORACLE)
def article_closest(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    pages.createOrReplaceTempView("pages")
    return CL.article_closest(spark.sql(TYPO_TERMS_SQL), pages)


# life > family > genus > species > taxon
_FAMILY = "COALESCE(FAMILY_NAME, 'unplaced')"
_GENUS = f"concat({_FAMILY}, '/', COALESCE(GENUS_NAME, '?'))"
_SPECIES = f"concat({_GENUS}, '/', ORGANISM_NAME)"
TAXON_EDGES_SQL = f"""
SELECT 'life' AS node, CAST(NULL AS STRING) AS parent
UNION SELECT {_FAMILY}, 'life' FROM taxonomy
UNION SELECT {_GENUS}, {_FAMILY} FROM taxonomy
UNION SELECT {_SPECIES}, {_GENUS} FROM taxonomy
UNION SELECT concat('taxon ', CAST(tax_id AS STRING)), {_SPECIES} FROM taxonomy
"""


@query("taxon_subtree_counts", oracle(f"""
WITH RECURSIVE edges AS ({TAXON_EDGES_SQL}),
up AS (SELECT node, node AS above FROM edges
       UNION ALL SELECT up.node, e.parent FROM up JOIN edges e ON e.node = up.above WHERE e.parent IS NOT NULL),
obs AS (SELECT concat('taxon ', CAST(tax_id AS STRING)) AS node, COUNT(*) AS n FROM host GROUP BY tax_id),
deep AS (SELECT node, COUNT(*) AS depth FROM up GROUP BY node)
SELECT above AS node, deep.depth, COUNT(*) - 1 AS n_below, CAST(SUM(COALESCE(obs.n, 0)) AS BIGINT) AS n_obs
FROM up LEFT JOIN obs ON obs.node = up.node JOIN deep ON deep.node = up.above GROUP BY above, deep.depth
""", "host", "taxonomy"))
def taxon_subtree_counts(spark, sf_dir):
    session(spark, sf_dir)
    seen = spark.table("host").groupBy("tax_id").agg(F.count("*").alias("n_obs")).select(
        F.concat(F.lit("taxon "), F.col("tax_id").cast("string")).alias("node"), "n_obs")
    return TT.subtree_sums(TT.nested_intervals(spark.sql(TAXON_EDGES_SQL)), seen, "n_obs").select("node", "depth", "n_below", "n_obs")
