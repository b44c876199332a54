"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm import backoff_lm, bloom_dedup, chat, chosen_path, hilbert, langmix, noisy_channel, oph, prefix_trie, raking, structure, subword, winnow
from hostlens.llm.common import fold, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


@register("op3_winnowing_decontamination", oracle=r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie inside benchmark windows."""
    return winnow.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items", "spans")


@register("op10_hilbert_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of equal row count, cut from the curve order of all documents."""
    return hilbert.hilbert_shards(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


@register("op6_one_permutation_minhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed one-permutation MinHash of every text and of its edited text."""
    return oph.fingerprint_edits(read_table(spark, sf_dir, "documents"))


@register("op9_chosen_path_dedup", oracle=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
         WHERE 100 * n_both >= 80 * (nx.n + ny.n - n_both)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
comp AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN comp ON comp.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over two-word shingle sets, Jaccard 0.8 or more."""
    return chosen_path.near_duplicates(read_table(spark, sf_dir, "documents"))


@register("op5_backoff_automaton_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text under a bigram automaton learnt from six of seven folds."""
    return backoff_lm.score(read_table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)


@register("op8_language_mixture")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of every text by mixture inference, learnt from three of four folds."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = langmix.learn(docs, ~held_out)
    return docs.select("doc_id", held_out.alias("held_out"), langmix.predict(model, F.col("text"), spark).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.langs")


@register("op2_subword_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learnt from four of five folds."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 5) == 0
    model = subword.learn(docs, labels, "quality", ~held_out)
    return docs.select("doc_id", held_out.alias("held_out"), subword.score(model, F.col("text"), spark).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


@register("op7_noisy_channel_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every restored text, learnt from three of four folds."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4) == 2
    model = noisy_channel.learn(docs, labels, "toxic", ~held_out)
    return docs.select("doc_id", held_out.alias("held_out"), noisy_channel.score(model, F.col("text"), spark).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


@register("op1_chat_role_repair")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, repaired at least cost and rendered."""
    return chat.repair(read_table(spark, sf_dir, "conversations"))


@register("op4_raked_mixture")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probability of every document, raked to source, language and topic targets."""
    return raking.mix(read_table(spark, sf_dir, "documents"))


@register("op11_two_pass_bloom_dedup", oracle="""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal texts; the largest id of each stays."""
    return bloom_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


@register("op12_run_length_structure", oracle=r"""
WITH RECURSIVE bits AS (
  SELECT DISTINCT conv_id AS c, turn AS t, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (
  SELECT c, t, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''),
      lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, y:
      CASE WHEN y >= 0 THEN xor(a, y) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 20 AS k
  FROM bits),
dam AS (
  SELECT conv_id AS c, turn AS t, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS r,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS x, copy
  FROM conversations JOIN crc ON conv_id IS NOT DISTINCT FROM c AND turn IS NOT DISTINCT FROM t,
       LATERAL (SELECT unnest(CASE WHEN k = 0 THEN [] WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy)),
num AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, r, sha256(x), copy) AS i, rtrim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS z FROM dam),
f AS (
  SELECT *, left(r, 1) AS a, CASE WHEN z = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, r, x ORDER BY i) > 1 THEN 'd'
                                  WHEN right(z, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(left(r, 1)) OVER (PARTITION BY c ORDER BY i) || left(r, 1) AS pair FROM num),
ins(s, m, l) AS (VALUES ('', '', ''), ('', 'u', 'I'), ('', 'a', 'II'), ('s', 's', ''), ('s', 'u', 'I'), ('s', 'a', 'II'), ('u', 'u', ''), ('u', 'a', 'I'), ('a', 'a', ''), ('a', 'u', 'I')),
way AS (  -- by one row from state s to state n
  SELECT s, l || e AS l, n, need, 2 * length(l) + cost AS cost, a FROM ins JOIN (
    VALUES ('', 'D', '', 3, 'any', ''), ('s', 'D', 's', 3, 'any', ''), ('u', 'D', 'u', 3, 'any', ''), ('a', 'D', 'a', 3, 'any', ''),
           ('', 'R', 'u', 2, 'ok', ''), ('s', 'R', 'u', 2, 'ok', ''), ('u', 'R', 'a', 2, 'ok', ''), ('a', 'R', 'u', 2, 'ok', ''),
           ('', 'K', 's', 0, 'as', 's'), ('', 'K', 'u', 0, 'as', 'u'), ('s', 'K', 'u', 0, 'as', 'u'), ('u', 'K', 'a', 0, 'as', 'a'), ('a', 'K', 'u', 0, 'as', 'u'))
    AS e(m, e, n, cost, need, a) USING (m)),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations),
dp AS (
  SELECT c, CAST(0 AS BIGINT) AS i, '' AS s, CAST(0 AS BIGINT) AS cost, '' AS audit FROM ids
  UNION ALL
  SELECT c, i, s, b.cost, b.audit FROM (
    SELECT dp.c, f.i, way.n AS s, min({'cost': dp.cost + way.cost + CASE WHEN f.fault = 't' AND way.need <> 'any' THEN 1 ELSE 0 END, 'audit': dp.audit || way.l}) AS b
    FROM dp JOIN f ON f.c IS NOT DISTINCT FROM dp.c AND f.i = dp.i + 1 JOIN way ON way.s = dp.s
         AND (way.need = 'any' OR f.fault NOT IN ('b', 'd') AND (way.need = 'ok' OR way.a = f.a))
    GROUP BY dp.c, f.i, way.n)),
last AS (SELECT c, max(i) AS i FROM dp GROUP BY c),
best AS (
  SELECT dp.c, min({'cost': cost + 2 * length(e.l), 'audit': audit || e.l}) AS b
  FROM dp JOIN last ON last.c IS NOT DISTINCT FROM dp.c AND last.i = dp.i JOIN (VALUES ('', ''), ('s', 'II'), ('u', 'I'), ('a', '')) AS e(s, l) USING (s)
  GROUP BY dp.c),
letters AS (
  SELECT c, p, audit[p] AS e, length(replace(left(audit, p), 'I', '')) AS i, audit
  FROM (SELECT c, b.audit AS audit, unnest(range(1, length(b.audit) + 1)) AS p FROM best)),
made AS (
  SELECT letters.c, p, CASE WHEN e = 'K' THEN r ELSE NULL END AS kept, CASE WHEN e <> 'I' THEN x ELSE '' END AS x,
         row_number() OVER (PARTITION BY letters.c ORDER BY p) AS o, max(CASE WHEN e = 'K' AND a = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY letters.c) AS sys
  FROM letters LEFT JOIN f ON f.c IS NOT DISTINCT FROM letters.c AND f.i = letters.i AND e <> 'I' WHERE e <> 'D'),
body AS (
  SELECT c, string_agg(coalesce(kept, CASE WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || x, chr(10) ORDER BY o) AS body FROM made GROUP BY c),
counts AS (
  SELECT c, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT ids.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.b.cost AS cost, best.b.audit AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids JOIN best ON best.c IS NOT DISTINCT FROM ids.c LEFT JOIN counts ON counts.c IS NOT DISTINCT FROM ids.c LEFT JOIN body ON body.c IS NOT DISTINCT FROM ids.c
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired text of every damaged conversation."""
    return structure.summarise(*structure.damaged(read_table(spark, sf_dir, "conversations")))


@register("op13_prefix_trie_collapse", oracle=r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (  -- bytes of the decimal id, each followed by eight shifts
  SELECT c, list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
                                                            lambda s: [ascii(s), -1, -1, -1, -1, -1, -1, -1, -1]))) AS b
  FROM (SELECT DISTINCT c FROM t)),
ids AS (
  SELECT c, c - c % 20 AS donor,
         xor(list_reduce(list_transform(b, lambda y: CAST(y AS BIGINT)), lambda a, y:
             CASE WHEN y >= 0 THEN xor(a, y) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h
  FROM bits),
s AS (
  SELECT c, 0 AS k, i, r, x FROM ids JOIN (SELECT c AS donor, i, r, x FROM t) USING (donor) WHERE i <= h
  UNION ALL SELECT c, 1, i, r, x FROM t JOIN ids USING (c) WHERE i > h),
n AS (
  SELECT c, list(sha256(length(r) || ':' || r || x) ORDER BY k, i) AS turns,
         list(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) ORDER BY k, i) AS words FROM s GROUP BY c),
a AS (SELECT c, coalesce(turns, []) AS turns, words FROM ids LEFT JOIN n USING (c)),
p AS (
  SELECT c, d, len(turns) AS n, array_to_string(list_slice(turns, 1, d), ',') AS key,
         CASE WHEN d > 0 THEN array_to_string(list_slice(turns, 1, d - 1), ',') END AS up, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w
  FROM (SELECT c, turns, words, unnest(range(0, len(turns) + 1)) AS d FROM a)),
node AS (
  SELECT key, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256
  FROM p GROUP BY key),
kids AS (SELECT up AS key, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT t.key, CAST(sum(v.own) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves
  FROM node t JOIN node v ON starts_with(v.key, t.key) LEFT JOIN kids ON kids.key = v.key GROUP BY t.key)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children,
       n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN below USING (key) LEFT JOIN kids ON kids.key = node.key LEFT JOIN node up ON up.key = node.up
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.shared_openings(read_table(spark, sf_dir, "conversations")).drop("node", "parent")
