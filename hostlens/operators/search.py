"""Name resolution, article lookup and ranked search over landed tables
(P4, P5, J6, J7, L6, W3).

The reference calls remote services (NCBI, Wikipedia, PubMed) whose ranking
cannot be reproduced; each job here has a defined, documented order.

Skew and pair blow-up:

* equi-joins on a normalised name or token use one row per distinct key on
  the probe side, so a popular name yields one output row per matching
  taxon, never pairs of queries;
* top-k per query (``row_number() <= k``) is planned with a
  WindowGroupLimit that keeps k rows per query in each task before the
  shuffle;
* ranked search scores every document against all queries in the task that
  reads it and keeps the best k per query there, so no (query, document)
  pair table exists and only k rows per query and task are shuffled.  The
  queries travel as a broadcast, in blocks of bounded size;
* substring search draws candidates from the rarest 3-gram of each term and
  then checks the full predicate, so it is exact; terms of 1 or 2
  characters equi-join the names' 1- or 2-grams (no broadcast needed).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.text import clean_term, collapse_ws, cut, strip_ws
from hostlens.session import cut_lineage

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
NAME_CLASS_PRIORITY = {"scientific name": 1, "synonym": 2, "acronym": 3, "common name": 4}
WIKI_TRUNCATED = "... [truncated]"


def tokens(text: Column) -> Column:
    """Distinct lower-cased letter/digit runs (ARRAY<STRING>).  Splitting on
    the complement is about twice as fast as extracting the runs."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def norm_name(name: Column) -> Column:
    return F.lower(collapse_ws(name))


# -- J6 --------------------------------------------------------------------------------
def name_table(taxa: DataFrame, id_col: str, names: dict[str, Column]) -> DataFrame:
    """Long name table (tax_id, name, name_class, priority) from several name
    columns (scientific name, synonyms, acronyms, common names)."""
    parts = []
    for cls, col in names.items():
        parts.append(taxa.select(F.col(id_col).alias("tax_id"), col.alias("name"),
                                 F.lit(cls).alias("name_class"),
                                 F.lit(NAME_CLASS_PRIORITY[cls]).alias("priority")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("name").isNotNull() & (strip_ws(F.col("name")) != "")) \
        .withColumn("key", norm_name(F.col("name")))


def resolve_names(terms: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """Each query term with up to ``k`` matching taxa, best first (name
    class priority, then tax id); a term without a match is kept with NULLs
    and ``found = false``."""
    q = terms.select("term").distinct().withColumn("key", norm_name(F.col("term")))
    # one row per (key, tax_id): the best class a taxon matches the key with
    best = names.groupBy("key", "tax_id").agg(F.min(F.struct("priority", "name", "name_class")).alias("b"))
    # the rank depends on the names alone, so a key shared by millions of taxa
    # is cut to k rows (in the map tasks, too) before it meets the terms
    w = Window.partitionBy("key").orderBy(F.col("b.priority"), F.col("tax_id"))
    best = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    ranked = q.join(best, "key", "left").withColumn("rank", F.coalesce("rank", F.lit(1)).cast("bigint"))
    return ranked.select("term", "rank", "tax_id", F.col("b.name").alias("name"),
                         F.col("b.name_class").alias("name_class"),
                         F.col("tax_id").isNotNull().alias("found"))


# -- P4 / P5 -------------------------------------------------------------------------------
def _grams(s: Column, n: int = 3) -> Column:
    idx = F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(idx, lambda i: F.substring(s, i, n)))


def contains_join(terms: DataFrame, names: DataFrame, term_col: str = "term",
                  name_col: str = "name") -> DataFrame:
    """All (term, name) with lower(name) containing lower(term) as a literal
    substring.  Exact and join-based: a term of length 1 or 2 equals one of
    the name's n-grams of that length (equi-join on the n-gram); a longer
    term draws candidates from its rarest 3-gram and the predicate is then
    checked on each candidate."""
    t = terms.select(F.col(term_col).alias("term")).distinct() \
        .withColumn("t", F.lower(F.col("term")))
    nm = names.select(F.col(name_col).alias("name")).distinct() \
        .withColumn("n", F.lower(F.col("name")))

    long_t = t.filter(F.length("t") >= 3)
    tg = long_t.select("term", "t", F.explode(_grams(F.col("t"))).alias("g"))
    short = t.filter(F.length("t") < 3).select("term", F.col("t").alias("g"))
    # one posting table with the 1-, 2- and 3-grams of each name, cut to the
    # grams that some term asks for
    asked = tg.select("g").unionByName(short.select("g")).distinct()
    grams = F.array_distinct(F.concat(_grams(F.col("n"), 1), _grams(F.col("n"), 2),
                                      _grams(F.col("n"), 3)))
    posting = nm.select("name", "n", F.explode(grams).alias("g")).join(asked, "g", "left_semi")
    df = posting.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rare = (tg.join(df, "g", "left").withColumn("df", F.coalesce("df", F.lit(0)))
            .groupBy("term", "t").agg(F.min(F.struct("df", "g")).alias("r"))
            .select("term", "t", F.col("r.g").alias("g")))
    # a short term is its own gram, so one join serves both
    probe = rare.unionByName(short.withColumn("t", F.col("g")).select("term", "t", "g"))
    return probe.join(posting, "g").filter(F.col("n").contains(F.col("t"))).select("term", "name")


def name_fallback_search(terms: DataFrame, taxa: DataFrame, name_col: str,
                         id_col: str) -> DataFrame:
    """P5 in batch: taxa whose name contains the whole term; for terms with
    no such taxon, taxa whose name contains the term's first word.
    Output: term, match_level ('species' | 'genus'), tax id, name.

    Terms and first words are looked up in one pass; a term then keeps its
    best level."""
    names = taxa.select(F.col(name_col).alias("name")).filter(F.col("name").isNotNull())
    asked = terms.select("term").distinct().select(
        "term", F.explode(F.array(F.struct(F.lit(1).alias("level"), F.col("term").alias("text")),
                                  F.struct(F.lit(2).alias("level"),
                                           F.element_at(F.split(strip_ws(F.col("term")), r"(?U)\s+"), 1).alias("text")))).alias("a")) \
        .select("term", "a.level", "a.text")
    asked = cut_lineage(asked)  # read several times below
    found = contains_join(asked.select(F.col("text").alias("term")).distinct(), names).withColumnRenamed("term", "text")
    hits = asked.join(found, "text")
    best = hits.groupBy("term").agg(F.min("level").alias("level"))
    return (hits.join(best, ["term", "level"])
            .join(taxa.select(F.col(id_col).alias("tax_id"), F.col(name_col).alias("name")), "name")
            .select("term", F.when(F.col("level") == 1, "species").otherwise("genus").alias("match_level"), "tax_id", "name"))


# -- L6 --------------------------------------------------------------------------------------
# queries are scored in blocks whose texts together stay below this (one
# block's token map is broadcast; more queries mean more passes over the documents)
QUERY_BLOCK_BYTES = 32 << 20
_CELLS = 4_000_000  # scores held at once in a task


def search_topk(queries: DataFrame, q_id: str, q_text: str, docs: DataFrame, id_col: str,
                text_col: str, k: int = 5, block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """Top-k documents per query by the number of distinct shared tokens,
    ties by document id; every token counts, however common it is.

    One scan of the documents per block of queries.  A task keeps the best k
    rows of each query it has seen so far, so the shuffle carries at most
    k rows per query and task."""
    import math

    q = queries.select(F.col(q_id).cast("bigint").alias("query_id"), F.col(q_text).alias("text")) \
        .filter(F.col("query_id").isNotNull())
    size = q.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = None
    for b in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else q
        best = _score_block(part, docs, id_col, text_col, k)
        out = best if out is None else out.unionByName(best)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return (out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def _score_block(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Per task and query the best k documents: (query_id, doc_id, score)."""
    import numpy as np
    import pandas as pd

    # block_bytes of text at most
    rows = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")) \
        .groupBy("token").agg(F.collect_set("query_id").alias("ids")).collect()
    ids = np.array(sorted({i for r in rows for i in r["ids"]}), dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(
        (ids, {r["token"]: np.searchsorted(ids, np.array(r["ids"], dtype=np.int64)) for r in rows}))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries_of = shared.value
        n = len(ids)
        if not n:
            return
        # best rows so far: query index, score, document; sorted by query, score desc, document
        bq, bs, bd = (np.empty(0, dtype=np.int64) for _ in range(3))
        step = max(1, _CELLS // n)
        for batch in batches:
            batch = batch[batch["doc_id"].notna()]
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                doc = part["doc_id"].to_numpy(dtype=np.int64)
                cells = [queries_of[t] + n * i for i, found in enumerate(part["found"]) for t in (found if found is not None else ())
                         if t in queries_of]
                if not cells:
                    continue
                scores = np.bincount(np.concatenate(cells), minlength=n * len(part))
                hit = np.flatnonzero(scores)
                bq, bs, bd = (np.concatenate(x) for x in ((bq, hit % n), (bs, scores[hit]), (bd, doc[hit // n])))
                order = np.lexsort((bd, -bs, bq))
                bq, bs, bd = bq[order], bs[order], bd[order]
                keep = np.arange(len(bq)) - np.searchsorted(bq, bq) < k
                bq, bs, bd = bq[keep], bs[keep], bd[keep]
        yield pd.DataFrame({"query_id": ids[bq], "doc_id": bd, "score": bs})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), tokens(F.col(text_col)).alias("found")) \
        .mapInPandas(score, "query_id bigint, doc_id bigint, score bigint")


# -- J7 ---------------------------------------------------------------------------------------
def page_title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>(.*?)</title>", 1)


def page_text(html: Column) -> Column:
    return collapse_ws(F.regexp_replace(html, "<[^>]*>", " "))


def article_lookup(terms: DataFrame, pages: DataFrame, limit: int = 4000) -> DataFrame:
    """Exact title match on the cleaned term; else the closest page: the one
    sharing the term's rarest title token (lowest page id on ties), flagged
    ``fuzzy``.  Unmatched terms are kept with ``found = false``.  The
    extract is cut at ``limit`` characters + '... [truncated]'."""
    arts = pages.select("page_id", page_title(F.col("html")).alias("title"),
                        page_text(F.col("html")).alias("body"))
    arts = arts.withColumn("key", F.lower(collapse_ws(clean_term(F.col("title")))))
    q = terms.select("term").distinct().withColumn("key", F.lower(collapse_ws(clean_term(F.col("term")))))
    # exact: lowest page id per title key (one row per key)
    by_key = arts.groupBy("key").agg(F.min("page_id").alias("page_id"))
    exact = q.join(by_key, "key").select("term", "page_id", F.lit(False).alias("fuzzy"))
    rest = q.join(exact.select("term"), "term", "left_anti")
    # fuzzy: per title token, its document frequency and lowest page id
    tok = arts.select("page_id", F.explode(tokens(F.col("title"))).alias("token"))
    stats = tok.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("page_id").alias("first_page"))
    rt = rest.select("term", F.explode(tokens(F.col("key"))).alias("token"))
    fuzzy = (rt.join(stats, "token")
             .groupBy("term").agg(F.min(F.struct("df", "first_page")).alias("b"))
             .select("term", F.col("b.first_page").alias("page_id"), F.lit(True).alias("fuzzy")))
    hits = exact.unionByName(fuzzy)
    out = q.select("term").join(hits, "term", "left").join(arts, "page_id", "left")
    extract = cut(F.col("body"), limit, WIKI_TRUNCATED)
    return out.select("term", "page_id", "title", "fuzzy", F.col("page_id").isNotNull().alias("found"),
                      extract.alias("extract"))
