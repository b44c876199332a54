"""A stored inverted index over articles and exact BM25 top-k with block pruning.

The index is three Parquet tables below one path:

* ``postings``, partitioned by token bucket: a row is a block of at most
  ``BLOCK`` postings of one token in id order, with the largest BM25 term (without
  idf) of the block.  Blocks come from a range sort on (token, id), so the
  postings of a common token are built by many tasks;
* ``terms``, partitioned by the same buckets: documents and largest term per token;
* ``meta``, one row: number and average length of documents, and the quantiles of
  the ids that cut them into segments.

A search opens only the buckets of its tokens.  It first scores the best blocks
of each query's strongest tokens; the k-th score found is a lower bound of the
final k-th score.  Tokens whose largest terms together stay below the bound
cannot bring a document in alone, so their postings are not read for
candidates, and of the other tokens only blocks that can reach the bound are.
Candidates that can still reach it get their whole score, from the one
block per token that can hold their id.  A pruned document cannot be in the top
k, so the result is that of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlens.operators.search import tokens
from hostlens.session import cut_lineage

K1, B = 1.2, 0.75
BLOCK = 128
BUCKETS = 64
SEED_TOKENS, SEED_BLOCKS = 4, 8
DIGITS = 6                      # scores are rounded to this, ties go to the lower id
_SLACK = 10.0 ** -DIGITS * 2
_POSTINGS = ("token string, first_id bigint, last_id bigint, first_segment int, last_segment int, "
             "ids array<bigint>, terms array<double>, top double")
_TERMS = "token string, df bigint, top double"


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _counted(rows: DataFrame) -> DataFrame:
    """token, id, tf, len: one row per row of ``rows`` (id, words) and token.

    The words of a text are sorted and counted by runs inside its row, so nothing is
    shuffled for it and no batch of whole texts goes to Python."""
    words = rows.select("id", F.sort_array("words").alias("w"))
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    runs = words.where(F.size("w") > 0).withColumn("starts", starts).withColumn("len", F.size("w").cast("bigint"))
    entries = F.transform("starts", lambda start, at: F.struct(
        F.get("w", start).alias("token"), (F.coalesce(F.get("starts", at + 1), F.size("w")) - start).cast("bigint").alias("tf")))
    # the arrays themselves must not go along with every word
    return runs.select("id", "len", F.explode(entries).alias("e")).select("e.token", "id", "e.tf", "len")


def _blocks(average: float, edges: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of postings (token, id, tf, len) sorted by token and id."""
        rest, cuts = None, np.array(edges, dtype=np.int64)

        def cut(p: pd.DataFrame) -> pd.DataFrame:
            token, ids, tf, size = p["token"].to_numpy(dtype=object), p["id"].to_numpy(), p["tf"].to_numpy(), p["len"].to_numpy()
            term = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))
            new = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            ends = np.r_[new[1:], len(p)]
            starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(new, ends)])
            stops = np.r_[starts[1:], len(p)]
            return pd.DataFrame({
                "token": token[starts], "first_id": ids[starts], "last_id": ids[stops - 1],
                "first_segment": np.searchsorted(cuts, ids[starts], side="right"), "last_segment": np.searchsorted(cuts, ids[stops - 1], side="right"),
                "ids": [ids[a:b] for a, b in zip(starts, stops)], "terms": [term[a:b] for a, b in zip(starts, stops)],
                "top": np.maximum.reduceat(term, starts)})

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            # the last block of a batch may go on in the next one
            same = (b["token"] == b["token"].iloc[-1]).to_numpy()
            keep = len(b) - int(same.sum()) + int(same.sum()) // BLOCK * BLOCK
            if keep:
                yield cut(b.iloc[:keep])
            rest = b.iloc[keep:]
        if rest is not None and len(rest):
            yield cut(rest)
    return run


def build_index(docs: DataFrame, id_col: str, text_col: str, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``docs`` below ``path``.

    Ids are integers; rows without one are left out, a null text has no words,
    an id must occur once.  Tokens are lower-cased runs of letters and digits."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"),
                       F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("words")).where("id IS NOT NULL")
    n, average = rows.agg(F.count("*"), F.avg(F.size("words"))).first()
    segments = min(4096, max(16, n // 100_000))
    edges = sorted({int(c) for c in rows.select(F.col("id").cast("double")).approxQuantile("id", [i / segments for i in range(1, segments)], 0.25 / segments)}) if n else []
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = ["bucket", "token", "id"]
    postings = (_counted(rows).withColumn("bucket", _bucket(F.col("token"), buckets))
                .repartitionByRange(width, *sort).sortWithinPartitions(*sort))
    (postings.select("token", "id", "tf", "len").mapInPandas(
        _blocks(float(average or 1.0), edges), _POSTINGS)
     .withColumn("bucket", _bucket(F.col("token"), buckets)).write.partitionBy("bucket").parquet(f"{path}/postings"))
    (spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{path}/postings").groupBy("bucket", "token").agg(
        F.sum(F.size("ids")).alias("df"), F.max("top").alias("top")).write.partitionBy("bucket").parquet(f"{path}/terms"))
    spark.createDataFrame([(n, float(average or 0.0), buckets, edges)], "n bigint, average double, buckets int, edges array<bigint>") \
        .coalesce(1).write.parquet(f"{path}/meta")


def asked_blocks(spark: SparkSession, path: str, asked: list[int]) -> DataFrame:
    """Postings of some buckets; the others are not opened."""
    return spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{path}/postings").where(F.col("bucket").isin(asked))


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """The k-th score of each query, less what rounding may move: query_id and bound."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    return scores.select("query_id", "score").withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select(
        "query_id", (F.col("score") - _SLACK).alias("bound"))


def _candidates(words: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id and doc_id of documents that can reach the bound of the query.

    Only tokens that matter are read, and only blocks that can reach the bound: a document
    with a posting in another block of such a token cannot.  So one that can has
    all its postings of these tokens here, and the other tokens add ``outside`` at most."""
    read = words.where("below >= bound").join(blocks, "token").where(
        F.col("idf") * F.col("top") + F.col("total") - F.col("most") >= F.col("bound"))
    seen = cut_lineage(
        read.select("query_id", "idf", F.explode(F.arrays_zip("ids", "terms")).alias("p"))
        .groupBy("query_id", F.col("p.ids").alias("doc_id")).agg(F.sum(F.col("idf") * F.col("p.terms")).alias("score")))
    outside = words.where("below < bound").groupBy("query_id").agg(F.sum("most").alias("outside"))
    return (seen.join(_kth(seen, k), "query_id", "left").join(outside, "query_id", "left")
            .where("bound IS NULL OR score + coalesce(outside, 0) >= bound").select("query_id", "doc_id"))


def search_index(queries: DataFrame, q_id: str, q_text: str, path: str, k: int = 5) -> DataFrame:
    """The k best documents of every query by BM25 over its distinct tokens:
    query_id, doc_id, score, rank.  Equal (rounded) scores go by document id;
    documents that share no token are no match."""
    spark = queries.sparkSession
    meta = spark.read.parquet(f"{path}/meta").first()
    empty = "query_id bigint, doc_id bigint, score double, rank bigint"
    if not meta["n"]:
        return spark.createDataFrame([], empty)
    words = queries.select(F.col(q_id).cast("bigint").alias("query_id"), F.explode(tokens(F.col(q_text))).alias("token")).where("query_id IS NOT NULL") \
        .distinct().withColumn("bucket", _bucket(F.col("token"), meta["buckets"]))
    words = cut_lineage(words)
    asked = sorted(r[0] for r in words.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    idf = F.log1p((F.lit(float(meta["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = spark.read.schema(f"{_TERMS}, bucket int").parquet(f"{path}/terms").where(F.col("bucket").isin(asked)).select("token", idf.alias("idf"), "top")
    per_query = Window.partitionBy("query_id")  # the tokens of one query
    words = cut_lineage(words.join(known, "token").select("query_id", "token", "idf", (F.col("idf") * F.col("top")).alias("most")).withColumns({
        "total": F.sum("most").over(per_query),
        "below": F.sum("most").over(per_query.orderBy("most", "token")),
        "place": F.row_number().over(per_query.orderBy(F.desc("most"), "token"))}))
    blocks = asked_blocks(spark, path, asked)

    # a lower bound of every query's k-th score, from the best blocks of its strongest tokens
    seeds = words.where(F.col("place") <= SEED_TOKENS)
    best = blocks.join(seeds.select("token").distinct(), "token", "left_semi").withColumn(
        "place", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("top"), "first_id"))).where(F.col("place") <= SEED_BLOCKS)
    postings = best.select("token", F.explode(F.arrays_zip("ids", "terms")).alias("p")).select("token", F.col("p.ids").alias("doc_id"), F.col("p.terms").alias("term"))
    found = seeds.join(postings, "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("term")).alias("score"))
    words = cut_lineage(words.join(_kth(found, k), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))))

    edges = np.array(meta["edges"], dtype=np.int64)

    @F.pandas_udf("int")
    def segment(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right").astype(np.int32))

    # the whole scores of the documents that can reach it
    candidates = _candidates(words, blocks, k).withColumn("segment", segment("doc_id"))
    held = blocks.join(words.select("token").distinct(), "token", "left_semi").withColumn(
        "segment", F.explode(F.sequence("first_segment", "last_segment")))
    pairs = candidates.join(words.select("query_id", "token", "idf"), "query_id").join(held, ["token", "segment"]).where(
        F.col("doc_id").between(F.col("first_id"), F.col("last_id")))
    at = F.array_position("ids", F.col("doc_id")).cast("int")
    scored = pairs.where(at > 0).select("query_id", "doc_id", (F.col("idf") * F.element_at("terms", at)).alias("part")) \
        .groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    rank = F.row_number().over(per_query.orderBy(F.desc("score"), "doc_id")).cast("bigint")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
