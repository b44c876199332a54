"""Pipeline stages: (spark, docs, sf_dir) -> DataFrame.  All but the last return
the columns of ``docs`` unchanged, whatever they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm import chosen_path, hilbert, langmix, raking, winnow
from hostlens.llm.common import fold, read_table

MAIN_SHARE = 1 / 3     # of a document that its main language explains at least


def _unused(docs: DataFrame, name: str) -> str:
    have = {c.lower() for c in docs.columns}
    while name in have:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or no language
    that explains a third of it.  Learns from the ``lang`` column of three of
    four folds.  A table in which no language can be learnt passes whole
    except for texts without letters."""
    model = langmix.learn(docs, fold("doc_id", 4) != 2)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    p = _unused(docs, "p")
    return docs.withColumn(p, langmix.predict(model, F.col("text"), spark)).where(
        (F.col(f"{p}.lang") != "und") & (F.col(f"{p}.score") >= MAIN_SHARE)).drop(p)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of every near-duplicate component
    (five-word shingles, similarity 0.8 or more).  Rows of equal doc_id are one
    document and one of them stays; rows without doc_id all stay."""
    out = chosen_path.near_duplicates(docs, shingle=5)
    gone = out.where(~F.col("kept")).select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return rest
    return rest.join(twice, "doc_id", "left_anti").unionByName(
        rest.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    A null or empty text has no words and stays; every row is judged by itself, so repeated
    rows and ids, and null ids, share one fate.  Texts are read whole.  An empty table or
    benchmark drops nothing; other columns, whatever their names, are only carried."""
    out = winnow.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), carry=True)
    return out.where(~F.col("contaminated")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards the default source, language and topic targets.

    A null source or language is the empty one, a null text has no tokens; whether a row
    stays depends on its id and its cell, so rows of one id and cell stay or go together.  An
    empty table stays empty; other columns, whatever their names, are only carried."""
    out = raking.mix(docs, carry=True)
    return out.where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document and its slot there, in Hilbert order of the metadata.

    All rows stay, repeated ones with slots of their own; nulls, ids of any type and ties as in
    ``hilbert.hilbert_shards``.  Of clashing names the added columns win.  An empty table stays empty."""
    return hilbert.hilbert_shards(docs, carry=True)
