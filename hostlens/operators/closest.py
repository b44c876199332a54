"""The closest title within a few edits, by a partition filter on edit distance.

A text within e edits of another holds at least one of that one's e + 1
segments unchanged, shifted by no more than the edits allow.  So titles are cut into
segments, terms into the substrings that can equal one of them, and an equi-join on
(edits, title length, segment number, text) finds every pair worth comparing.
How many edits a term may have follows from its length, so each title is cut
for the one or two numbers of edits that terms of about its length have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.text import clean_term, collapse_ws, cut
from hostlens.operators.search import WIKI_TRUNCATED, page_text, page_title

MAX_EDITS = 3
LETTERS_PER_EDIT = 4
# Latin letters with marks and their plain ones
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿß"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyys"


def title_key(title: Column) -> Column:
    """What is compared of a title: cleaned, lower-cased, letters without their marks."""
    return F.translate(F.lower(collapse_ws(clean_term(title))), MARKED, PLAIN)


def allowed_edits(length: str, most: int = MAX_EDITS) -> str:
    """SQL: the edits that a term of some length may have."""
    return f"least({most}, int({length} div {LETTERS_PER_EDIT}))"


# segment i of a title of length l cut into e + 1: the last l mod (e + 1) are one longer
_START = "int(i * (l div (e + 1)) + greatest(0, i - (e + 1 - l % (e + 1))))"
_SIZE = "int(l div (e + 1) + IF(i >= e + 1 - l % (e + 1), 1, 0))"


def closest(terms: DataFrame, titles: DataFrame, most: int = MAX_EDITS) -> DataFrame:
    """For each distinct key of ``terms`` (key) the title (id, key) with the least edit
    distance that its length allows, the lowest id of equals: key, id, edits.

    Keys without such a title are left out; null and empty keys match nothing."""
    t = titles.where("key <> ''").groupBy("key").agg(F.min("id").alias("id")).withColumn("l", F.length("key"))
    q = terms.select("key").where("key <> ''").distinct().withColumn("n", F.length("key")).withColumn("e", F.expr(allowed_edits("n", most)))
    per = LETTERS_PER_EDIT
    segments = (t.withColumn("e", F.explode(F.expr(
        f"filter(sequence(1, {most}), e -> l >= {per - 1} * e AND (e = {most} OR l <= {per + 1} * e + {per - 1}))")))
        .withColumn("i", F.explode(F.expr("sequence(0, e)")))
        .select("e", "l", "i", F.expr(f"substring(key, {_START} + 1, {_SIZE})").alias("text"), F.col("key").alias("title"), "id"))
    parts = (q.where("e > 0").withColumn("l", F.explode(F.expr("sequence(n - e, n + e)")))
             .withColumn("i", F.explode(F.expr("sequence(0, e)")))
             .withColumn("at", F.explode(F.expr(f"filter(transform(sequence(-e, e), d -> IF(abs(d) + abs(n - l - d) <= e, {_START} + d, -1)), "
                                                f"p -> p >= 0 AND p + {_SIZE} <= n)")))
             .select("key", "e", "l", "i", F.expr(f"substring(key, at + 1, {_SIZE})").alias("text")).distinct())
    near = parts.join(segments, ["e", "l", "i", "text"]).select("key", "id", F.expr("levenshtein(key, title, e)").alias("edits")).where("edits >= 0")
    same = q.join(t.select("key", "id"), "key").select("key", "id", F.lit(0).alias("edits"))
    return same.unionByName(near).groupBy("key").agg(F.min(F.struct("edits", "id")).alias("x")).select("key", "x.id", "x.edits")


def article_closest(terms: DataFrame, pages: DataFrame, limit: int = 4000, most: int = MAX_EDITS) -> DataFrame:
    """Each term with the page of the closest title: term, page_id, title, edits, found, extract.

    Titles are compared as in ``closest``; terms without one are kept with
    ``found`` false.  Pages are read twice: their titles, then the bodies of those found only."""
    titles = pages.select(F.col("page_id").alias("id"), title_key(page_title(F.col("html"))).alias("key"))
    q = terms.select("term").distinct().withColumn("key", title_key(F.col("term")))
    hits = q.join(closest(q, titles, most), "key", "left").select("term", F.col("id").alias("page_id"), F.col("edits").cast("bigint").alias("edits"))
    asked = hits.where("page_id IS NOT NULL").select("page_id").distinct()
    bodies = pages.join(asked, "page_id", "left_semi").select(
        "page_id", page_title(F.col("html")).alias("title"), cut(page_text(F.col("html")), limit, WIKI_TRUNCATED).alias("extract"))
    return hits.join(bodies, "page_id", "left").select("term", "page_id", "title", "edits", F.col("page_id").isNotNull().alias("found"), "extract")
