"""Text and argument helpers on generated inputs, against plain Python definitions."""

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hostlens.functions import args as A
from hostlens.functions import text as X

WORDS = st.lists(st.sampled_from(["bat", "pox", "gene", "42", "ß", "clade IIb", "  ", "\t", "\n", " ", "…", "-"]), max_size=40).map("".join)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def squeezed(s, n):
    s = " ".join(s.split())
    return s if len(s) <= n else s[:n] + "…"


@SETTINGS
@given(st.lists(st.tuples(WORDS, st.integers(1, 60)), min_size=1, max_size=12))
def test_snippet_is_a_squeezed_prefix(spark, rows):
    for n in {n for _, n in rows}:
        texts = [t for t, m in rows if m == n]
        df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
        got = {r.i: r.s for r in df.select("i", X.snippet(F.col("t"), n).alias("s")).collect()}
        assert [got[i] for i in range(len(texts))] == [squeezed(t, n) for t in texts]


@SETTINGS
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=6), min_size=1, max_size=10))
def test_only_unknown_citations_go(spark, picks):
    ids = [70_001 + 13 * i for i in range(7)]
    real = [str(i) for i in ids[::2]]
    texts = ["Claim " + ", ".join(f"{('PMID', 'pmid', 'PMID:')[k % 3]} {ids[k]}" for k in p) for p in picks]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    fake = F.filter(X.pmid_mentions(F.col("t")), lambda p: ~p.isin(real))
    for r in df.select("i", X.strip_pmids(F.col("t"), fake).alias("c"), fake.alias("gone")).collect():
        cited = [str(ids[k]) for k in picks[r.i]]
        assert list(r.gone) == [c for c in cited if c not in real]
        assert re.findall(r"\d{5,}", r.c) == [c for c in cited if c in real]


def test_citation_markers(spark):
    texts = {"Bats host it【a】【b】 , they say 【c†x】 .": ("Bats host it, they say.", 3), "plain  text": ("plain  text", 0), "【】": ("", 1), "half 【open": ("half 【open", 0)}
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = {r.t: (r.c, r.n) for r in df.select("t", X.strip_citation_markers(F.col("t")).alias("c"), X.citation_marker_count(F.col("t")).alias("n")).collect()}
    assert got == texts


VALUES = st.one_of(st.text("ab  \\\"{}:,é", max_size=90), st.integers(-9, 99), st.none(), st.booleans(), st.lists(st.integers(0, 3), max_size=2))
OBJECTS = st.dictionaries(st.sampled_from([*A.KEYWORD_KEYS, "sql", "n"]), VALUES, max_size=4)


def keyword(args):
    for k in A.KEYWORD_KEYS:
        if isinstance(args.get(k), str) and (s := squeezed(args[k], A.KEYWORD_LEN)):
            return s
    return ""


@SETTINGS
@given(st.lists(OBJECTS, min_size=1, max_size=15))
def test_valid_objects_and_keywords(spark, objects):
    df = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "i INT, raw STRING")
    for r in A.with_parsed_args(df, "raw").select("i", "args", A.search_keyword(F.col("args")).alias("k")).collect():
        assert {k: json.loads(v) for k, v in r.args.items()} == objects[r.i]
        assert r.k == keyword(objects[r.i])


def test_broken_objects_give_their_pairs(spark):
    cases = {'{"name": "Lyssa", "n": 3': {"name": "Lyssa", "n": 3}, "no pairs in here": {"_raw": "no pairs in here"},
             'x {"n": 1.5} {"n": null} y "ok": true': {"n": None, "ok": True}, "": {"_raw": ""}}
    df = spark.createDataFrame([(c,) for c in cases], "raw STRING")
    assert {r.raw: {k: json.loads(v) for k, v in r.args.items()} for r in A.with_parsed_args(df, "raw").collect()} == cases
