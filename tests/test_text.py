"""Answer-text helpers run as column jobs (cases from the reference's tests)."""

from pyspark.sql import functions as F

from hostlens.functions import args as A
from hostlens.functions import text as X


def one(spark, expr, *vals, schema="t STRING"):
    df = spark.createDataFrame([vals], schema)
    return df.select(expr.alias("r")).first()["r"]


def test_snippet(spark):
    assert one(spark, X.snippet(F.col("t"), 13), "  line one\n  line two  ") == "line one line…"
    assert one(spark, X.snippet(F.col("t")), "a" * 120) == "a" * 120
    assert one(spark, X.snippet(F.col("t")), "b" * 130) == "b" * 120 + "…"


def test_title(spark):
    assert one(spark, X.title_from_text(F.col("t")), "   ") == "New conversation"
    assert one(spark, X.title_from_text(F.col("t")), "x" * 60) == "x" * 48 + "…"


def test_content_cap(spark):
    out = one(spark, X.content_cap(F.col("t"), 10), "y" * 25)
    assert out == "y" * 10 + "\n\n[...truncated — 15 chars omitted]"
    assert one(spark, X.content_cap(F.col("t"), 10), "short") == "short"


def _strip(spark, text, real):
    df = spark.createDataFrame([(text, real)], "t STRING, real ARRAY<STRING>")
    m = X.pmid_mentions(F.col("t"))
    fake = F.filter(m, lambda p: ~F.array_contains(F.col("real"), p))
    r = df.select(X.strip_pmids(F.col("t"), fake).alias("c"), fake.alias("f")).first()
    return r["c"], list(r["f"])


def test_pmid_filter(spark):
    assert _strip(spark, "See PMID: 12345678 for details.", ["12345678"]) == \
        ("See PMID: 12345678 for details.", [])
    c, f = _strip(spark, "See PMID: 99999999 for details.", ["12345678"])
    assert f == ["99999999"] and "99999999" not in c
    c, f = _strip(spark, "Real PMID 12345678 and fake PMID#87654321 (e.g., on mice) (see ) end",
                  ["12345678"])
    assert f == ["87654321"] and "12345678" in c and "87654321" not in c
    assert "(e.g." not in c and "(see" not in c and "  " not in c
    c, f = _strip(spark, "No citations\n\n\n\nhere.  ", [])
    assert f == [] and c == "No citations\n\nhere."


def test_citation_markers(spark):
    df = spark.createDataFrame([("The receptors【4†L13-L17】.",), ("a【1】 and b【2†x】 .",),
                                ("plain  text",)], "t STRING")
    rows = df.select(X.strip_citation_markers(F.col("t")).alias("c"),
                     X.citation_marker_count(F.col("t")).alias("n")).collect()
    assert (rows[0].c, rows[0].n) == ("The receptors.", 1)
    assert rows[1].n == 2 and "【" not in rows[1].c
    assert (rows[2].c, rows[2].n) == ("plain  text", 0)   # untouched when none found


def test_clean_term(spark):
    assert one(spark, X.clean_term(F.col("t")), "  SARS-CoV-2 (virus)! ") == "SARS-CoV-2 virus"
    assert one(spark, X.clean_term(F.col("t")), "Virus de l'été") == "Virus de lété"


def _args(spark, raw):
    df = spark.createDataFrame([(raw,)], "t STRING")
    m = A.with_parsed_args(df, "t", "m").first()["m"]
    return m


def test_tolerant_json(spark):
    assert _args(spark, '{"search_term": "HIV", "max_results": 5}') == \
        {"search_term": '"HIV"', "max_results": "5"}
    assert _args(spark, '{"search_term": "HIV", "max_results": 5') == \
        {"search_term": '"HIV"', "max_results": "5"}
    assert _args(spark, 'garbage text') == {"_raw": '"garbage text"'}
    assert _args(spark, '{"a": 1, "a": 2') == {"a": "2"}   # last key wins
    assert _args(spark, '{"a": [1], "b": 3, "a": {"x": 2}}') == {"a": '{"x":2}', "b": "3"}
    assert _args(spark, '{"a":1}{"b":2}') == {"a": "1", "b": "2"}   # not one object: both are recovered
    assert _args(spark, "{}") == {} and _args(spark, "[1]") == {"_raw": '"[1]"'}
    assert _args(spark, None) is None


def test_sanitize_survives_repeated_keys(spark):
    df = spark.createDataFrame([('{"sql": "a", "sql": "b", "zz": 1}',)], "t STRING")
    props, req = F.array(F.lit("sql"), F.lit("n")), F.array(F.lit("sql"))
    got = A.with_parsed_args(df, "t").select(A.sanitize_args(F.col("args"), props, req, F.create_map(F.lit("n"), F.lit("5")))).first()[0]
    assert got == {"sql": '"b"', "n": "5"}


def test_unicode_whitespace(spark):
    df = spark.createDataFrame([("\u00a0PMID:\u00a012345678 \u2003x\u00a0",)], "t STRING")
    r = df.select(X.pmid_mentions(F.col("t")).alias("p"), X.snippet(F.col("t")).alias("s"),
                  X.strip_pmids(F.col("t"), F.array(F.lit("12345678"))).alias("f")).first()
    assert r.p == ["12345678"] and r.s == "PMID: 12345678 x" and r.f == "x"


def test_search_keyword(spark):
    def kw(raw):
        df = spark.createDataFrame([(raw,)], "t STRING")
        return A.with_parsed_args(df, "t", "m").select(A.search_keyword(F.col("m"))).first()[0]
    assert kw('{"query": "q", "search_term": "  HIV   type 1 "}') == "HIV type 1"
    assert kw('{"name": "Poxviridae", "query": "x"}') == "x"
    assert kw('{"query": "' + "a" * 100 + '"}') == "a" * 80 + "…"
    assert kw('{"query": 5}') == ""
    assert kw('{"query": "   ", "name": "n"}') == "n"


def test_sanitize_args(spark):
    df = spark.createDataFrame([
        ('"HIV"', ["name"], ["name"]),
    ], "raw STRING, props ARRAY<STRING>, req ARRAY<STRING>")
    defaults = F.create_map(F.lit("preview_rows"), F.lit("50"), F.lit("wikipedia_limit"), F.lit("4000"))
    raw_only = F.create_map(F.lit("_raw"), F.col("raw"))
    got = df.select(A.sanitize_args(raw_only, F.col("props"), F.col("req"), defaults)).first()[0]
    assert got == {"name": '"HIV"'}
    df2 = spark.createDataFrame([(["sql", "preview_rows"], ["sql"])], "props ARRAY<STRING>, req ARRAY<STRING>")
    args = F.create_map(F.lit("sql"), F.lit('"SELECT 1"'), F.lit("bogus"), F.lit("1"))
    got = df2.select(A.sanitize_args(args, F.col("props"), F.col("req"), defaults)).first()[0]
    assert got == {"sql": '"SELECT 1"', "preview_rows": "50"}
    empty = spark.createDataFrame([([], [])], "props ARRAY<STRING>, req ARRAY<STRING>")
    got = empty.select(A.sanitize_args(args, F.col("props"), F.col("req"), defaults)).first()[0]
    assert got == {"sql": '"SELECT 1"', "bogus": "1"}


def test_lineage_items(spark):
    assert one(spark, X.lineage_items(F.col("t")), "Viruses; Riboviria;  ; Orthornavirae") == \
        ["Viruses", "Riboviria", "Orthornavirae"]


def test_source_links(spark):
    assert one(spark, X.wiki_url(F.col("t")), "Rabies lyssavirus") == \
        "https://en.wikipedia.org/wiki/Rabies_lyssavirus"
    assert one(spark, X.pubmed_url(F.col("t")), "123") == "https://pubmed.ncbi.nlm.nih.gov/123/"
    assert one(spark, X.pubmed_url(F.col("t")), "12a") is None
