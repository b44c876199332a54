"""Tool-shaped API over the Spark operators (sf0.001 stand-ins)."""

from pyspark.sql import functions as F

from hostlens import api
from hostlens.functions.wkb import st_x, st_y
from hostlens.operators.geo import sample_id
from hostlens.operators import search
from hostlens.plans.common import session
from hostlens.session import EngineSession

SF = "/root/testdata/sf0.001"


def test_sql_then_frames_then_map(spark):
    s = session(spark, SF, materialise=True)
    r = api.query_host_sql(s, "SELECT VIRUS_GENUS, COUNT(*) AS n FROM host "
                              "WHERE VIRUS_FAMILY ILIKE '%brand#1%' GROUP BY VIRUS_GENUS")
    assert r["success"] and r["artifacts"][0]["total_rows"] > 0
    assert not api.query_host_sql(s, "SELECT * FROM host")["success"]
    assert not api.query_host_sql(s, "SELECT VIRUS_GENUS FROM host WHERE VIRUS_FAMILY = 'none'")["success"]
    bar = api.create_visualization(s, lambda taxo, host: host, "bar", "VIRUS_GENUS")
    assert bar["success"] and bar["artifacts"][0]["kind"] == "bar"
    api.query_host_sql(s, "SELECT geometry, primary_id, secondary_id FROM host WHERE VIRUS_FAMILY = 'Brand#2'")
    good = api.create_map(s, lambda taxo, host: host.select(
        st_x(F.col("geometry")).alias("lon"), st_y(F.col("geometry")).alias("lat"),
        sample_id().alias("sample_id")).dropna(subset=["sample_id"]))
    assert good["success"]
    bad = api.create_map(s, lambda taxo, host: host.select(
        st_x(F.col("geometry")).alias("lon"), st_y(F.col("geometry")).alias("lat"),
        F.col("primary_id").alias("sample_id")))
    assert not bad["success"]


def test_lookup_tools(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    title = pages.select(search.page_title(F.col("html"))).first()[0]
    r = api.wikipedia_search(pages, title)
    assert r["success"] and r["artifacts"][0]["type"] == "url" and "closest" not in r["content"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "pmid")
    q = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    p = api.pubmed_search(docs, q)
    assert p["success"] and 1 <= len(p["artifacts"][0]["pmids"]) <= 5
    taxa = spark.read.parquet(f"{SF}/part.parquet")
    names = search.name_table(taxa, "p_partkey", {"scientific name": F.col("p_name")})
    n = api.ncbi_taxonomy_search(names, taxa.first()["p_name"].upper())
    assert n["success"] and n["artifacts"][0]["type"] == "ncbi_taxonomy"
    assert not api.ncbi_taxonomy_search(names, "zzz unknown")["success"]


def test_table_results(spark):
    s = EngineSession(spark, taxonomy=spark.range(120).selectExpr("id", "id % 7 AS part"))
    r = api.query_dataframe(s, lambda taxo, host: taxo, preview_rows=20)
    art = r["artifacts"][0]
    assert r["success"] and art["type"] == "table" and art["columns"] == ["id", "part"]
    assert art["total_rows"] == 120 and len(art["rows"]) == 20 and "100 further rows" in r["content"]
    for fn in (lambda taxo, host: taxo.select("nope"), lambda taxo, host: 1 / 0, lambda taxo, host: "text", lambda taxo, host: host.limit(1),
               lambda taxo, host: taxo.limit(0)):
        failed = api.query_dataframe(s, fn)
        assert not failed["success"] and failed["content"].startswith("Error") and failed["artifacts"] == []
    assert not api.query_host_sql(s, "SELECT nope FROM host")["success"]


def test_maps_and_charts_keep_every_row(spark):
    s = EngineSession(spark, taxonomy=spark.range(60_010).selectExpr("id % 180 - 0.5D AS lon", "id % 90 + 0.25D AS lat", "CAST(id AS STRING) AS sample_id"))
    m = api.create_map(s, lambda taxo, host: taxo)
    art = m["artifacts"][0]
    assert m["content"] == "Map with 60010 points." and art["total_rows"] == 60_010
    assert spark.read.parquet(art["path"]).count() == art["frame"].count() == 60_010 and len(art["rows"]) <= 50
    c = api.create_visualization(s, lambda taxo, host: taxo, "scatter", "lon", "lat")["artifacts"][0]
    assert c["total_rows"] == c["frame"].count() == 60_010
    none = api.create_map(s, lambda taxo, host: taxo.selectExpr("CAST(NULL AS DOUBLE) AS lon", "lat", "sample_id"))
    assert not none["success"] and "no point" in none["content"]


def test_lookups_show_details(spark):
    arts = spark.createDataFrame([(i, f"virus number{i}", f"T{i}", ["A B"], "J", "2001", None) for i in range(40)],
                                 "pmid BIGINT, text STRING, title STRING, authors ARRAY<STRING>, journal STRING, year STRING, doi STRING")
    r = api.pubmed_search(arts, "virus")                      # a word in every article still finds five
    assert r["artifacts"][0]["pmids"] == [0, 1, 2, 3, 4] and "T0" in r["content"] and "2001" in r["content"]
    taxa = spark.createDataFrame([(9, "Lyssavirus", "genus", "Viruses", "a; b", ["RABV"])],
                                 "tax_id BIGINT, name STRING, rank STRING, division STRING, lineage STRING, synonyms ARRAY<STRING>")
    names = search.name_table(taxa, "tax_id", {"scientific name": F.col("name")})
    t = api.ncbi_taxonomy_search(names, " lyssaVIRUS", taxa)
    assert t["success"] and "lineage: a; b" in t["content"] and "synonyms: RABV" in t["content"]


def test_chart_kinds(spark):
    s = session(spark, SF, materialise=True)
    api.query_host_sql(s, "SELECT VIRUS_GENUS, SCORE, HOST_COUNT FROM host WHERE VIRUS_FAMILY = 'Brand#3'")
    frame = lambda taxo, host: host
    pie = api.create_visualization(s, frame, "pie", "VIRUS_GENUS")
    assert pie["success"] and {"n", "share"} <= set(pie["artifacts"][0]["columns"])
    shares = [r["share"] for r in pie["artifacts"][0]["rows"]]
    assert abs(sum(shares) - 1.0) < 1e-5
    hist = api.create_visualization(s, frame, "histogram", "SCORE")
    assert hist["success"] and sum(r["n"] for r in hist["artifacts"][0]["rows"]) == \
        s.df_host.filter("SCORE IS NOT NULL").count()
    sc = api.create_visualization(s, frame, "scatter", "SCORE", "HOST_COUNT")
    assert sc["success"] and sc["artifacts"][0]["columns"] == ["SCORE", "HOST_COUNT"]
    assert not api.create_visualization(s, frame, "sunburst", "SCORE")["success"]
    empty = api.create_visualization(s, lambda taxo, host: host.selectExpr("CAST(NULL AS DOUBLE) AS x"),
                                     "scatter", "x", "x")
    assert not empty["success"]


def test_callables_run_once(spark, scratch_dir):
    """Gates, preview and artifact read one copy; a refused frame leaves nothing behind."""
    import os

    s = EngineSession(spark, taxonomy=spark.range(500).repartition(3).selectExpr("id % 50 - 0.5D AS lon", "id % 40 + 0.25D AS lat", "CAST(id AS STRING) AS sample_id", "rand() AS r"))
    art = api.create_map(s, lambda taxo, host: taxo.limit(40))["artifacts"][0]
    assert sorted(r["sample_id"] for r in art["rows"]) == sorted(r["sample_id"] for r in art["frame"].collect())
    seen, stage = [], s.stage
    s.stage = lambda df: seen.append(stage(df)) or seen[-1]
    bad = api.create_map(s, lambda taxo, host: taxo.selectExpr("lon", "lat", "CAST(NULL AS STRING) AS sample_id"))
    chart = api.create_visualization(s, lambda taxo, host: taxo, "histogram", "r")
    assert not bad["success"] and chart["success"] and len(seen) == 3
    there = [os.path.exists(p.removeprefix("file:")) for _, p in seen]
    assert there == [False, False, True]


def test_typo_finds_the_page_and_index_ranks(spark, scratch_dir):
    from hostlens.operators import article_index

    pages = spark.createDataFrame([(1, "<title>Vaccinia virus</title><p>body one"), (2, "<title>Cowpox</title><p>virus two")], "page_id long, html string")
    r = api.wikipedia_search(pages, "vacinia virus")
    assert r["success"] and "Vaccinia_virus" in r["content"] and "closest" in r["content"]
    assert "closest" not in api.wikipedia_search(pages, "cowpox")["content"]
    assert "Vaccinia" in api.wikipedia_search(pages, "virus of some sort")["content"]
    arts = spark.createDataFrame([(i, "virus " * (1 + i % 3) + ("rabies" if i == 7 else "x")) for i in range(30)], "pmid BIGINT, text STRING")
    article_index.build_index(arts, "pmid", "text", scratch_dir + "/ix")
    found = api.pubmed_search(arts, "rabies virus", 3, index=scratch_dir + "/ix")
    assert found["success"] and found["artifacts"][0]["pmids"][0] == 7 and len(found["artifacts"][0]["pmids"]) == 3
