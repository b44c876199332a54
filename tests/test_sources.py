"""File sources and sinks: CSV, dictionaries, XML, logs, report export."""

import json
import os

from pyspark.sql import functions as F

from hostlens.sources import files as SF

PUBMED = """<?xml version="1.0"?>
<PubmedArticleSet>
<PubmedArticle>
  <MedlineCitation><PMID Version="1">12345</PMID>
    <Article><Journal><Title>J Virol</Title><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue></Journal>
      <ArticleTitle>Pox in bats</ArticleTitle>
      <Abstract><AbstractText Label="BACKGROUND">First part.</AbstractText><AbstractText>Second.</AbstractText></Abstract>
      <AuthorList><Author><LastName>Smith</LastName><ForeName>Ann</ForeName></Author>
        <Author><LastName>Doe</LastName></Author><Author><ForeName>NoLast</ForeName></Author>
        <Author><LastName>Roe</LastName><ForeName>Rick</ForeName></Author>
        <Author><LastName>Poe</LastName><ForeName>Pat</ForeName></Author></AuthorList>
    </Article></MedlineCitation>
  <PubmedData><ArticleIdList><ArticleId IdType="pubmed">12345</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData>
</PubmedArticle>
<PubmedArticle><MedlineCitation><Article></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>
"""

TAXA = """<?xml version="1.0"?>
<TaxaSet>
<Taxon><TaxId>10245</TaxId><ScientificName>Orthopoxvirus</ScientificName>
  <OtherNames><Acronym>OPV</Acronym><Synonym>Pox A</Synonym><Synonym>Pox B</Synonym><CommonName>pox</CommonName></OtherNames>
  <Lineage>Viruses; Poxviridae</Lineage>
  <LineageEx><Taxon><TaxId>10239</TaxId><ScientificName>Viruses</ScientificName><Rank>superkingdom</Rank></Taxon>
    <Taxon><TaxId>10240</TaxId><ScientificName>Poxviridae</ScientificName><Rank>family</Rank></Taxon></LineageEx>
  <Division>Viruses</Division></Taxon>
<Taxon><TaxId>11676</TaxId><ScientificName>HIV-1</ScientificName><Rank>species</Rank></Taxon>
</TaxaSet>
"""


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_taxonomy_csv(spark, scratch_dir):
    p = write(os.path.join(scratch_dir, "taxo.csv"),
              "ORGANISM_NAME,SPECIES_NAME,FAMILY_NAME\nVaccinia virus,,Poxviridae\nHIV-1,Lentivirus humimdef1,\n")
    df = SF.load_taxonomy(spark, p, SF.TAXONOMY_SCHEMA)
    rows = df.orderBy("ORGANISM_NAME").collect()
    assert rows[0].ORGANISM_NAME == "HIV-1" and rows[0].FAMILY_NAME is None
    assert rows[1].SPECIES_NAME is None
    q = write(os.path.join(scratch_dir, "more.csv"),
              'TAXID,FAMILY_NAME,ORGANISM_NAME,SPECIES_NAME\n7,F,"Rabies ""x"" v","two\nlines"\n')
    r = SF.load_taxonomy(spark, q, SF.TAXONOMY_SCHEMA).first()      # by name, not by position
    assert (r.ORGANISM_NAME, r.SPECIES_NAME, r.FAMILY_NAME) == ('Rabies "x" v', "two\nlines", "F")
    assert SF.load_taxonomy(spark, q).columns == ["TAXID", "FAMILY_NAME", "ORGANISM_NAME", "SPECIES_NAME"]


def test_column_dictionaries(spark, scratch_dir):
    c = write(os.path.join(scratch_dir, "host.csv"), "column_name,description,Type\nCOUNTRY,Country,str\n")
    j = write(os.path.join(scratch_dir, "taxo.json"), json.dumps(
        {"columns": [{"name": "ORGANISM_NAME", "description": "name", "type": "str"}],
         "primary_key": "ORGANISM_NAME", "row": "one taxon"}))
    assert SF.load_column_dictionary(spark, c, "host").first().column_name == "COUNTRY"
    assert SF.load_column_dictionary(spark, j, "taxonomy").first().column_name == "ORGANISM_NAME"
    assert {r.field: r.value for r in SF.load_dictionary_document(spark, j).collect()} == {
        "primary_key": "ORGANISM_NAME", "row": "one taxon"}
    import warnings
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert SF.load_column_dictionary(spark, c + ".missing", "host").count() == 0
        assert w
    host = spark.createDataFrame([("FR", "x")], "COUNTRY STRING, OTHER STRING")
    dic = SF.load_column_dictionary(spark, c, "host")
    assert [r.column_name for r in SF.undocumented_columns(host, dic).collect()] == ["OTHER"]
    commented = SF.with_column_comments(host, {"COUNTRY": "Country"})
    assert commented.schema["COUNTRY"].metadata["comment"] == "Country"


def test_pubmed_xml(spark, scratch_dir):
    p = write(os.path.join(scratch_dir, "pubmed.xml"), PUBMED)
    rows = SF.read_pubmed_xml(spark, p).collect()
    full = [r for r in rows if r.pmid == "12345"][0]
    assert full.title == "Pox in bats" and full.abstract == "First part."
    assert full.authors == ["Ann Smith", "Doe", "Rick Roe"]
    assert (full.journal, full.year, full.doi) == ("J Virol", "2020", "10.1/x")
    assert full.url == "https://pubmed.ncbi.nlm.nih.gov/12345/"
    empty = [r for r in rows if r.pmid == "N/A"][0]
    assert (empty.title, empty.abstract, empty.journal, empty.year) == (
        SF.NO_TITLE, SF.NO_ABSTRACT, SF.UNKNOWN_JOURNAL, SF.UNKNOWN_YEAR)
    assert empty.authors == []


def test_taxon_xml_outer_records_only(spark, scratch_dir):
    p = write(os.path.join(scratch_dir, "taxa.xml"), TAXA)
    rows = {r.tax_id: r for r in SF.read_taxon_xml(spark, p).collect()}
    assert set(rows) == {"10245", "11676"}
    opv = rows["10245"]
    assert opv.rank == "no rank" and opv.division == "Viruses"
    assert opv.synonyms == ["Pox A", "Pox B", "OPV", "pox"]
    assert rows["11676"].rank == "species" and rows["11676"].synonyms == []


def test_logs_parse_and_tail(spark, scratch_dir):
    d = os.path.join(scratch_dir, "logs")
    os.makedirs(d)
    lines = [f"2026-01-02 03:04:{i % 60:02d} | INFO | TOOL_CALL #1/7 | query_host_sql | call_id={i}"
             for i in range(30)] + ["a stack trace line"]
    write(os.path.join(d, "agent_2026-01.log"), "\n".join(lines) + "\n")
    logs = SF.read_logs(spark, d)
    assert logs.filter(F.col("level").isNull()).count() == 1
    tail = [r.value for r in SF.log_tail(spark, d, "2026-01", 3).collect()]
    assert tail == lines[-3:]
    assert SF.log_tail(spark, d, "2026-01", 0).count() == 1           # clamped to 1
    write(os.path.join(d, "agent_2026-02.log"), "later\n")
    assert SF.log_tail(spark, d, "2026-01", 5).count() == 5
    files = SF.read_logs(spark, d, "2026-01").inputFiles()
    assert len(files) == 1 and files[0].endswith("agent_2026-01.log")
    ev = SF.tool_events(logs).first()
    assert (ev.marker, ev.tool) == ("TOOL_CALL", "query_host_sql")


def test_report_export(spark, scratch_dir):
    from datetime import datetime
    reports = spark.createDataFrame(
        [(1, "a@lab.org", "q", "a", '["SELECT 1"]', None, "open", datetime(2026, 1, 5, 10, 0, 0))],
        "id BIGINT, user_email STRING, question STRING, answer STRING, executed_codes STRING, "
        "recent_logs STRING, status STRING, created_at TIMESTAMP")
    out = os.path.join(scratch_dir, "export")
    SF.export_reports(reports, out)
    back = spark.read.json(out).first()
    assert back.id == 1 and back.executed_codes == ["SELECT 1"] and back.recent_logs == []
    assert back.month == "2026-01" and back.timestamp == "2026-01-05T10:00:00"


def test_author_and_synonym_lines(spark):
    df = spark.createDataFrame([(["A B", "C D"], ["s1", "s2", "s3", "s4", "s5", "s6", "s7"]), ([], [])],
                               "authors ARRAY<STRING>, syn ARRAY<STRING>")
    rows = df.select(SF.author_line(F.col("authors")).alias("a"),
                     SF.synonym_line(F.col("syn")).alias("s")).collect()
    assert rows[0].a == "A B, C D" and rows[0].s == "s1, s2, s3, s4, s5, s6"
    assert rows[1].a == "Unknown authors" and rows[1].s == ""


def test_host_scan_and_lineage_cut(spark, scratch_dir):
    from hostlens.session import cut_lineage
    from hostlens.sources.tables import host_scan
    spark.range(5).selectExpr("id AS obs", "CAST(id % 2 AS STRING) AS VIRUS_FAMILY") \
        .write.mode("overwrite").parquet(scratch_dir + "/host")
    df = host_scan(spark, scratch_dir + "/host/*.parquet", timeout_ms=1000, attempts=2)
    assert spark.sparkContext._jsc.hadoopConfiguration().get("fs.s3a.attempts.maximum") == "2"
    assert spark.sql("SELECT COUNT(*) FROM host WHERE VIRUS_FAMILY = '1'").first()[0] == 2
    cut = cut_lineage(df.filter("obs > 1"))
    assert cut.count() == 3
    assert "LogicalRDD" in cut._jdf.queryExecution().logical().toString()


def test_landing_notices_a_changed_part_file(spark, scratch_dir):
    import shutil

    from hostlens.sources.tables import RAW_TABLES, _fingerprint, land_host

    src = "/root/testdata/sf0.001"
    for t in RAW_TABLES:
        if t != "lineitem":
            shutil.copy(f"{src}/{t}.parquet", f"{scratch_dir}/{t}.parquet")
    rows = spark.read.parquet(f"{src}/lineitem.parquet")
    part = f"{scratch_dir}/lineitem.parquet/day=1"
    rows.limit(100).coalesce(1).write.parquet(part)
    before, mark = land_host(spark, scratch_dir).count(), _fingerprint(spark, scratch_dir)
    rows.limit(100).coalesce(1).write.mode("append").parquet(part)
    assert _fingerprint(spark, scratch_dir) != mark
    assert land_host(spark, scratch_dir).count() > before


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    import pytest

    from hostlens import session as S

    class Context:
        master, applicationId = "yarn", "app-x"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(Fake())


def test_host_is_built_only_for_queries_that_read_it(spark, monkeypatch):
    from hostlens.plans.registry import QUERIES, load_all
    from hostlens.sources import tables

    load_all()
    monkeypatch.setattr(tables, "_FRAMES", {})
    monkeypatch.setattr(tables, "landed_host", lambda *_: (_ for _ in ()).throw(AssertionError("host was built")))
    for key in ("report_list_by_status", "sanitize_args", "conversation_list", "name_regex_search", "fn_date", "sql_audit", "source_links"):
        QUERIES[key](spark, "/root/testdata/sf0.001")
    with __import__("pytest").raises(AssertionError, match="host was built"):
        QUERIES["join_semi"](spark, "/root/testdata/sf0.001")


def test_landing_sorts_no_more_rows_in_a_task_when_there_are_more(spark, monkeypatch, scratch_dir):
    """Its partitions go by the rows, whatever the joins are, and the settings and views are as before."""
    from hostlens.sources import tables

    tables.register_all(spark, "/root/testdata/sf0.001", land=False)
    conf = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    supplier = spark.table("supplier")._jdf.queryExecution().analyzed().toString()
    want = sorted(map(str, tables.build_host(spark).collect()))
    n = spark.table("lineitem").count()
    monkeypatch.setattr(tables, "LANDED_ROWS", n // 20)
    for most in (0, 500_000):
        monkeypatch.setattr(tables, "MOST_BROADCAST", most)
        tables._write_host(spark, f"{scratch_dir}/{most}")
        out = spark.read.parquet(f"{scratch_dir}/{most}")
        assert sorted(map(str, out.collect())) == want
        sizes = [r["count"] for r in out.groupBy("_metadata.file_path").count().collect()]
        assert len(sizes) >= 18 and max(sizes) < n // 5
    assert conf == {k: spark.conf.get(k) for k in conf}
    assert "ResolvedHint" not in spark.table("supplier")._jdf.queryExecution().analyzed().toString() and "Relation" in supplier
