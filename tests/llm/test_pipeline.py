import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hostlens.llm import chosen_path, hilbert, langmix, queries, raking, stages, winnow

from .conftest import AWKWARD, SF, docs_of, prose

SF01 = SF.replace("0.001", "0.01")


def test_registered():
    qs = entry.queries()
    assert {f"op{i}" for i in range(1, 11)} == {k.split("_")[0] for k in qs if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in qs and set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF01).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_run_equals_its_stages(spark, scratch_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r[0] for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(f"{scratch_dir}/{name}")
        docs = spark.read.parquet(f"{scratch_dir}/{name}")
        ids = [r[0] for r in docs.select("doc_id").collect()]
        assert set(ids) <= before and len(ids) == len(set(ids))
        if name != "shard":
            assert docs.columns == columns
    out = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.select(out.columns).collect()))


def test_stages_take_effect(spark):
    copy = prose(50, 200, 3000)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()[2]["text"]
    rows = [(i, prose(i, 80, 3000)) for i in range(30)] + [(100, copy), (101, copy), (102, copy + " end"), (200, f"{prose(60, 30)} {item} {prose(61, 30)}"),
                                                           (300, "12 34 --"), (301, None), (302, "")]
    docs = docs_of(spark, rows, clash=True)
    all_ids = {r[0] for r in rows}
    gone = {"language_id": {300, 301, 302}, "near_dedup": {101, 102}, "decontaminate": {200}, "shard": set()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        ids = {r["doc_id"] for r in out.collect()}
        assert ids == all_ids - gone[name] if name in gone else ids <= all_ids
        assert name == "shard" or out.columns == docs.columns


def test_stages_on_awkward_and_empty_tables(spark, awkward, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
        rows = stage(spark, awkward, SF).collect()
        assert len(rows) == len(AWKWARD) if name in ("decontaminate", "shard") else 0 < len(rows) <= len(AWKWARD)
        if name == "near_dedup":
            assert [sum(r["doc_id"] == i for r in rows) for i in (1, 2, None)] == [1, 0, 2]


def test_stages_use_the_operators():
    assert {m.__name__.rsplit(".", 1)[1] for m in (langmix, chosen_path, winnow, raking, hilbert)} <= set(vars(stages))
