"""Plan regressions: filters reach the scan, top-k is pre-limited before the
shuffle, no row-at-a-time Python and no cartesian product in any query."""

import pytest

from hostlens.plans.registry import QUERIES, load_all

SF = "/root/testdata/sf0.001"
load_all()
# vectorised batches: WKB coordinates, scoring with a top-k kept inside the task, segments of candidates, Python's regular expressions
ARROW = {"point_coordinates", "map_points", "map_points_sql", "article_topk", "article_topk_index", "name_regex_search"}


def plan(spark, key):
    return QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_pushed_to_scan(spark):
    p = plan(spark, "predicate_filter")
    assert "PushedFilters: [IsNotNull(DISEASE_STATUS), EqualTo(DISEASE_STATUS,R)" in p


def test_projection_pruned(spark):
    p = plan(spark, "host_scan_projection")
    schema = p[p.index("ReadSchema: "):].split("\n")[0]
    assert "geometry" not in schema and "SCORE" not in schema


def test_top_k_is_limited_before_shuffle(spark):
    for key in ("context_window", "article_topk", "resolve_names"):
        assert "WindowGroupLimit" in plan(spark, key), key


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_rows_no_cartesian_no_funnel(spark, key):
    p = plan(spark, key)
    for bad in ("BatchEvalPython", "CartesianProduct", *(() if key in ARROW else ("ArrowEvalPython", "MapInPandas"))):
        assert bad not in p
    lines = p.split("\n")
    for above, below in zip(lines, lines[1:]):
        assert not ("SinglePartition" in above and "LocalLimit" in below and "isEmpty" not in p) or key in LIMITS


LIMITS = {"limit_topn", "frame_nlargest"}  # where a limit is the feature


def test_ranks_do_not_depend_on_exchange_reuse(spark):
    from hostlens.operators.ordering import global_rank

    df = spark.range(500).selectExpr("id", "id % 7 AS g", "repeat('x', 20) AS payload")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = global_rank(df, [("g", False), "id"], num_partitions=16).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert [(r["g"], r["id"]) for r in sorted(rows, key=lambda r: r["rank"])] == sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
    assert sorted(r["rank"] for r in rows) == list(range(1, 501))


def test_name_search_shuffles(spark):
    assert plan(spark, "name_fallback_search").count("Exchange hashpartitioning") <= 26
