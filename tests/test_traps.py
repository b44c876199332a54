"""One adversarial case per trap listed in SURVEY §7.4."""

import pytest
from pyspark.sql import functions as F

from hostlens.functions.text import clean_term
from hostlens.operators import frames
from hostlens.operators.tables import user_search


@pytest.fixture()
def t(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), (None, 4)], "k STRING, v INT")
    df.createOrReplaceTempView("trap")
    return df


def test_null_order_is_explicit(spark, t):
    first = [r.k for r in spark.sql("SELECT k FROM trap ORDER BY k").collect()]
    assert first[:2] == [None, None]                        # Spark: NULLs first ascending
    last = [r.k for r in spark.sql("SELECT k FROM trap ORDER BY k NULLS LAST").collect()]
    assert last[-2:] == [None, None]                        # the DuckDB default, stated


def test_null_groups_kept_by_sql_dropped_by_size(spark, t):
    kept = {r.k: r.n for r in frames.group_count(t, "k").collect()}
    assert kept[None] == 2
    dropped = [r.k for r in frames.group_size(t, "k").collect()]
    assert dropped == ["a", "b"]                            # sorted, NULL key gone


def test_ilike_escape_and_literal_search(spark):
    df = spark.createDataFrame([("100%_pure",), ("100x pure",)], "s STRING")
    assert df.filter(F.col("s").ilike("100\\%\\_%")).count() == 1   # backslash escapes in Spark
    users = spark.createDataFrame([("a%b@lab.org", "x", "y"), ("ab@lab.org", "x", "y")],
                                  "email STRING, first_name STRING, last_name STRING")
    assert user_search(users, "A%B").count() == 1          # literal, not a pattern


def test_try_cast_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert spark.sql("SELECT TRY_CAST('12x' AS INT) AS v").first().v is None
    with pytest.raises(Exception):
        spark.sql("SELECT CAST('12x' AS INT) AS v").collect()


def test_unicode_word_class(spark):
    df = spark.createDataFrame([("Virus été—ü?",)], "s STRING")
    assert df.select(clean_term(F.col("s"))).first()[0] == "Virus étéü"


def test_distinct_count_exact_and_approx(spark):
    df = spark.range(2000).selectExpr("id % 2 AS k", "id % 500 AS v")
    exact = {r.k: r.n for r in frames.distinct_count(df, "k", "v", "n").collect()}
    assert exact == {0: 250, 1: 250}
    approx = {r.k: r.n for r in frames.distinct_count(df, "k", "v", "n", approx_rsd=0.02).collect()}
    assert all(abs(approx[k] - 250) <= 25 for k in (0, 1))
