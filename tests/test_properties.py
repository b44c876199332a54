"""Property tests: the skew-safe operators equal brute force on random input."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hostlens.operators import search as S
from hostlens.operators.ordering import global_rank

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5)), min_size=1, max_size=60))
def test_global_rank_is_a_sort(spark, rows):
    data = [(i, g, v) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id BIGINT, g BIGINT, v BIGINT")
    got = {r.id: r["rank"] for r in global_rank(df, ["g", ("v", False), "id"]).collect()}
    expect = sorted(data, key=lambda r: (r[1], -r[2], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(expect)}


words = st.text(alphabet="abcRé ", min_size=1, max_size=8)


@SETTINGS
@given(st.lists(words, min_size=1, max_size=12), st.lists(words, min_size=1, max_size=12))
def test_contains_join_is_substring_match(spark, terms, names):
    t = spark.createDataFrame([(x,) for x in terms], "term STRING")
    n = spark.createDataFrame([(x,) for x in names], "name STRING")
    got = {(r.term, r.name) for r in S.contains_join(t, n).collect()}
    assert got == {(a, b) for a in set(terms) for b in set(names) if a.lower() in b.lower()}
