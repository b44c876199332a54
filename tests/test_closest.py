"""The closest title against the edit distance to every title."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hostlens.operators import closest as CL


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(terms, titles, most):
    out = {}
    for k in {t for t in terms if t}:
        near = [(distance(k, t), i) for i, t in titles if t and abs(len(t) - len(k)) <= most]
        near = [x for x in near if x[0] <= min(most, len(k) // CL.LETTERS_PER_EDIT)]
        if near:
            out[k] = min(near)
    return out


def damaged(r, text, edits):
    w = list(text)
    for _ in range(edits):
        at, kind = r.randrange(len(w) + 1), r.randrange(3)
        if kind == 0:
            w.insert(at, r.choice("abcz "))
        elif w and kind == 1:
            w[at % len(w)] = r.choice("abcz ")
        elif w:
            del w[at % len(w)]
    return "".join(w)


def run(spark, terms, titles, most):
    df = CL.closest(spark.createDataFrame([(t,) for t in terms], "key string"), spark.createDataFrame(titles, "id long, key string"), most)
    rows = df.collect()
    got = {r["key"]: (r["edits"], r["id"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_against_every_title(spark, most):
    r = random.Random(most)
    titles = [(i, "".join(r.choice("abc ") for _ in range(r.randrange(0, 40)))) for i in range(250)]
    titles += [(1000 + i, t) for i, (_, t) in enumerate(titles[:40])] + [(5000, None), (-3, titles[7][1])]
    terms = [damaged(r, r.choice(titles[:250])[1], r.randrange(0, 6)) for _ in range(400)] + ["", None, "a", "ab", "abc", "abcd", "e" * 300, "nothing like it"]
    assert run(spark, terms, titles, most) == brute(terms, titles, most)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=4, max_size=30), st.integers(0, 10**6))
def test_every_pair_shares_a_segment(text, seed):
    """The filter itself, in plain Python: some segment of the title survives in the term."""
    r = random.Random(seed)
    e = min(3, len(text) // CL.LETTERS_PER_EDIT)
    title = damaged(r, text, r.randrange(e + 1))
    l, n = len(title), len(text)
    if distance(text, title) > e:
        return
    base, more = divmod(l, e + 1)
    found = False
    for i in range(e + 1):
        start, size = i * base + max(0, i - (e + 1 - more)), base + (i >= e + 1 - more)
        found |= any(0 <= start + d and start + d + size <= n and text[start + d:start + d + size] == title[start:start + size]
                     for d in range(-e, e + 1) if abs(d) + abs(n - l - d) <= e)
    assert found


def test_bodies_of_hits_only(spark):
    pages = spark.createDataFrame([(1, "<title>Vaccinia virus</title><p>one  body</p>"), (2, "<title>Variola vírus</title><p>" + "x" * 50), (3, "<p>no title"), (4, None)],
                                  "page_id long, html string")
    terms = spark.createDataFrame([("vacinia virus!",), ("VARIOLA VIRUS",), ("something else",), ("",), (None,)], "term string")
    got = {r["term"]: tuple(r)[1:] for r in CL.article_closest(terms, pages, limit=20).collect()}
    assert got["vacinia virus!"] == (1, "Vaccinia virus", 1, True, "Vaccinia virus one b... [truncated]")
    assert got["VARIOLA VIRUS"][:4] == (2, "Variola vírus", 0, True)
    assert {t for t, x in got.items() if not x[3]} == {"something else", "", None}


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, html string")
    assert CL.article_closest(spark.createDataFrame([("a",)], "term string"), none).first()["found"] is False
    assert CL.article_closest(spark.createDataFrame([], "term string"), none).count() == 0
