import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from hostlens.llm import backoff_lm, queries

from .conftest import AWKWARD, SF, docs_of, prose

START, END = object(), object()


def tokens(text):
    return (text or "").encode().lower().split() + [END]


class Plain:
    """The same model from the text-book formulas, word by word."""

    def __init__(self, texts, prior):
        self.prior = prior
        self.c, self.b = collections.Counter(), collections.Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            self.b.update(zip([START, *w], w))
        self.n, self.v = sum(self.c.values()), len(self.c)

    def p1(self, w):
        return (self.c[w] + 1) / (self.n + self.v + 1)

    def p(self, h, w):
        c = self.c[END] if h is START else self.c[h]
        return (self.b[h, w] + self.prior * self.p1(w)) / (c + self.prior) if c else self.p1(w)

    def check_prior(self):
        """Failure arcs take as many training tokens as there are training bigrams that occur once."""
        if not self.n:
            assert self.prior == 1
            return
        new = sum(x == 1 for x in self.b.values())
        taken = sum(x * self.prior / (x + self.prior) for x in self.c.values())
        assert taken == pytest.approx(new, rel=0.05) or self.prior > 9e5 or self.prior < 2e-3

    def row(self, text):
        w = tokens(text)
        return (len(w), sum(self.c[x] > 0 for x in w), self.n, sum(math.log10(self.p1(x)) for x in w),
                sum(math.log10(self.p(h, x)) for h, x in zip([START, *w], w)))


def check(rows, docs, folds=7, held=2):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % folds
    (prior,) = {r["prior"] for r in rows}
    m = Plain([t for i, t in docs if fold(i) != held], prior)
    m.check_prior()
    want = sorted([(i, fold(i) == held, *m.row(t)) for i, t in docs], key=str)
    got = sorted([tuple(r)[:-1] for r in rows], key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_query_over_whole_table(spark):
    check(queries.op5(spark, SF).collect(), [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_many_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_TOKENS", 300)
    docs = [(i, prose(i, 20 + i, 50)) for i in range(60)]
    train = queries.fold("doc_id", 7) != 2
    check(backoff_lm.score(docs_of(spark, docs), train).collect(), docs)


def test_distribution_sums_to_one():
    m = Plain([prose(i, 30, 8) for i in range(5)], 7.5)
    for h in {START, *m.c} - {END}:  # nothing follows the end
        assert sum(m.p(h, w) for w in m.c) + m.p(h, b"?") == pytest.approx(1)


def test_awkward_rows(awkward, no_docs):
    train = queries.fold("doc_id", 7) != 2
    check(backoff_lm.score(awkward, train).collect(), [r[:2] for r in AWKWARD])
    assert backoff_lm.score(no_docs, train).count() == 0
    nothing = backoff_lm.score(awkward, F.lit(None).cast("boolean")).collect()
    assert len(nothing) == len(AWKWARD) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in nothing)


def test_held_out_copies_score_above_unigrams(spark):
    rows = queries.op5(spark, SF.replace("0.001", "0.01")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_a_small_sketch_estimates_the_same_prior(spark, monkeypatch):
    """The sketch against exact counts, whatever the blocks."""
    docs = docs_of(spark, [(i, prose(i, 200, 60)) for i in range(120)])
    train = queries.fold("doc_id", 7) != 2
    exact = backoff_lm.score(docs, train).first()["prior"]
    monkeypatch.setattr(backoff_lm, "LOWEST", 2000)
    one = backoff_lm.score(docs, train).first()["prior"]
    monkeypatch.setattr(backoff_lm, "BLOCK_TOKENS", 700)
    many = backoff_lm.score(docs.repartition(5), train).first()["prior"]
    assert one == many == pytest.approx(exact, rel=0.25) and one != exact


def test_held_out_rows_teach_nothing(spark):
    """Scores of training rows do not depend on held-out texts."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    rows = [(i, prose(i, 60, 80)) for i in range(80)]
    other = [(i, t if fold(i) != 2 else "something else " * 50) for i, t in rows]
    a, b = ({r["doc_id"]: tuple(r) for r in backoff_lm.score(docs_of(spark, x), queries.fold("doc_id", 7) != 2).collect() if not r["held_out"]} for x in (rows, other))
    assert a == b
