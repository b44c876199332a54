"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) by tokens.  Raking
multiplies every cell's weight, one dimension after another, by target / sum
of that dimension's value, until all marginals meet their targets.  A
document is then kept with probability weight * SHARE, at most one, so that
the sample has SHARE of all tokens and no document is repeated.

A value that holds fewer tokens than its target asks for is taken whole and
what it lacks goes to the other values of its dimension in proportion
(``shortfall`` is the share of the sample that moved so).  A cell whose
probability reaches one stays there while the sweeps go on with that bound,
so the other cells make up for it.  A rare value thus changes neither the
size of the sample nor the mix of the others by more than its own tokens.

Only the cell table takes part in the iteration; it has one row per
combination that occurs, however many documents there are.  Targets that
contradict each other leave a gap; it is logged and returned with the rows.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm.common import drop_stored, stored

DIMS = ("source", "lang", "topic")
SHARE = 0.5                 # of all tokens that the sample has
TOLERANCE = 1e-4            # largest relative gap of a marginal that ends the fitting
PATIENCE = 200              # sweeps
STALLED = 0.99              # a gap that shrinks by less in PATIENCE sweeps ends it as well
SWEEPS = 20_000             # at most
BROADCAST_CELLS = 100_000   # a larger cell table (about 10 MB) is swept and joined by shuffles
#: default targets: shares of tokens to these powers, so that common values lose and rare ones gain
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}

_LOG = logging.getLogger(__name__)


def n_tokens(text: Column) -> Column:
    """Words between ASCII blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rough_topic(text: Column) -> Column:
    """Kind of content by what the text holds: table, legal, contact, or prose by length."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains(" | "), "table").when(t.rlike("(?i)licen[cs]e|copyright"), "legal")
            .when(t.rlike(r"https?://|[^\s@]@[^\s@]+\.[a-zA-Z]"), "contact")
            .when(F.length(t) < 1000, "short prose").otherwise("long prose"))


def power_targets(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """Per dimension a table (value, target): its tokens to a power (rake rescales them to shares)."""
    return {d: cells.groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(p)).alias("target"))
            for d, p in powers.items()}


def _want(cells: DataFrame, targets: dict[str, DataFrame], share: float | None = None) -> tuple[dict[str, DataFrame], float]:
    """Per dimension a stored table (the dimension, want): tokens each value
    should have; their sum is ``share`` of all tokens and, with a share, no
    value wants more than it has.  Also the largest part of a dimension's
    tokens that this moved to other values than the targets name."""
    total = (cells.agg(F.sum("tokens")).first()[0] or 0) * (1.0 if share is None else share)
    want, moved = {}, 0.0
    for d, t in targets.items():
        here = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0").join(t, "value")
        here, _ = stored(here.select("value", F.col("n").cast("double"), F.col("target").cast("double")).where("target > 0"))
        sums = here.agg(F.sum("target").alias("t"), F.sum("n").alias("n")).first()
        per = first = total / (sums["t"] or 1.0)       # tokens for a target of one
        while share is not None and total < (sums["n"] or 0):  # each round adds values that are taken whole
            whole = F.col("n") <= F.col("target") * F.lit(per)
            r = here.agg(F.sum(F.when(whole, F.col("n"))).alias("n"), F.sum(F.when(~whole, F.col("target"))).alias("t")).first()
            new = (total - (r["n"] or 0.0)) / r["t"] if r["t"] else per
            if new <= per * (1 + 1e-12):
                break
            per = new
        goal = F.col("target") * F.lit(per)
        if share is not None:
            goal = F.least("n", goal)
            lost = here.agg(F.sum(F.greatest(F.lit(0.0), F.col("target") * F.lit(first) - F.col("n")))).first()[0]
            moved = max(moved, (lost or 0.0) / (total or 1.0))
        want[d], _ = stored(here.select(F.col("value").alias(d), goal.alias("want")))
    return want, moved


def _done(gaps: list[float]) -> bool:
    """Whether the targets are met, or cannot be: a table that only converges
    slowly still gains over many sweeps, one whose targets contradict each other does not."""
    return gaps[-1] <= TOLERANCE or len(gaps) > PATIENCE and min(gaps) > STALLED * min(gaps[:-PATIENCE])


def _fit_here(cells: DataFrame, want: dict[str, DataFrame], share: float | None) -> tuple[DataFrame, list[float]]:
    """The sweeps over a table of at most BROADCAST_CELLS cells, in arrays."""
    rows = cells.collect()
    n = np.array([r["tokens"] or 0 for r in rows], dtype=float)
    dims = []
    for d, t in want.items():
        at, goal = {}, {r[d]: r["want"] for r in t.join(cells.select(d).distinct(), d, "left_semi").collect()}
        code = np.array([at.setdefault(r[d], len(at)) for r in rows], dtype=int)
        dims.append((code, np.array([goal.get(v, 0.0) for v in at])))
    top, w, gaps = np.inf if share is None else 1.0, np.full(len(rows), share or 1.0), []
    while rows and len(gaps) < SWEEPS:
        gap = np.zeros(len(rows))
        for code, goal in dims:
            have = np.bincount(code, n * np.minimum(w, top), minlength=len(goal))
            f = np.divide(goal, have, out=np.ones(len(goal)), where=have > 0)[code]
            w, gap = w * f, np.maximum(gap, np.abs(f - 1))
        gaps.append(float(gap[w > 0].max(initial=0.0)))
        if _done(gaps):
            break
    schema = T.StructType([*cells.schema.fields, T.StructField("weight", T.DoubleType())])
    out, _ = stored(cells.sparkSession.createDataFrame([(*r, float(x)) for r, x in zip(rows, w)], schema))
    return out, gaps or [0.0]


def _fit_far(cells: DataFrame, want: dict[str, DataFrame], share: float | None) -> tuple[DataFrame, list[float]]:
    """The same sweeps as DataFrame steps; each sweep is written once."""
    top = F.lit(float("inf") if share is None else 1.0)
    (out, path), gaps = stored(cells.withColumn("weight", F.lit(share or 1.0)).withColumn("gap", F.lit(0.0))), []
    while len(gaps) < SWEEPS:
        w = out.drop("gap").withColumn("gap", F.lit(0.0))
        for d in want:
            have = w.groupBy(d).agg(F.sum(F.col("tokens") * F.least("weight", top)).alias("have"))
            f = have.join(want[d], d, "left").select(d, F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0)) / F.col("have")).otherwise(1.0).alias("f"))
            w = w.join(f, d).withColumn("gap", F.greatest("gap", F.abs(F.col("f") - 1))).withColumn("weight", F.col("weight") * F.col("f")).drop("f")
        old, (out, path) = path, stored(w)
        drop_stored(cells.sparkSession, old)
        gaps.append(out.where("weight > 0").agg(F.max("gap")).first()[0] or 0.0)
        if _done(gaps):
            break
    return out.drop("gap"), gaps


def _fit(cells: DataFrame, want: dict[str, DataFrame], share: float | None = None) -> tuple[DataFrame, list[float]]:
    """Weights and gaps; with a share a weight is a probability, and counts as one at most."""
    cells = cells.dropna(subset=list(want))
    out, gaps = (_fit_here if cells.count() <= BROADCAST_CELLS else _fit_far)(cells, want, share)
    if gaps[-1] > TOLERANCE:
        _LOG.warning("raking ended after %d sweeps with a marginal %.3g off its target", len(gaps), gaps[-1])
    return out, gaps


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> tuple[DataFrame, list[float]]:
    """cells (dimensions, tokens) with a weight each, and the largest relative gap
    of a marginal after each sweep.  targets: per dimension value and share;
    values without a target get nothing, values without tokens are left out
    and the other shares of the dimension rescaled."""
    return _fit(cells, _want(cells, targets)[0])


def mix(docs: DataFrame, topic: Column | None = None, powers: dict[str, float] | None = None,
        targets: dict[str, DataFrame] | None = None, seed: int = 11, carry: bool = False,
        share: float = SHARE) -> DataFrame:
    """Sampling probability and decision for each row of ``docs`` (doc_id, text, source, lang).

    Returns doc_id (with ``carry``: ``row``, a struct of the input's columns),
    source, lang, topic, n_tokens, weight, probability, kept, gap (the largest
    relative gap of a marginal that the fitting left) and shortfall (part of the
    sample that others give for values smaller than their target).  The decision
    compares a hash of doc_id with the probability: it is the same in every
    run, and rows of equal doc_id stay or go together.

    Nulls: source and lang count as a value of their own (''), a null text has
    no tokens, a null doc_id hashes as ''.  A document without tokens takes
    its cell's weight.  An empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.struct("doc_id")
    text = F.col("text")
    rows = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
                       (rough_topic(text) if topic is None else topic).alias("topic"), n_tokens(text).alias("n_tokens"))
    cells, _ = stored(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    want, moved = _want(cells, targets or power_targets(cells, powers or POWERS), share)
    weights, gaps = _fit(cells, want, share)
    weights = weights.select(*DIMS, (F.col("weight") / F.lit(share)).alias("weight"), F.least(F.lit(1.0), "weight").alias("probability"))
    if weights.count() <= BROADCAST_CELLS:
        weights = F.broadcast(weights)
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    who = F.col("row") if carry else F.col("row.doc_id").alias("doc_id")
    return rows.join(weights, list(DIMS)).select(who, *DIMS, "n_tokens", "weight", "probability", (u < F.col("probability")).alias("kept"),
                                                F.lit(gaps[-1]).alias("gap"), F.lit(moved).alias("shortfall"))
