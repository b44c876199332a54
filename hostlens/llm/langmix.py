"""Language identification as inference of a mixture of languages.

Every language has a table of byte n-gram probabilities, counted over all
training documents.  A document is a mixture: each of its words comes from one
language, which words do not tell.  Expectation-maximisation estimates the
proportions from the words' n-gram likelihoods, and the set of languages is
chosen by penalised likelihood: languages are taken out, least first, while
the loss of log-likelihood stays below the penalty per language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4                    # bytes of an n-gram (words are padded at both ends)
SLOTS = 1 << 16             # n-grams are hashed into so many slots; the size of a language's table
SMOOTH = 0.5                # added to every slot's count
ROUNDS = 12                 # of expectation-maximisation
PENALTY = 1.0               # times log(words): what one more language must gain
CACHE = 200_000             # words whose likelihoods a process remembers
PART = 250                  # documents estimated together
HELD = 32                   # languages a task counts before it hands on its tables

_WORD = re.compile(r"[^\W\d_]+")
_K = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint64)


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters; [] if there is no letter at all."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def _slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of the words, and where each word's begin."""
    coded = [b"\x02\x02" + w.encode("utf-8", "replace") + b"\x03\x03" for w in words]
    b = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint64)
    n = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    h = np.zeros(len(b), dtype=np.uint64)
    for j in range(GRAM):
        h[:len(b) - GRAM + 1] += b[j:len(b) - GRAM + 1 + j] * _K[j]
    h = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    keep = np.ones(len(b), dtype=bool)
    ends = np.cumsum(n)
    for j in range(1, GRAM):                     # an n-gram does not run into the next word
        keep[ends - j] = False
    grams = n - GRAM + 1
    return h[keep], np.concatenate(([0], np.cumsum(grams)[:-1]))


def count_languages(docs: DataFrame) -> dict[str, np.ndarray]:
    """Counts of n-gram slots per language over all rows (text, lang) with a language."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        tables: dict[str, np.ndarray] = {}

        def hand_on():
            out = pd.DataFrame({"lang": list(tables), "counts": [t.tobytes() for t in tables.values()]}, dtype=object)
            tables.clear()
            return out

        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                words = Counter()
                for t in texts:
                    words.update(letters(t))
                if words:
                    w = list(words)
                    slot, first = _slots(w)
                    times = np.repeat(np.fromiter(words.values(), dtype=np.int64, count=len(w)), np.diff(first, append=len(slot)))
                    tables.setdefault(lang, np.zeros(SLOTS, dtype=np.int64))
                    tables[lang] += np.bincount(slot, weights=times, minlength=SLOTS).astype(np.int64)
                if len(tables) > HELD:
                    yield hand_on()
        yield hand_on()

    def total(g: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros(SLOTS, dtype=np.int64)
        for c in g["counts"]:
            t += np.frombuffer(c, dtype=np.int64)
        return pd.DataFrame({"lang": [g["lang"].iloc[0]], "counts": [t.tobytes()]})

    schema = "lang string, counts binary"
    parts = docs.select("lang", "text").where("lang is not null and text is not null").mapInPandas(count, schema)
    # two steps, so that no task adds up the tables of every task for a common language
    some = parts.withColumn("s", F.spark_partition_id() % 16).groupBy("lang", "s").applyInPandas(total, schema)
    rows = some.groupBy("lang").applyInPandas(total, schema).collect()  # one table of fixed size per language
    return {r["lang"]: np.frombuffer(r["counts"], dtype=np.int64) for r in sorted(rows, key=lambda r: r["lang"])}


class Mixture:
    """Word likelihoods under each language, and the inference for documents."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.langs = list(tables)
        t = np.array([tables[k] for k in self.langs], dtype=float).reshape(len(self.langs), SLOTS) + SMOOTH
        self._logp = np.ascontiguousarray(np.log(t / t.sum(axis=1, keepdims=True)).T)
        self._at: dict[str, int] = {}
        self._rows = np.empty((0, len(self.langs)))

    def _lookup(self, docs: list[list[str]]) -> np.ndarray:
        """Row numbers (in self._rows) of all words of all documents."""
        if len(self._at) > CACHE:
            self._at, self._rows = {}, self._rows[:0]
        new = list({w for d in docs for w in d} - self._at.keys())
        if new:
            slot, first = _slots(new)
            self._at.update(zip(new, range(len(self._at), len(self._at) + len(new))))
            self._rows = np.concatenate([self._rows, np.add.reduceat(self._logp[slot], first, axis=0)])
        return np.fromiter((self._at[w] for d in docs for w in d), dtype=np.int64)

    def _em(self, like, n, first, doc, share, rounds=ROUNDS):
        """Proportions and log-likelihood per document, from ``share`` on (a
        language at 0 stays out)."""
        total = np.add.reduceat(n, first)[:, None]
        for _ in range(rounds):
            r = like * share[doc]
            r *= (n / np.maximum(r.sum(axis=1), 1e-300))[:, None]
            share = np.add.reduceat(r, first, axis=0) / total
        p = np.maximum((like * share[doc]).sum(axis=1), 1e-300)
        return share, np.add.reduceat(n * np.log(p), first)

    def infer(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the chosen languages per document (rows sum to one),
        and the single-language log-likelihoods.  No document may be empty."""
        row = self._lookup(docs)
        size = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        pair, n = np.unique(np.repeat(np.arange(len(docs)), size) * np.int64(len(self._rows)) + row, return_counts=True)
        doc, word = pair // len(self._rows), pair % len(self._rows)
        first = np.searchsorted(doc, np.arange(len(docs)))
        log = self._rows[word]
        top = log.max(axis=1, keepdims=True)
        like, n = np.exp(log - top), n.astype(float)
        single = np.add.reduceat((log - top) * n[:, None], first, axis=0)
        k, cost = len(self.langs), PENALTY * np.log(size + 1.0)
        share, ll = self._em(like, n, first, doc, np.full((len(docs), k), 1.0 / k))
        crit = ll - cost * (k - 1)
        alone = single.max(axis=1) >= crit           # one language does as well: the usual case
        share[alone] = np.eye(k)[single[alone].argmax(axis=1)]
        open_ = np.flatnonzero(~alone)
        for left in range(k - 1, 0, -1):             # languages left after one more is taken out
            if not len(open_):
                break
            use = np.isin(doc, open_)
            d = np.searchsorted(open_, doc[use])
            f = np.searchsorted(d, np.arange(len(open_)))
            fewer = share[open_].copy()
            fewer[np.arange(len(open_)), np.where(fewer > 0, fewer, 2).argmin(axis=1)] = 0
            fewer /= np.maximum(fewer.sum(axis=1, keepdims=True), 1e-300)
            fewer, ll = self._em(like[use], n[use], f, d, fewer)
            new = ll - cost[open_] * (left - 1)
            good = new >= crit[open_]
            share[open_[good]], crit[open_[good]] = fewer[good], new[good]
            open_ = open_[good]
        return share, single

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        """lang, score and langs (the chosen set with proportions) of each text."""
        lang, score, mix = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
        for a in range(0, len(texts) if self.langs else 0, PART):
            words = {i: w for i, t in enumerate(texts.iloc[a:a + PART], a) if (w := letters(t))}
            if not words:
                continue
            share, single = self.infer(list(words.values()))
            # by which margin the main language alone explains the text better than each other one alone
            sure = 1 / np.exp(single - single.max(axis=1, keepdims=True)).sum(axis=1)
            best = share.argmax(axis=1)
            for i, s, b, c in zip(words, share, best, sure):
                lang[i], score[i] = self.langs[b], float(min(1.0, s[b] * (c if s[b] > 0.999 else 1.0)))
                mix[i] = " ".join(f"{self.langs[j]}:{s[j]:.2f}" for j in np.argsort(-s) if s[j] > 0)
        return pd.DataFrame({"lang": lang, "score": score, "langs": mix})


def learn(docs: DataFrame, train: Column) -> Mixture:
    """Mixture learnt from the rows (text, lang) where ``train`` holds."""
    return Mixture(count_languages(docs.where(F.coalesce(train, F.lit(False)))))


def predict(model: Mixture, text: Column, spark) -> Column:
    """Column struct(lang, score, langs) for a text column.

    lang is ``und`` with score 0 where the text is null or has no letter, or
    nothing was learnt.  score is the main language's proportion, times its
    posterior against the other languages where it is the only one.  Texts
    are read whole; ties go to the alphabetically first language.
    """
    shared = spark.sparkContext.broadcast((list(model.langs), model._logp.astype(np.float32)))  # one table of fixed size per language

    @F.pandas_udf("lang string, score double, langs string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Mixture({})
        m.langs, m._logp = shared.value
        m._rows = np.empty((0, len(m.langs)), dtype=m._logp.dtype)
        for b in batches:
            yield m.predict(b)

    return run.asNondeterministic()(text)
