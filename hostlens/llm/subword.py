"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words and of the character
n-grams of its words, all hashed into one table; a softmax layer on the average
gives the class.  Vectors and layer are trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows.

A trained model scores a document by one number per hashed feature, since the
layer of an average is the average of the layer, so scoring needs the table of
those numbers only (1 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import WordHashes, labelled_sample, mix64

SLOTS_LOG2 = 18
GRAMS = (2, 3, 4)            # characters of the n-grams
DIM = 16
EPOCHS = 6
RATE = 0.4
PER_CLASS = 2500             # labelled rows of each class to learn from, at most
_REPEAT = np.uint64(0x52455045)
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)


class Features:
    """Hashed features of a text: its words, whether a word repeats the one before,
    and the n-grams of characters (code points, case kept) inside words.  A blank
    before or after a word is its border and may begin or end an n-gram."""

    def __init__(self):
        self._hash = WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        w = self._hash.of(text.encode("utf-8", "replace").split())
        parts = [w, np.full(int((w[1:] == w[:-1]).sum()), _REPEAT)]
        letter = c > 32
        for n in GRAMS:
            m = len(c) - n + 1
            if m > 0:
                h = np.full(m, np.uint64(n))
                for j in range(n):
                    h = (h + c[j:m + j]) * _K[j]
                inside = np.ones(m, dtype=bool)
                for j in range(1, n - 1):
                    inside &= letter[j:m + j]
                parts.append(h[inside])
        return (mix64(np.concatenate(parts)) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int32)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], prior: float) -> tuple[np.ndarray, float]:
    """Weights per slot and offset (logit of label 1) from examples (distinct
    slots, their counts, label).  ``prior`` is the odds of label 1 against 0
    among all labelled training rows over those in the sample."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << SLOTS_LOG2, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, step = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            slots, counts, y = examples[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            if not len(slots):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[slots]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1                                # gradient of the loss by z
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            bias -= rate * p
            # fastText's update: the gradient goes to every feature, not divided by their number
            vectors[slots] -= (rate * np.minimum(counts, 8))[:, None].astype(np.float32) * (back / np.float32(np.sqrt(len(slots))))
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0] + np.log(prior))


def learn(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Model learnt from the labelled rows where ``train_rows`` (over doc_id) holds.
    Without rows of both classes every text scores one half.  Null texts are empty ones;
    rows without id or 0/1 label teach nothing; repeated rows of an id in ``docs`` each
    count as examples, of several labels of an id the larger counts; ties in the sample go by
    id.  Other columns are not read."""
    sample = labelled_sample(docs, labels, label, train_rows, per_class)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Features()
        for b in batches:
            got = [np.unique(f(t), return_counts=True) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "slots": [s.astype(np.int32).tobytes() for s, _ in got],
                                "counts": [np.minimum(c, 65535).astype(np.uint16).tobytes() for _, c in got]})

    # 2 * per_class rows; a row has as many slots as the text has distinct features, SLOTS at most
    rows = sorted(sample.mapInPandas(extract, "doc_id long, y int, slots binary, counts binary").collect(),
                  key=lambda r: (r["doc_id"], r["slots"]))
    examples = [(np.frombuffer(r["slots"], dtype=np.int32), np.frombuffer(r["counts"], dtype=np.uint16).astype(np.float32), r["y"]) for r in rows]
    have = np.bincount([e[2] for e in examples], minlength=2)
    if not have.all():
        return np.zeros(1 << SLOTS_LOG2, dtype=np.float32), 0.0
    n = {r[label]: r["count"] for r in labels.where(F.col(label).isin(0, 1) & train_rows).groupBy(label).count().collect()}
    return train(examples, (n[1] / n[0]) / (have[1] / have[0]))


def score(model: tuple[np.ndarray, float], text: Column, spark) -> Column:
    """Probability of label 1 of a text column.  A null or empty text has no
    features and scores the offset alone; texts are read whole."""
    shared = spark.sparkContext.broadcast(model)     # one number per slot

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f, (weights, offset) = Features(), shared.value
        for b in batches:
            z = np.array([offset + (float(weights[s].mean(dtype=np.float64)) if len(s := f(t)) else 0.0) for t in b])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return run.asNondeterministic()(text)
