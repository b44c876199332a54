"""Toxicity scoring behind a noisy-channel decoder.

Obfuscated words (l33t, i.n.s.e.r.t.s, s p a c i n g, repeeeats) are restored
first: the written form becomes a lattice of what each character may stand
for, and a Viterbi search finds the reading that the channel's costs and a
character trigram model together make likeliest.  Words written in letters
only, without a long repeat, have a single reading and skip the search.

The restored words are scored by their log-odds (lower confidence bounds, from
a bounded labelled sample); a logistic layer on the strongest words of the text
gives the probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import checkpointed, labelled_sample

# What a written character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
LEET_COST, SAME_COST, DROP_COST, JOIN_COST, REPEAT_COST, BREAK_COST = 1.5, 6.0, 0.7, 2.0, 0.4, 3.0

PER_CLASS = 10_000             # labelled rows of each class to learn from, at most
CHAR_SLOTS = 1 << 18           # hashed character trigrams of the language model
BOUND = 1.5                    # standard errors below the log-odds
STRONG = 2.0                   # a word above this counts as strong
LEAST = 0.5                    # words below this say nothing
CACHE = 300_000                # words a process remembers
SINGLES = 3                    # so many single characters in a row are read as one spaced word at least

# a sign with three letters or digits on either side more likely parts two words than interrupts one
_THREE = re.compile(r"[^\W_]{3}")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_LONG = re.compile(r"(.)\1\1")
_EDGE = re.compile(r"^[^\w@$!|+(<€£]+|[^\w@$|+(<€£]+$|[^\w]{3,}$")   # three signs at the end are no letters


def tokens(text: str | None) -> list[str]:
    """Written words, lower-cased, without punctuation around them; runs of
    single characters joined by blanks into one."""
    words = [x for w in (text or "").lower().split() if (x := w if w.isalpha() else _EDGE.sub("", w))]
    out, run = [], []
    for w in words:
        if len(w) == 1:
            run.append(w)
            continue
        if run:
            out += [" ".join(run)] if len(run) >= SINGLES else run
            run = []
        out.append(w)
    return out + ([" ".join(run)] if len(run) >= SINGLES else run)


def is_plain(word: str) -> bool:
    """Whether the written form has one reading only."""
    return bool(_PLAIN.match(word)) and not _LONG.search(word)


def _slot(a: str, b: str, c: str = "") -> int:
    h = 0
    for x in (a, b, c):
        h = (h * 1_000_003 + (ord(x) if x else 0x10FFFF)) & 0xFFFFFFFFFFFFFFFF
    return ((h * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 46


def count_characters(docs: DataFrame) -> np.ndarray:
    """Hashed counts of character trigrams (first row) and their contexts
    (second) in the plain words of all rows (text)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        grams, n = Counter(), 0
        table = np.zeros((2, CHAR_SLOTS), dtype=np.int64)

        def put():
            for (a, b, c), k in grams.items():
                table[0, _slot(a, b, c)] += k
                table[1, _slot(a, b)] += k
            grams.clear()

        for batch in batches:
            words = Counter()
            for t in batch["text"]:
                words.update(w for w in t.lower().split() if w.isalpha())
            for w, k in words.items():
                s = "^^" + w + "$"
                for i in range(len(s) - 2):
                    grams[s[i:i + 3]] += k
            n += len(batch)
            if len(grams) > 200_000:
                put()
        put()
        yield pd.DataFrame({"s": [0], "t": [table.tobytes()]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros(2 * CHAR_SLOTS, dtype=np.int64)
        for x in g["t"]:
            t += np.frombuffer(x, dtype=np.int64)
        return pd.DataFrame({"s": [int(g["s"].iloc[0])], "t": [t.tobytes()]})

    parts = docs.select("text").where("text is not null").mapInPandas(count, "s int, t binary")
    # tables of fixed size, added up in two steps
    some = parts.withColumn("s", (F.spark_partition_id() % 32).cast("int")).groupBy("s").applyInPandas(add, "s int, t binary")
    rows = some.withColumn("s", F.lit(0)).groupBy("s").applyInPandas(add, "s int, t binary").collect()
    return np.frombuffer(rows[0]["t"], dtype=np.int64).reshape(2, CHAR_SLOTS) if rows else np.zeros((2, CHAR_SLOTS), dtype=np.int64)


class Decoder:
    """Viterbi search over character lattices."""

    def __init__(self, counts: np.ndarray):
        self._tri, self._two = counts
        self._costs: dict[tuple[str, str, str], float] = {}

    def _cost(self, a: str, b: str, c: str) -> float:
        k = self._costs.get((a, b, c))
        if k is None:
            if len(self._costs) > CACHE:
                self._costs.clear()
            k = self._costs[a, b, c] = -float(np.log((self._tri[_slot(a, b, c)] + 0.05) / (self._two[_slot(a, b)] + 5.0)))
        return k

    def _lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For every run of a character, the readings with their channel costs."""
        anywhere = " " not in word
        out = []
        for m in re.finditer(r"(.)\1*", word, re.S):
            c, n = m[1], len(m[0])
            if c == " ":
                out.append([("", 0.0), (" ", BREAK_COST)])
                continue
            reads = [(c, 0.0)] if c.isalpha() else [(x, LEET_COST) for x in LEET.get(c, "")]
            more = REPEAT_COST * (n - 1)
            here = [(x, k + more) for x, k in reads]
            if n > 1:
                here += [(x + x, k + REPEAT_COST * (n - 2)) for x, k in reads]
            if not c.isalpha():
                between = m.start() > 2 and _THREE.match(word, m.start() - 3) and _THREE.match(word, m.end())
                here += [("", DROP_COST + (1.5 if c.isdigit() else JOIN_COST if between else 0.0)), (c, SAME_COST)]
                if not c.isdigit():
                    here.append((" ", 0.0 if between else DROP_COST))        # a sign between two words
            if anywhere:
                here += [(" " + x, k + BREAK_COST) for x, k in here if x]
            out.append(here)
        return out

    def __call__(self, word: str) -> list[str]:
        """The likeliest reading, as words.  Ties keep the first reading listed.
        One pass over the whole word; a reading is a chain (chain before, added),
        whose parts the readings share, so time and memory are linear."""
        best: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
        for reads in [*self._lattice(word), [("$", 0.0)]]:
            step: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (a, b), (cost, chain) in best.items():
                for add, k in reads:
                    x, y, total = a, b, cost + k
                    for c in add:
                        if c == " ":
                            total += self._cost(x, y, "$")
                            x, y = "^", "^"
                        else:
                            total += self._cost(x, y, c)
                            x, y = y, c
                    if (x, y) not in step or total < step[x, y][0]:
                        step[x, y] = (total, (chain, add) if add else chain)
            best = step
        _, chain = min(best.values(), key=lambda v: v[0])
        parts = []
        while chain is not None:
            chain, add = chain
            parts.append(add)
        return "".join(reversed(parts))[:-1].split()


class Reader:
    """Restored words of texts, and the strength of each written word."""

    def __init__(self, counts: np.ndarray, odds: dict[str, float] | None = None):
        self._decode, self._odds = Decoder(counts), odds or {}
        self._read: dict[str, list[str]] = {}
        self._kinds = _Kinds(self)

    def restored(self, word: str) -> list[str]:
        if is_plain(word):
            return [word]
        got = self._read.get(word)
        if got is None:
            if len(self._read) > CACHE:
                self._read.clear()
            got = self._read[word] = self._decode(word)
        return got

    def texts(self, texts: pd.Series) -> list[list[str]]:
        return [[r for w in tokens(t) for r in self.restored(w)] for t in texts]

    def features(self, texts: pd.Series) -> np.ndarray:
        """Per text: 1, the two strongest words, how many are strong, length."""
        out = np.zeros((len(texts), 5))
        for i, t in enumerate(texts):
            if len(self._kinds) > CACHE:
                self._kinds = _Kinds(self)
            words = (t or "").lower().split()
            kinds = bytes(map(self._kinds.__getitem__, words))
            n = len(kinds) - kinds.count(_NOTHING)
            if _SINGLE * SINGLES in kinds.replace(bytes([_NOTHING]), b""):  # a spaced word: read word by word
                read = [r for w in tokens(t) for r in self.restored(w)]
                s, n = [self._odds[r] for r in read if r in self._odds], len(read)
            else:
                s, at = [], kinds.find(_TELLS)
                while at >= 0:
                    s += self._kinds.odds[words[at]]
                    at = kinds.find(_TELLS, at + 1)
            s.sort()
            out[i] = 1, s[-1] if s else 0, s[-2] if len(s) > 1 else 0, np.log1p(sum(x > STRONG for x in s)), np.log1p(n)
        return out


class _Kinds(dict):
    """What a written word holds, so that most words cost one lookup: a single
    character, nothing but punctuation, words with log-odds (in ``odds``), others."""

    def __init__(self, reader: Reader):
        super().__init__()
        self._reader, self.odds = reader, {}

    def __missing__(self, word: str) -> int:
        read = tokens(word)
        kind = _NOTHING if not read else _SINGLE[0] if len(read[0]) == 1 else 0
        told = [o for w in read for r in self._reader.restored(w) if (o := self._reader._odds.get(r)) is not None]
        if told and kind == 0:
            self.odds[word], kind = told, _TELLS[0]
        self[word] = kind
        return kind


_SINGLE, _NOTHING, _TELLS = b"\x01", 3, b"\x02"


def _log_odds(c0: Column, c1: Column, n: list[int]) -> Column:
    """Lower bound of how much likelier a word is in texts of label 1."""
    a, b = c0 + 0.5, c1 + 0.5
    return F.log(b / (n[1] + 1)) - F.log(a / (n[0] + 1)) - BOUND * F.sqrt(1 / a + 1 / b)


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps with a small ridge; (weights, scale)."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, b = x / scale, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (w * (p - y)) + 0.1 * b
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(b))
        b = b - np.clip(np.linalg.solve(h, g), -5, 5)
    return b, scale


def learn(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column, per_class: int = PER_CLASS) -> dict:
    """Character model from all training texts; log-odds and logistic layer from
    at most ``per_class`` labelled rows of each class (half of them each).
    Without rows of both classes every text scores zero.  Null texts are empty ones; rows
    without id or 0/1 label teach no word; repeated rows of an id each count, of several
    labels of an id the larger counts; ties in the sample go by id.  Other columns are not read."""
    counts = count_characters(docs.where(F.coalesce(train_rows, F.lit(False))))
    spark = docs.sparkSession
    chars = spark.sparkContext.broadcast(counts)     # a table of fixed size
    sample = labelled_sample(docs, labels, label, train_rows, per_class).withColumn(
        "half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int"))

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Reader(chars.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "half": b["half"], "words": [" ".join(w) for w in r.texts(b["text"])]})

    restored = checkpointed(sample.mapInPandas(restore, "doc_id long, y int, half int, words string"))

    n = np.zeros((2, 2), dtype=int)
    for r in restored.groupBy("half", "y").count().collect():
        n[r["half"], r["y"]] = r["count"]
    nothing = {"counts": counts, "odds": {}, "layer": np.array([-50.0, 0, 0, 0, 0]), "scale": np.ones(5)}
    if not n.sum(axis=0).all():
        return nothing
    c = {(h, y): F.col(f"c{h}{y}") for h in (0, 1) for y in (0, 1)}
    words = restored.select("half", "y", F.explode(F.array_distinct(F.split("words", " "))).alias("word")).where("word <> ''")
    words = words.groupBy("word").agg(*[F.count_if((F.col("half") == h) & (F.col("y") == y)).alias(f"c{h}{y}") for h, y in c])
    words = words.select("word", *[_log_odds(c[h, 0], c[h, 1], n[h].tolist()).alias(f"o{h}") for h in (0, 1)],
                         _log_odds(c[0, 0] + c[1, 0], c[0, 1] + c[1, 1], n.sum(axis=0).tolist()).alias("o"))
    # words of a bounded sample, and of these only the ones that speak for label 1
    told = words.where(f"greatest(o, o0, o1) > {LEAST}").collect()
    odds = {r["word"]: r["o"] for r in told if r["o"] > LEAST}
    other = spark.sparkContext.broadcast([{r["word"]: r[f"o{1 - h}"] for r in told if r[f"o{1 - h}"] > LEAST} for h in (0, 1)])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = [Reader(chars.value, o) for o in other.value]
        for b in batches:
            for half, g in b.groupby("half"):        # each half by the log-odds of the other one
                x = readers[half].features(g["words"])
                yield pd.DataFrame({"y": g["y"].to_numpy(), "x": list(x)})

    seen = restored.mapInPandas(measure, "y int, x array<double>").collect()
    x, y = np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], dtype=float)
    order = np.lexsort((*x.T, y))                    # rows come in any order: sums must not differ
    all_n = {r[label]: r["count"] for r in labels.where(F.col(label).isin(0, 1) & train_rows).groupBy(label).count().collect()}
    weight = np.where(y == 1, all_n[1] / max((y == 1).sum(), 1), all_n[0] / max((y == 0).sum(), 1))
    layer, scale = _fit(x[order], y[order], (weight / weight.mean())[order])
    return {"counts": counts, "odds": odds, "layer": layer, "scale": scale}


def score(model: dict, text: Column, spark) -> Column:
    """Probability that a text is toxic.  A null or empty text has no words and
    scores the layer's offset; texts are read whole."""
    shared = spark.sparkContext.broadcast(model)     # tables of fixed size, words of a bounded sample

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        reader = Reader(m["counts"], m["odds"])
        for b in batches:
            z = (reader.features(b) / m["scale"]) @ m["layer"]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return run.asNondeterministic()(text)
