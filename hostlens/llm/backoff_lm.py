"""Language-model scoring with a weighted backoff automaton over word bigrams.

States are the words known from training (the last word read) and a root.  A
state has one arc per bigram seen in training, weighted with the smoothed
log-probability, and a failure arc to the root, weighted with the mass that
smoothing leaves for all other words.  The root has one arc per known word and
one for every unknown word.  Scoring is one traversal from left to right that
carries the state and adds up the weights of the arcs it takes.

With counts c, unigram p1(w) = (c(w) + 1) / (N + V + 1) and prior mass M:

    arc h -> w      log10((c(hw) + M * p1(w)) / (c(h) + M))
    failure of h    log10(M / (c(h) + M))        (then p1(w) from the root)

which sums to one over all words.  M comes from the training counts alone: a
bigram is new to its context about as often as training bigrams occur once, so M
is set to make the failure arcs carry that share of the training tokens
(Good-Turing).  The share is read off a sketch of all training bigrams, the
``LOWEST`` least hashes with their counts, which is exact for small corpora.

The counts grow with the corpus, so no task holds all of them.  Documents are
packed into blocks of a bounded number of tokens.  A block sends the hashes
of its own distinct words and bigrams, with its training counts, to buckets
of the hash range (one request serves for counting and for asking); a bucket
adds up all blocks' counts and answers every block with the totals it asked
for; the block then builds the part of the automaton that its documents can
reach and traverses them.  Answers are exact sums over the whole corpus.
Words and bigrams are named by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm.common import mix64, width, words_of

LOWEST = 1 << 14                 # bigrams of the sketch that sets the prior mass
PER_OCTAVE = 8                   # bins of word counts for the same purpose
BLOCK_TOKENS = 2_000_000         # tokens of a block; a longer document is a block of its own
BUCKET_GRAMS = 2_000_000         # words and bigrams that a bucket should hold, repeats included
_END, _START = b"\x00end", b"\x00start"   # no word has a blank in it; \x00 words differ from these by length or text
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def _zip(a: np.ndarray) -> bytes:
    """Array as bytes, one byte plane after another, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _unzip(b: bytes, dtype) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


class _Block:
    """Token ids of some documents, and the hashes of their words and bigrams
    in the order in which they are asked for (by bucket, then hash)."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, buckets: int):
        n = len(hashes)
        self.n, self.tokens, self.lengths = n, tokens, lengths
        self.first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        pairs = _before(tokens, lengths).astype(np.int64) * n + tokens      # id 0: end, id 1: start
        self.pairs, self.at = np.unique(pairs, return_inverse=True)
        keys = np.concatenate((mix64(hashes), _pair_keys(hashes, self.pairs // n, self.pairs % n)))
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((keys, bucket))
        self.keys = keys[self.order]
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1))


def _xxh(words) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64)


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Blocks (ids of words, token ids, lengths, doc ids, train flags)."""
    def fresh():
        ids = _Ids()
        ids[_END], ids[_START]  # noqa: B018  they get 0 and 1
        return ids, [], [], [], [], 0

    ids, tok, lens, docs, train, n = fresh()
    for b in batches:
        for doc, text, learn in zip(b["doc_id"], b["text"], b["train"]):
            words = words_of(text)
            t = np.zeros(len(words) + 1, dtype=np.int32)
            t[:-1] = np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words))
            tok.append(t)
            lens.append(len(t))
            docs.append(doc)
            train.append(learn)
            n += len(t)
            if n >= BLOCK_TOKENS:
                yield ids, np.concatenate(tok), np.array(lens, dtype=np.int64), docs, np.array(train, dtype=bool)
                ids, tok, lens, docs, train, n = fresh()
    if n:
        yield ids, np.concatenate(tok), np.array(lens, dtype=np.int64), docs, np.array(train, dtype=bool)


def _pair_keys(hashes: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(hashes[before] * _PAIR + mix64(hashes[word] + _PAIR))


def _before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token before each; id 1, the start, at the first of a document."""
    out = np.ones_like(tokens)
    out[1:] = tokens[:-1]
    out[np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)] = 1
    return out


def _lowest(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The LOWEST least distinct keys and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[new][:LOWEST], np.add.reduceat(counts, new)[:LOWEST] if len(new) else counts


def prior_mass(n_train: int, mass: dict[int, int], keys: np.ndarray, counts: np.ndarray) -> float:
    """M such that training tokens take the failure arc as often as training bigrams
    occur once.  mass: tokens whose word count lies in each bin."""
    if not n_train or not len(keys):
        return 1.0
    kinds = len(keys) if len(keys) < LOWEST else (LOWEST - 1) / (float(keys[-1]) / 2.0 ** 64)
    new = min(kinds * float((counts == 1).mean()) / n_train, 1.0)
    c = np.array([2.0 ** (b / PER_OCTAVE) for b in mass])
    tokens = np.array(list(mass.values()), dtype=float)
    low, high = 1e-3, 1e6
    for _ in range(60):
        m = math.sqrt(low * high)
        low, high = (m, high) if (tokens * m / (c + m)).sum() / tokens.sum() < new else (low, m)
    return m


def _corpus(docs: DataFrame) -> tuple[int, int, int, float]:
    """N (training tokens), V (distinct ones), the number of all tokens, and M."""
    buckets = width(docs.sparkSession)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sketch = -1 - TaskContext.get().partitionId() % 32
        for ids, tok, lens, _, train in _tokens(batches):
            hashes, mine = _xxh(ids), np.repeat(train, lens)
            seen = np.bincount(tok[mine], minlength=len(ids))
            key, n = mix64(hashes)[seen > 0], seen[seen > 0]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((key, bucket))
            key, n, bucket = key[order], n[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            low, times = _lowest(_pair_keys(hashes, _before(tok, lens)[mine], tok[mine]), np.ones(int(mine.sum()), dtype=np.int64))
            yield pd.DataFrame([(i, _zip(np.diff(key[a:b], prepend=np.uint64(0))), _zip(n[a:b]), 0, 0)
                                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                               + [(sketch, _zip(low), _zip(times), int(seen.sum()), len(tok))], columns=["bucket", "keys", "counts", "train", "tokens"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        """Per bucket: distinct words (what -1) and tokens by bin of their word's count (from 0 on);
        per sketch: training tokens (-2), all tokens (-3) and the lowest pairs (-4)."""
        counts = [_unzip(x, np.int64) for x in g["counts"]]
        keys = [_unzip(x, np.uint64) for x in g["keys"]]
        if g["bucket"].iloc[0] < 0:
            low, times = _lowest(np.concatenate(keys), np.concatenate(counts))
            out = [(-2, int(g["train"].sum()), None, None), (-3, int(g["tokens"].sum()), None, None), (-4, 0, _zip(low), _zip(times))]
        else:
            uniq, at = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k in keys]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            bins = np.round(np.log2(total) * PER_OCTAVE).astype(np.int64)
            out = [(-1, len(uniq), None, None)] + [(int(b), int(total[bins == b].sum()), None, None) for b in np.unique(bins)]
        return pd.DataFrame(out, columns=["what", "n", "keys", "counts"])

    found = docs.mapInPandas(words, "bucket int, keys binary, counts binary, train long, tokens long").groupBy("bucket").applyInPandas(
        add, "what int, n long, keys binary, counts binary")
    # a few hundred numbers, and at most 32 sketches
    rows = found.groupBy("what").agg(F.sum("n").alias("n"), F.collect_list("keys").alias("keys"), F.collect_list("counts").alias("counts")).collect()
    n = {r["what"]: r["n"] for r in rows}
    low = [(_unzip(k, np.uint64), _unzip(c, np.int64)) for r in rows if r["what"] == -4 for k, c in zip(r["keys"], r["counts"])]
    keys, counts = _lowest(*map(np.concatenate, zip(*low))) if low else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
    return n.get(-2, 0), n.get(-1, 0), n.get(-3, 0), prior_mass(n.get(-2, 0), {b: x for b, x in n.items() if b >= 0}, keys, counts)


class BackoffAutomaton:
    """The part of the automaton that a block can reach.

    arcs: sorted codes state * n + word, with weights; an arc leads to the
    state of its word.  fail: weight of the failure arc (to the root).  root:
    weights of the root's arcs.  live: words that are states (others lead to
    the root)."""

    ROOT = -1

    def __init__(self, block: _Block, counts: np.ndarray, n_train: int, v: int, prior: float):
        n = block.n
        word, pair = counts[:n].astype(float), counts[n:].astype(float)
        context = word.copy()
        context[1] = word[0]                         # as many starts as ends
        p1 = (word + 1) / (n_train + v + 1)
        seen = pair > 0
        self.n, self.known = n, word > 0
        self.arcs = block.pairs[seen]
        h, w = self.arcs // n, self.arcs % n
        self.weight = np.log10((pair[seen] + prior * p1[w]) / (context[h] + prior))
        self.fail, self.root, self.live = np.log10(prior / (context + prior)), np.log10(p1), context > 0

    def score(self, block: _Block) -> np.ndarray:
        """Log10 probability of each document: all documents step from token to
        token together, longest first, each with its own state."""
        order = np.argsort(-block.lengths, kind="stable")
        first, left = block.first[order], block.lengths[order]
        total = np.zeros(len(order))
        state = np.full(len(order), 1 if self.live[1] else self.ROOT, dtype=np.int64)
        ends = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
        for t, k in enumerate(ends):                 # k documents have a token t
            w = block.tokens[first[:k] + t].astype(np.int64)
            s = state[:k]
            code = s * self.n + w
            at = np.minimum(np.searchsorted(self.arcs, code), len(self.arcs) - 1)
            hit = (self.arcs[at] == code) & (s >= 0) if len(self.arcs) else np.zeros(k, dtype=bool)
            step = np.where(s >= 0, self.fail[s], 0.0) + self.root[w]    # by the failure arc, or from the root
            if len(self.arcs):
                step = np.where(hit, self.weight[at], step)
            total[:k] += step
            state[:k] = np.where(self.live[w], w, self.ROOT)
        out = np.empty_like(total)
        out[order] = total
        return out


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Score each row of ``docs`` (doc_id, text) with a model learnt from the rows
    where ``train`` holds.  Tokens are A-Z lower-cased words between ASCII
    blanks, then one end.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigrams), score (log10 probability under the automaton) and prior
    (the prior mass M, from training rows only).

    Null and empty texts consist of the end alone.  Without training rows all
    tokens are unknown.  A null doc_id is kept; repeated rows count and are
    scored as often as they come; texts of any length are one document of one
    block.  An empty table gives no rows; other columns are not read.
    """
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    n_train, v, n_all, prior = _corpus(rows)
    # an unknown number of grams, at most two a token and block
    buckets = max(width(docs.sparkSession), math.ceil(n_all / BUCKET_GRAMS))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, (ids, tok, lens, doc, learn) in enumerate(_tokens(batches)):
            blk, hashes = (part << 24) + i, _xxh(ids)
            block, mine = _Block(hashes, tok, lens, buckets), np.repeat(learn, lens)
            count = np.concatenate((np.bincount(tok[mine], minlength=block.n),
                                    np.bincount(block.at[mine], minlength=len(block.pairs)))).astype(np.uint32)[block.order]
            null = pd.isna(pd.Series(doc, dtype=object)).to_numpy()
            ids8 = np.array([0 if z else int(d) for d, z in zip(doc, null)], dtype=np.int64)
            body = [_zip(hashes), _zip(tok), _zip(lens), _zip(ids8), _zip(null.astype(np.uint8) + 2 * learn.astype(np.uint8))]
            out = [(j, blk, _zip(np.diff(block.keys[a:b], prepend=np.uint64(0))), _zip(count[a:b]), None)
                   for j, (a, b) in enumerate(zip(block.cuts[:-1], block.cuts[1:])) if b > a]
            yield pd.DataFrame([*out, (blk % buckets, blk, None, None, body)], columns=["bucket", "blk", "keys", "counts", "body"])

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        q = g[g["keys"].notna()]
        keys = [np.cumsum(_unzip(k, np.uint64), dtype=np.uint64) for k in q["keys"]]
        out = g[g["keys"].isna()][["blk", "bucket", "counts", "body"]]
        if keys:
            uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(uniq), dtype=np.int64)
            cuts, counts = np.cumsum([0, *map(len, keys)]), [_unzip(c, np.uint32) for c in q["counts"]]
            for a, b, c in zip(cuts[:-1], cuts[1:], counts):
                np.add.at(total, at[a:b], c)         # a block may name a hash twice
            reply = [_zip(total[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
            out = pd.concat([out, pd.DataFrame({"blk": q["blk"].to_numpy(), "bucket": q["bucket"].to_numpy(),
                                                "counts": reply, "body": [None] * len(reply)})], ignore_index=True)
        return out

    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType())]
                          + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
                          + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "prior")])

    def traverse(g: pd.DataFrame) -> pd.DataFrame:
        body = next(b for b in g["body"] if b is not None)
        hashes, tok, lens, ids8, flags = (_unzip(b, t) for b, t in zip(body, (np.uint64, np.int32, np.int64, np.int64, np.uint8)))
        block = _Block(hashes, tok, lens, buckets)
        replies = g[g["body"].isna()].sort_values("bucket")
        counts = np.empty(len(block.order), dtype=np.int64)
        counts[block.order] = np.concatenate([_unzip(c, np.int64) for c in replies["counts"]])
        model = BackoffAutomaton(block, counts, n_train, v, prior)
        per = lambda x: np.add.reduceat(x, block.first)  # noqa: E731  no document is without a token
        return pd.DataFrame({
            "doc_id": pd.array(ids8, dtype="Int64") if not (flags & 1).any() else pd.array(np.where(flags & 1, None, ids8.astype(object)), dtype="Int64"),
            "held_out": (flags & 2) == 0, "n_tokens": lens, "n_known": per(model.known[tok].astype(np.int64)),
            "train_tokens": np.int64(n_train), "base_score": per(model.root[tok]), "score": model.score(block),
            "prior": prior})

    asked = rows.mapInPandas(ask, "bucket int, blk long, keys binary, counts binary, body array<binary>")
    told = asked.groupBy("bucket").applyInPandas(answer, "blk long, bucket int, counts binary, body array<binary>")
    return told.groupBy("blk").applyInPandas(traverse, schema)
