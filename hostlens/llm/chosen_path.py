"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct word shingles.  Documents with equal sets
form a class and go on as one row.  ``TREES`` independent trees then branch
the classes: the children of a node are named by a minwise token of the set, so
a pair of similarity s goes down one branch together with probability s.  A
node of at most ``SMALL`` classes is compared exhaustively on short sketches;
a larger one branches again along ``BRANCHES`` fresh tokens, and one that is
still large at the last level (alike documents do not part) is taken whole.

What the nodes connect are candidate groups only.  Each group then gets the
full sets of its members, and a link counts when the sets' Jaccard similarity
reaches the threshold.  Inside a group, members that confirmed links have
joined already need no comparison, so thousands of near copies cost about one
comparison each.  Groups above ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles
are dealt over several blocks; between blocks sketches are compared first, and
the texts follow only of members that look alike across a pair of blocks.

Recall: a pair at the threshold 0.8 that must go down all four levels meets in
a tree with probability 0.8 * 0.96 ** 3 = 0.71, so all ten trees miss it with
probability 5e-6; the sketches (64 bytes, accepted from 35 matches on where 51
are expected) miss a pair with probability 2e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm.common import WordHashes, checkpointed, join_hot, mix64, shingle_hashes, width, words_of
from hostlens.llm.graph import components

TREES = 10
LEVELS = 4
BRANCHES = 2
SMALL = 200
SKETCH = 64
ALIKE = 35
BLOCK = 1500
BLOCK_SHINGLES = 4_000_000
_TOKENS = 1 + BRANCHES * (LEVELS - 1)      # minwise tokens a tree may use
_CHUNK = 4096


def shingle_set(hashes: WordHashes, text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(hashes.of(words_of(text)), k))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def minwise(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper 32 bits of the least value of each hash function over the set."""
    least = np.full(len(a), ~np.uint64(0))
    for i in range(0, len(s), _CHUNK):
        np.minimum(least, (s[i:i + _CHUNK, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), key (digest of the set), tokens (of all trees), sketch."""
    n_tokens = TREES * _TOKENS
    schema = T.StructType([docs.schema["doc_id"], T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()),
                           T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, (a, b) = WordHashes(), _coefficients(n_tokens + SKETCH)
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingle_set(hashes, text, k)
                if len(s):
                    m = minwise(s, a, b)
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                                m[:n_tokens].view(np.int32), m[n_tokens:].astype(np.uint8).tobytes()))
                else:
                    out.append((0, None, None, None))
            got = pd.DataFrame(out, columns=["n", "key", "tokens", "sketch"])
            got.insert(0, "doc_id", batch["doc_id"].to_numpy())
            got.insert(1, "th", batch["th"].to_numpy())
            yield got

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInPandas(run, schema)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sketches x (rows) and y (columns) match in ALIKE bytes at least."""
    out = np.empty((len(x), len(y)), dtype=bool)
    for i in range(0, len(x), 64):
        out[i:i + 64] = (x[i:i + 64, None, :] == y[None, :, :]).sum(axis=2, dtype=np.uint8) >= ALIKE
    return out


class _Union:
    """Union-find whose roots are the least members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of equal ``by`` from batches sorted by it, one frame per run."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        new = np.zeros(len(b), dtype=bool)
        for c in by:
            v = b[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(new)
        at = 0
        for c in cuts:
            yield b.iloc[at:c]
            at = c
        rest = b.iloc[at:]
    if rest is not None and len(rest):
        yield rest


def _compare_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning edges of the alike members of each node (rows sorted by node)."""
    edges: list[tuple[int, int]] = []
    for node in _runs(batches, ["node"]):
        if len(node) < 2:
            continue
        ids = node["id"].to_numpy()
        s = np.frombuffer(b"".join(node["sketch"]), dtype=np.uint8).reshape(len(ids), SKETCH)
        uf = _Union(len(ids))
        for i, j in zip(*np.nonzero(np.triu(_alike(s, s), 1))):
            uf.join(int(i), int(j))
        edges += [(int(ids[i]), int(ids[r])) for i in range(len(ids)) if (r := uf.root(i)) != i]
        if len(edges) > 50_000:
            yield pd.DataFrame(edges, columns=["u", "v"])
            edges = []
    yield pd.DataFrame(edges, columns=["u", "v"], dtype="int64")


def _candidates(classes: DataFrame) -> DataFrame:
    """Edges (u, v) between classes (id, tokens, sketch) that share a small
    node and look alike, or share a node that is still large at the last level."""
    n, edges = width(classes.sparkSession), None
    level = classes.select("id", "sketch", F.explode(F.expr(
        f"transform(sequence(0, {TREES - 1}), t -> named_struct('t', t, 'own', slice(tokens, t * {_TOKENS} + 1, {_TOKENS})))"
    )).alias("x")).select("id", "sketch", "x.own", F.xxhash64("x.t", F.col("x.own")[0]).alias("node"))
    for depth in range(1, LEVELS + 1):
        level = checkpointed(level) if depth > 1 else level
        sizes = level.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("least")).where("size > 1")
        sizes = checkpointed(sizes)
        small = (level.select("id", "sketch", "node").join(sizes.where(f"size <= {SMALL}").select("node"), "node")
                 .repartition(n, "node").sortWithinPartitions("node", "id").mapInPandas(_compare_small, "u long, v long"))
        edges = small if edges is None else edges.unionByName(small)
        large = sizes.where(f"size > {SMALL}")
        if large.isEmpty():
            break
        if depth == LEVELS:
            edges = edges.unionByName(level.join(large, "node").select(F.col("id").alias("u"), F.col("least").alias("v")))
            break
        at = 1 + BRANCHES * (depth - 1)
        level = level.join(large.select("node"), "node").select("id", "sketch", "own", F.explode(F.expr(
            f"transform(sequence({at}, {at + BRANCHES - 1}), j -> xxhash64(node, j, own[j]))")).alias("node"))
    return edges


def _links(a: list, b: list, uf: _Union, ia: np.ndarray, ib: np.ndarray, near: np.ndarray, num: int, den: int) -> None:
    """Join in ``uf`` the members whose sets reach num/den; pairs that are
    joined already are not compared.  near: the pairs worth comparing."""
    for i in range(len(a)):
        for j in np.flatnonzero(near[i]):
            p, q = int(ia[i]), int(ib[j])
            if uf.root(p) == uf.root(q):
                continue
            x, y = (a[i], b[j]) if len(a[i]) <= len(b[j]) else (b[j], a[i])
            if den * len(x) < num * len(y):
                continue
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if den * both >= num * (len(x) + len(y) - both):
                uf.join(p, q)


def _confirm(k: int, num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (grp, blk, home, role, id, sketch, text) sorted by grp, blk, home, role.
        role 0: visitors from block home, to be compared with all; 1: the block's own members."""
        hashes, out = WordHashes(), []
        for g in _runs(batches, ["grp", "blk", "home"]):
            ids = g["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            g, ids = g.iloc[order], ids[order]
            own = g["role"].to_numpy() == 1
            sets = [shingle_set(hashes, t, k) for t in g["text"]]
            s = np.frombuffer(b"".join(g["sketch"]), dtype=np.uint8).reshape(len(ids), SKETCH)
            uf = _Union(len(ids))
            for i in range(1, len(ids)):  # the same document twice
                if ids[i] == ids[i - 1]:
                    uf.join(i, i - 1)
            if own.all():
                near = np.triu(_alike(s, s), 1)
                _links(sets, sets, uf, np.arange(len(ids)), np.arange(len(ids)), near, num, den)
            else:
                v, o = np.flatnonzero(~own), np.flatnonzero(own)
                _links([sets[i] for i in v], [sets[i] for i in o], uf, v, o, _alike(s[v], s[o]), num, den)
            out += [(int(ids[i]), int(ids[uf.root(i)])) for i in range(len(ids)) if ids[uf.root(i)] != ids[i]]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["u", "v"])
                out = []
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (grp, blk, home, role, id, sketch) sorted by grp, blk, home: the members
    of each pair of blocks that look like one of the other block."""
    for g in _runs(batches, ["grp", "blk", "home"]):
        own = g["role"].to_numpy() == 1
        s = np.frombuffer(b"".join(g["sketch"]), dtype=np.uint8).reshape(len(g), SKETCH)
        near = _alike(s[~own], s[own])
        stay = np.zeros(len(g), dtype=bool)
        stay[~own], stay[own] = near.any(axis=1), near.any(axis=0)
        yield g.loc[stay, ["grp", "blk", "home", "role", "id"]]


def _confirmed(docs: DataFrame, classes: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges between classes (id, doc_id and th of their text, sketch, n) whose sets
    reach the threshold.  groups: u, v (class and the least class of its candidate group)."""
    n = width(docs.sparkSession)
    member = groups.select(F.col("u").alias("id"), F.col("v").alias("grp")).unionByName(
        groups.select(F.col("v").alias("id"), F.col("v").alias("grp")).distinct())
    member = member.join(classes.select("id", "doc_id", "th", "sketch", "n"), "id")
    sizes = member.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    member = member.drop("n").join(sizes.select("grp", F.ceil(F.greatest(
        F.col("size") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "grp")
    full = checkpointed(member.join(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), ["doc_id", "th"]).drop("doc_id", "th").withColumn(
        "blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    # one block: done in one pass.  More: every block also gets the group's least member as
    # its own, so whatever is linked with that one is in one component at once
    first = full.unionByName(full.where("blocks > 1 and id = grp").withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("at <> blk").withColumn("blk", F.col("at")).drop("at"))

    by = ["grp", "blk", "home"]

    def compare(rows: DataFrame) -> DataFrame:
        return (rows.select(*by, "role", "id", "sketch", "text").repartition(n, *by)
                .sortWithinPartitions(*by, "role").mapInPandas(_confirm(k, num, den), "u long, v long"))

    edges = checkpointed(compare(first.withColumn("home", F.col("blk")).withColumn("role", F.lit(1))))
    big = full.where("blocks > 1")
    if big.isEmpty():
        return edges
    # members that are not yet in the component of the least one are compared with every other block of the group
    joined = edges.join(big.select(F.col("grp").alias("v")).distinct(), "v", "left_semi").select(F.col("u").alias("id"))
    strangers = big.where("id <> grp").join(joined.distinct(), "id", "left_anti")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    visits = strangers.select("grp", every.alias("blk"), F.col("blk").alias("home"), F.lit(0).alias("role"), "id", "sketch").where("blk <> home")
    homes = strangers.select("grp", F.col("blk").alias("home")).distinct()
    hosts = big.join(homes, "grp").where("blk <> home").select(*by, F.lit(1).alias("role"), "id", "sketch")
    grp = full.schema["grp"].dataType.simpleString()
    met = checkpointed(visits.unionByName(hosts).repartition(n, *by).sortWithinPartitions(*by).mapInPandas(
        _meetings, f"grp {grp}, blk int, home int, role int, id {grp}"))
    return edges.unionByName(compare(met.join(big.select("grp", "id", "sketch", "text"), ["grp", "id"])))


def near_duplicates(docs: DataFrame, shingle: int = 2, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents (doc_id, text) linked by den * both >= num * union of
    their shingle sets.  Returns doc_id, n_shingles, component_id (least doc_id
    reachable) and kept (doc_id is that least one).

    Nulls: a text that is null, empty or blank has an empty set and is linked
    with nothing; a row without doc_id is linked with nothing, has no
    component and is kept.  A text shorter than a shingle is one shingle.
    Repeated rows count as one document and come out as often as they came
    in; an id with several texts is linked through each of them.  doc_id may be
    of any type that has an order.  An empty table gives no rows; other columns
    are not read.
    """
    n = width(docs.sparkSession)
    sets = checkpointed(_sketches(docs, shingle))
    usable = sets.where("doc_id is not null and n > 0")
    # classes are numbered in the order of their least document, so the least class of a component has its least document
    classes = checkpointed(usable.groupBy("key").agg(F.min(F.struct("doc_id", "th", "tokens", "sketch", "n")).alias("x")).select(
        "key", "x.doc_id", "x.th", "x.tokens", "x.sketch", "x.n").repartitionByRange(n, "doc_id", "key")
        .sortWithinPartitions("doc_id", "key").withColumn("id", F.monotonically_increasing_id()))
    edges = _confirmed(docs, classes, components(_candidates(classes)), shingle, num, den)
    # a document id that occurs with several texts ties their classes together
    several = usable.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("doc_id")
    if several.count():
        held = usable.join(several, "doc_id", "left_semi").select("doc_id", "key").distinct().join(classes.select("key", "id"), "key")
        least = held.groupBy("doc_id").agg(F.min("id").alias("v"))
        edges = edges.unionByName(held.join(least, "doc_id").select(F.col("id").alias("u"), "v"))
    links = components(edges)
    roots = links.groupBy("v").agg(F.count("*").alias("members")).join(
        classes.select(F.col("id").alias("v"), F.col("doc_id").alias("component_id")), "v")
    named = join_hot(links, checkpointed(roots), "v", "members", links.count()).select("u", "component_id")
    comp = classes.select("key", F.col("id").alias("u"), "doc_id").join(named, "u", "left").select(
        "key", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sets.select("doc_id", "n", "key").join(comp, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
