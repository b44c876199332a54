"""Prefix trie of conversations by collapse of whole sequences.

Every conversation is spelled as the digests of its prefixes: a polynomial
hash over the digests of its turns, modulo a Mersenne prime.  Equal
conversations have an equal last digest and collapse into one weighted sequence
with the list of the conversations that end there; only one representative of
each goes on.  A sequence whose last digest is a proper prefix of another one
falls out by an anti-join, the others are the leaves.  Prefixes of the weighted
sequences are then aggregated to the nodes of the trie.

Sums over subtrees need no walk of the tree.  Every node is owned by the
sequence of its least member; a sequence adds what it owns below a prefix, a
suffix sum along the sequence, to that prefix, and one aggregation by prefix
gives the sum over the subtree.

Rows are dealt out by ranges of (conversation, turn), so a conversation of any
length may span many tasks: polynomial hashes of its parts combine, each task
reports those of its first and last conversation and the driver chains the
few that cross a border.  Suffix sums go by blocks of ``BLOCK`` turns.  Joins on
a prefix or a conversation broadcast the few keys that hold many rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import checkpointed, join_hot, width

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation prefixes").digest()[:15], "big")
MOST_BORROWED = 3
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
_CHUNK = 1 << 20
_ROOT = f"{0:032x}"


def _extend(h: int, turns: list[tuple]) -> Iterator[int]:
    """Digests of the prefixes that end with each of ``turns`` (digest first)."""
    for t in turns:
        h = (h * BASE + int.from_bytes(t[0], "big")) % PRIME
        yield h


def _kept(rows: list[tuple], skip: int) -> list[tuple]:
    """(digest, words) of the rows without the first ``skip`` own ones."""
    own = [r[1:] for r in rows if r[0]]
    return [r[1:] for r in rows if not r[0]] + own[skip:]


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list]]:
    """((part, conversation, turns it borrows), rows) of each conversation in a task."""
    def rows():
        for b in batches:
            yield from zip(*(b[c].tolist() for c in ("part", "conv", "h", "own", "dig", "words")))

    for at, run in itertools.groupby(rows(), key=lambda r: r[:3]):
        yield at, [r[3:] for r in run]


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per task: its first and last conversation, their own rows, and length
    and digest of what remains of them after 0 to MOST_BORROWED own rows."""
    def of(rows):
        parts = [_kept(rows, j) for j in range(MOST_BORROWED + 1)]
        return [[sum(map(bool, (r[0] for r in rows))), *map(len, parts)]], [[f"{[0, *_extend(0, p)][-1]:x}" for p in parts]]

    first = last = None
    n = 0
    for at, rows in _conversations(batches):
        first, last, n = first or (at, of(rows)), (at, rows), n + 1
    if n:
        a, b = first[1], of(last[1])
        yield pd.DataFrame({"part": [first[0][0]], "n": [n], "first": [first[0][1]], "last": [last[0][1]], "h": [last[0][2]],
                            "a": a[0], "ah": a[1], "b": b[0], "bh": b[1]})


def _borders(dealt: DataFrame) -> dict[tuple[int, int], tuple]:
    """(part, conversation) -> (first part, depth before, digest before, own rows still
    to skip, whole length) of the conversations that cross tasks."""
    tasks = sorted(dealt.mapInPandas(_report, "part int, n int, first long, last long, h int, a array<long>, ah array<string>, "
                                              "b array<long>, bh array<string>").collect(), key=lambda r: r["part"])  # one row per task
    known, i = {}, 0
    while i < len(tasks):
        j = i
        while j + 1 < len(tasks) and tasks[j]["last"] == tasks[j + 1]["first"] and (j == i or tasks[j]["n"] == 1):
            j += 1
        if j > i:
            depth, h, skip, at = 0, 0, tasks[i]["h"], []
            for k in range(i, j + 1):
                counts, digests = (tasks[k]["b"], tasks[k]["bh"]) if k == i else (tasks[k]["a"], tasks[k]["ah"])
                at.append((k == i, depth, h, skip))
                n = counts[1 + skip]
                depth, h = depth + n, (h * pow(BASE, n, PRIME) + int(digests[skip], 16)) % PRIME
                skip = max(skip - counts[0], 0)
            known |= {(tasks[k]["part"], tasks[i]["last"]): (*x, depth) for k, x in zip(range(i, j + 1), at)}
        i = j if j > i else i + 1
    return known


_PREFIXES = "conv long, depth long, node string, parent string, words long, last boolean"


def _spelled(known: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, names = [], [c.split()[0] for c in _PREFIXES.split(", ")]
        for (part, conv, h), rows in _conversations(batches):
            first, depth, before, skip, total = known.get((part, conv), (True, 0, 0, h, None))
            turns = _kept(rows, skip)
            total = len(turns) if total is None else total
            if first:
                out.append((conv, 0, _ROOT, None, 0, total == 0))
            parent = f"{before:032x}"
            for d, (node, (_, words)) in enumerate(zip(_extend(before, turns), turns), depth + 1):
                node = f"{node:032x}"
                out.append((conv, d, node, parent, words, d == total))
                parent = node
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)
    return run


def spell(turns: DataFrame, donor: Column | None = None, borrowed: Column | None = None) -> DataFrame:
    """Prefixes of every conversation: conv, depth, node (digest of the prefix), parent,
    words (in the last text), last (whether the conversation ends here).  ``donor``
    and ``borrowed`` as in ``prefix_trie``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").isNotNull().alias("t1"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.unhex(F.substring(digest, 1, 32)).alias("dig"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ["conv", "own", "t1", "turn", "dig"]
    h = F.lit(0) if borrowed is None else borrowed
    own = rows.select("*", F.lit(True).alias("own"), h.cast("int").alias("h"))
    if donor is not None:
        asks = rows.select("conv").distinct().select("conv", donor.alias("donor"), h.cast("int").alias("h")).where("h > 0")
        first = rows.join(asks.select(F.col("donor").alias("conv")).distinct(), "conv", "left_semi").withColumn(
            "rn", F.row_number().over(Window.partitionBy("conv").orderBy("t1", "turn", "dig"))).where(F.col("rn") <= MOST_BORROWED)
        lent = asks.join(first.withColumnRenamed("conv", "donor"), "donor").where("rn <= h")
        own = own.unionByName(lent.select("conv", "t1", "turn", "dig", "words", F.lit(False).alias("own"), "h"))
    dealt = checkpointed(own.repartitionByRange(width(turns.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    return checkpointed(dealt.mapInPandas(_spelled(_borders(dealt)), _PREFIXES))


def _ids(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator[str]]]:
    def rows():
        for b in batches:
            yield from zip(b["part"].tolist(), b["node"].tolist(), b["conv"].tolist())

    for at, run in itertools.groupby(rows(), key=lambda r: r[:2]):
        yield at, (str(r[2]) for r in run)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for (_, node), ids in _ids(batches):
        out.append((node, hashlib.sha256(",".join(ids).encode()).hexdigest()))
        if len(out) >= 20_000:
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
            out = []
    yield pd.DataFrame(out, columns=["node", "ends_sha256"])


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for (part, node), ids in _ids(batches):
        for n in itertools.count():
            body = ",".join(itertools.islice(ids, _CHUNK // 20))
            if not body:
                break
            yield pd.DataFrame({"part": [part], "piece": [n], "node": [node], "body": [body]})


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows():
        for b in batches:
            yield from zip(b["node"].tolist(), b["body"].tolist())

    for node, run in itertools.groupby(rows(), key=lambda r: r[0]):
        sha = hashlib.sha256()
        for i, (_, body) in enumerate(run):
            sha.update(("," if i else "").encode() + body.encode())
        yield pd.DataFrame({"node": [node], "ends_sha256": [sha.hexdigest()]})


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids ``conv`` of each ``node``.  Ids are joined where
    the range of a task ends; one task per node only hashes these pieces, in order."""
    n = width(ends.sparkSession)
    dealt = checkpointed(ends.select("node", "conv").repartitionByRange(n, "node", "conv").sortWithinPartitions("node", "conv")
                         .withColumn("part", F.spark_partition_id()))
    tasks = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.min("node"), F.max("node")).collect())  # one row per task
    cross = F.col("node").isin(sorted({a[2] for a, b in zip(tasks, tasks[1:]) if a[2] == b[1]}))
    pieces = dealt.where(cross).mapInPandas(_pieces, "part int, piece long, node string, body string")
    return dealt.where(~cross).mapInPandas(_hashed, "node string, ends_sha256 string").unionByName(
        pieces.repartition(n, "node").sortWithinPartitions("node", "part", "piece").mapInPandas(_joined, "node string, ends_sha256 string"))


def _below(prefixes: DataFrame, owned: DataFrame) -> DataFrame:
    """node and tokens: for every prefix of a sequence, what the sequence owns from there on."""
    rows = prefixes.join(owned, ["rep", "depth"], "left").select(
        "rep", "depth", "node", F.expr(f"depth DIV {BLOCK}").alias("blk"), F.coalesce("own", F.lit(0)).alias("own"))
    here = F.sum("own").over(Window.partitionBy("rep", "blk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    later = F.sum("total").over(Window.partitionBy("rep").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("rep", "blk").agg(F.sum("own").alias("total")).select("rep", "blk", F.coalesce(later, F.lit(0)).alias("later"))
    return rows.withColumn("here", here).join(blocks, ["rep", "blk"]).select("node", (F.col("here") + F.col("later")).alias("tokens"))


def prefix_trie(turns: DataFrame, donor: Column | None = None, borrowed: Column | None = None) -> DataFrame:
    """Nodes of the trie of the conversations in ``turns`` (conv_id, turn, role, text).

    One row per distinct sequence of first turns (role, text), the root included:
    node and parent (digests), conv_id (least member), depth, parent_conv_id, n_convs
    (conversations that begin so), n_children, n_leaves (below, or itself),
    saved_tokens (over the subtree, the words of each last text times the
    conversations that share it but one) and ends_sha256 (of the ids that end here).

    With ``donor`` and ``borrowed`` (columns over ``conv``) a conversation begins with
    the first ``borrowed`` turns, at most three, of conversation ``donor`` instead of
    as many of its own; fewer if that has fewer, none if it does not exist.

    Turns go by number, nulls first; turns of one number by the digest of role
    and text, so the order of rows never matters.  A null role or text is
    empty, rows without conv_id are left out, repeated rows are turns of their
    own.  conv_id and turn must be integers.  Texts of any length are digested
    inside the scan and go no further.  An empty table has no nodes; other columns are not read.
    """
    spelled = spell(turns, donor, borrowed)
    ends = spelled.where("last")
    whole = ends.groupBy("node").agg(F.count("*").alias("w"), F.min("conv").alias("rep"), (F.max("depth") + 1).alias("rows"))
    leaves = whole.join(spelled.where("NOT last").select("node").distinct(), "node", "left_anti").select("rep", F.lit(1).alias("leaf"))
    sequences = checkpointed(whole.join(leaves, "rep", "left").select("rep", "w", F.coalesce("leaf", F.lit(0)).alias("leaf"), "rows"))
    prefixes = checkpointed(join_hot(spelled.withColumnRenamed("conv", "rep").drop("last"), sequences, "rep", "rows", spelled.count())
                            .where("w IS NOT NULL"))
    nodes = checkpointed(prefixes.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.sum("w").alias("n_convs"),
        F.min("rep").alias("conv_id"), F.sum("leaf").alias("n_leaves")))
    owned = nodes.select(F.col("conv_id").alias("rep"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    saved = _below(prefixes, owned).groupBy("node").agg(F.sum("tokens").alias("saved_tokens"))
    children = checkpointed(nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(children, "parent")
    out = join_hot(nodes, parents.withColumnRenamed("n_children", "siblings"), "parent", "siblings", nodes.count())
    return (out.join(children.withColumnRenamed("parent", "node"), "node", "left").join(saved, "node").join(end_digests(ends), "node", "left")
            .select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


def shared_openings(turns: DataFrame) -> DataFrame:
    """The trie after conversation c took over its first crc32(c) mod 4 turns from conversation c - c % 20."""
    return prefix_trie(turns, F.expr("conv - conv % 20"), F.crc32(F.col("conv").cast("string").cast("binary")) % 4)
