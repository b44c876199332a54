"""The taxonomy as nested intervals, so that "all below this taxon" is a range.

Nodes are numbered in pre-order.  Subtree sizes and depths come from pointer
doubling along the parents: a round adds to every node what hangs below the nodes
that point to it, then points twice as far up.  A tree of any shape takes as many
rounds as its depth has binary digits, however many nodes it has, and nodes that have
passed the top take no further part.  With the sizes, a node's number is the sum of the
places that it and its ancestors have among their siblings, added up along the same
pointers.  Many nodes point to one ancestor, so these look-ups go by ``lookup_join``.

A taxon's interval then holds exactly the numbers of its descendants, and sums over
subtrees are differences of running sums.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens.operators.joins import lookup_join
from hostlens.operators.ordering import global_rank
from hostlens.session import cut_lineage, ensure_checkpoint_dir

BLOCK = 4096


def edges_from_lineages(taxa: DataFrame, name: str, lineage: str, sep: str = ";") -> DataFrame:
    """(node, parent) of every taxon and of the ancestors in its ``;``-separated lineage, outermost first."""
    steps = F.filter(F.transform(F.split(F.coalesce(F.col(lineage), F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")
    path = F.concat(F.array(F.lit(None).cast("string")), steps, F.array(F.col(name)))
    return taxa.where(F.col(name).isNotNull()).select(F.explode(F.arrays_zip(
        F.slice(path, 2, F.size(path) - 1).alias("node"), F.slice(path, 1, F.size(path) - 1).alias("parent"))).alias("e")) \
        .select(F.col("e.node").alias("node"), F.col("e.parent").alias("parent")).distinct()


def _stored(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read again.  A checkpoint keeps the estimated size of
    its plan, which joins multiply: over many rounds it grows past all numbers."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tree/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _ahead(nodes: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Left join with a table that has each ``key`` once; rows with a null key are not shuffled."""
    more = [c for c in found.columns if c != key]
    rest = nodes.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in more])
    # a union has the partitions of all its sides, so without this they would multiply from round to round
    return lookup_join(nodes.where(F.col(key).isNotNull()), found, key).unionByName(rest).coalesce(
        int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _jump(nodes: DataFrame) -> DataFrame:
    """Every node (r, ptr, size, depth) pointing twice as far up.

    size: nodes below it, itself included, on fewer levels than it points up; depth: levels
    it has passed.  Sizes on a cycle mean nothing and may outgrow their type, which is no error."""
    up = nodes.select(F.col("r").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("depth").alias("depth2")).where("ptr IS NOT NULL")
    below = nodes.where("ptr IS NOT NULL").groupBy(F.col("ptr").alias("r")).agg(F.try_sum("size").alias("more"))
    return _ahead(nodes, "ptr", up).join(below, "r", "left").select(
        "r", F.col("ptr2").alias("ptr"), F.try_add("size", F.coalesce("more", F.lit(0))).alias("size"),
        (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))


def _numbers(places: DataFrame, ladder: list[DataFrame]) -> DataFrame:
    """r and lo: the sum of ``place`` over a node and its ancestors.  places: r and place;
    ladder: r and ptr, the ancestor one, two, four, ... levels up."""
    sums = places.select("r", F.col("place").alias("lo"))
    for step in ladder:
        above = sums.select(F.col("r").alias("ptr"), F.col("lo").alias("lo2"))
        pointing = _stored(sums.join(step.select("r", "ptr"), "r"))
        sums = _stored(_ahead(pointing, "ptr", above).select("r", (F.col("lo") + F.coalesce("lo2", F.lit(0))).alias("lo")))
    return sums


def nested_intervals(edges: DataFrame) -> DataFrame:
    """node, parent, depth (1 at the top), lo, hi: the descendants of a node, itself
    included, have exactly the numbers lo to hi as their lo.  Children go by node.

    edges: node and parent.  A node without a parent, or whose parent is no node,
    is a root.  Of several parents of a node the least counts; rows without a
    node are left out; nodes on or below a cycle have no place and are left out.
    """
    one = edges.where("node IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent"))
    one = cut_lineage(one)
    known = one.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    one = lookup_join(one, known, "parent").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    nodes = cut_lineage(global_rank(cut_lineage(one), ["parent", "node"], name="r"))
    total = nodes.count()
    parents = nodes.select(F.col("node").alias("parent"), F.col("r").alias("up"))
    nodes = _stored(_ahead(nodes, "parent", parents))
    one_each = F.lit(1).cast("bigint")
    tree = _stored(nodes.select("r", F.col("up").alias("ptr"), one_each.alias("size"), one_each.alias("depth")))
    ladder: list[DataFrame] = []
    while len(ladder) < total.bit_length() and not tree.where("ptr IS NOT NULL").isEmpty():
        ladder.append(tree)
        tree = _stored(_jump(tree))
    # what still points on goes round in a circle
    tree = nodes.join(tree.where("ptr IS NULL").select("r", "size", "depth"), "r")
    # the place among siblings: nodes are ranked by parent, so it is a difference of running sums over the ranks
    upto = running_sums(tree.select(F.col("r").alias("lo"), "size"), "size").withColumnRenamed("lo", "r")
    tree = _stored(tree.join(upto, "r").withColumn("before", F.col("upto") - F.col("size")).drop("upto"))
    first = tree.where("up IS NOT NULL").groupBy("up").agg(F.min("before").alias("first"))
    places = _ahead(tree.select("r", "up", "before"), "up", first)
    numbers = _numbers(_stored(places.select("r", (F.col("before") - F.coalesce("first", F.lit(0)) + 1).alias("place"))), ladder)
    return tree.join(numbers, "r").select("node", "parent", "depth", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"))


def running_sums(tree: DataFrame, value: str) -> DataFrame:
    """lo and upto, the sum of ``value`` over all numbers up to lo: sums inside blocks of
    consecutive numbers, on top of the sums of the blocks before."""
    rows = tree.select("lo", value, F.expr(f"lo DIV {BLOCK}").alias("blk"))
    here = F.sum(value).over(Window.partitionBy("blk").orderBy("lo"))
    before = F.sum("total").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))
    # one row per BLOCK numbers
    blocks = rows.groupBy("blk").agg(F.sum(value).alias("total")).select("blk", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.withColumn("here", here).join(blocks, "blk").select("lo", (F.col("here") + F.col("before")).alias("upto"))


def subtree_sums(tree: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """``tree`` (nested_intervals) plus n_below (descendants) and ``value`` summed over each
    node and all below it.  values: node and the column ``value``, at most one row per node."""
    own = cut_lineage(tree.join(values.select("node", value), "node", "left").withColumn(value, F.coalesce(value, F.lit(0).cast("bigint"))))
    sums = cut_lineage(running_sums(own, value))
    upto = sums.select(F.col("lo").alias("hi"), F.col("upto").alias("last"))
    return own.join(sums, "lo").join(upto, "hi").select(
        "node", "parent", "depth", "lo", "hi", (F.col("hi") - F.col("lo")).alias("n_below"),
        (F.col("last") - F.col("upto") + F.col(value)).alias(value))


def members(tree: DataFrame, asked: DataFrame, block: int = 1024) -> DataFrame:
    """(taxon, node): every descendant of each ``taxon`` asked for, itself included.  A range
    join by blocks of numbers: an interval meets each block it touches once."""
    spans = asked.select(F.col("taxon").alias("node")).distinct().join(tree.select("node", "lo", "hi"), "node").select(
        F.col("node").alias("taxon"), F.col("lo").alias("from"), F.col("hi").alias("to")) \
        .withColumn("blk", F.explode(F.expr(f"sequence(`from` DIV {block}, `to` DIV {block})")))
    return spans.join(tree.select("node", "lo", F.expr(f"lo DIV {block}").alias("blk")), "blk").where("lo BETWEEN `from` AND `to`").select("taxon", "node")
