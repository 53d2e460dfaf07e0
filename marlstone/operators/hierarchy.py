"""Parent-child links of unknown depth to full hierarchies.

Nested sets by list ranking. Every node gives two steps of a tour through its tree, one
down into it and one up out of it, and each step knows its successor. Pointer doubling then
finds for each step how many steps follow, which gives subtree sizes and preorder ranges, and
the sum of the ups and downs that follow, which gives the depth. A tree of depth d needs
log2(2 * nodes) rounds of one equi-join each instead of d level-by-level rounds, and a chain
of a million links is no worse than a bush. Steps that reach no end belong to nodes whose
links run in circles; those alone are followed upward for the smallest key of their circle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.storage import Scratch

#: Trees with a thousandth of all steps or more; there cannot be more than a thousand of them.
LARGE_TREES = 1_000
#: Children of one parent that one task orders at a time.
SIBLINGS_PER_TASK = 10_000


def latest_links(df: DataFrame, node: str, parent: str, revised: str | None) -> DataFrame:
    """One row (node, parent) per node: its newest revision; ties take the larger parent."""
    at = F.col(revised) if revised else F.lit(0)
    return df.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(
        F.max(F.struct(at.isNotNull(), at.alias("t"), F.col(parent).alias("p")))["p"].alias("parent"))


def nested_sets(links: DataFrame, siblings_per_task: int = SIBLINGS_PER_TASK) -> DataFrame:
    """Root, depth and nested-set range of each node, by list ranking instead of subtree sizes level by level (see the module).

    links: node, parent (strings, one row per node, see latest_links). A parent that is null,
    blank or no node makes a root of depth 0. Siblings are ordered by a hash bucket and the key.

    Returns node, parent (null for roots), root, depth, lft, rgt, n_descendants. Node a is an
    ancestor of b if root is equal and a.lft < b.lft < a.rgt. Nodes on a circle, or below one,
    have the circle's smallest key as root, depth -1 and no range.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "nested-sets")
    ids = scratch.keep(links.select("node", "parent").withColumn("id", F.monotonically_increasing_id()))
    up = ids.select(F.col("node").alias("parent"), F.col("id").alias("pid"))
    nodes = scratch.keep(ids.join(up, "parent", "left").select("id", "node", "pid"))
    n = nodes.count()
    tour = scratch.keep(_tour(nodes, siblings_per_task))
    ranked, looping = _rank(tour, scratch)
    down = ranked.where("step % 2 = 0")
    ends = ranked.where("step % 2 = 1")
    # what follows a step down minus what follows its step up: the subtree's own tour
    node_of = F.floor(F.col("step") / 2).alias("id")
    d = down.select(node_of, F.col("after").alias("a"), F.col("sum").alias("depth_after"), F.col("tail"))
    u = ends.select(node_of, F.col("after").alias("b"))
    both = d.join(u, "id")
    # the root's own range spans its tree: its tour starts with everything still to come
    roots = both.join(nodes.where("pid is null").select("id", F.col("node").alias("root")), "id").select(
        F.col("tail"), F.col("a").alias("a0"), "root")
    # a large tree is one key for all its nodes: its root is sent along instead; at most LARGE_TREES hold that share of the steps
    large = roots.where(F.col("a0") + 1 >= max(2, -(-2 * n // LARGE_TREES))).select("tail", F.col("a0").alias("large_a0"), F.col("root").alias("large_root"))
    both = both.join(F.broadcast(large), "tail", "left").withColumn("tail", F.when(F.col("large_root").isNull(), F.col("tail")).otherwise(-F.col("id") - 1))
    names = ids.select(F.col("id").alias("pid"), F.col("node").alias("parent"))
    trees = (
        both.join(roots, "tail", "left")
        .withColumns({"a0": F.coalesce("large_a0", "a0"), "root": F.coalesce("large_root", "root")})
        .join(nodes, "id")
        .join(names, "pid", "left")
        .select(
            "node", "parent", "root",
            (-F.col("depth_after") - 1).cast("int").alias("depth"),
            (F.col("a0") - F.col("a")).cast("long").alias("lft"),
            (F.col("a0") - F.col("b")).cast("long").alias("rgt"),
            ((F.col("a") - F.col("b") - 1) / 2).cast("long").alias("n_descendants"),
        )
    )
    if not looping:
        return trees
    circles = _circles(nodes.join(ranked.where("step % 2 = 0").select(node_of), "id", "left_anti"), n, scratch)
    circles = circles.join(nodes, "id").join(names, "pid", "left").select(
        "node", "parent", "root", F.lit(-1).alias("depth"), F.lit(None).cast("long").alias("lft"),
        F.lit(None).cast("long").alias("rgt"), F.lit(None).cast("long").alias("n_descendants"))
    return trees.unionByName(circles)


def _tour(nodes: DataFrame, siblings_per_task: int) -> DataFrame:
    """Successor of every step: step 2*id goes down into node id, 2*id+1 up out of it."""
    kids = nodes.where("pid is not null").select("pid", "id", "node")
    counts = kids.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    # a parent of many children is cut into buckets, so that no task orders them all
    kids = kids.join(counts, "pid").withColumn(
        "bucket", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / siblings_per_task)).cast("int"))
    w = Window.partitionBy("pid", "bucket").orderBy("node", "id")
    kids = kids.select("pid", "bucket", "id", F.lead("id").over(w).alias("nxt"), F.row_number().over(w).alias("no"))
    heads = kids.where("no = 1").select("pid", "bucket", F.col("id").alias("head"))
    across = Window.partitionBy("pid").orderBy("bucket")
    heads = heads.select("pid", "bucket", "head", F.lead("head").over(across).alias("nxt_head"), F.row_number().over(across).alias("bno"))
    kids = kids.join(heads.select("pid", "bucket", "nxt_head"), ["pid", "bucket"])
    sibling = F.coalesce("nxt", "nxt_head")
    ups = kids.select(
        (F.col("id") * 2 + 1).alias("step"), F.when(sibling.isNotNull(), sibling * 2).otherwise(F.col("pid") * 2 + 1).alias("nxt"))
    tops = nodes.where("pid is null").select((F.col("id") * 2 + 1).alias("step"), F.lit(None).cast("long").alias("nxt"))
    first = heads.where("bno = 1").select(F.col("pid").alias("id"), "head")
    downs = nodes.select("id").join(first, "id", "left").select(
        (F.col("id") * 2).alias("step"), F.coalesce(F.col("head") * 2, F.col("id") * 2 + 1).alias("nxt"))
    return ups.unionByName(tops).unionByName(downs)


def _rank(tour: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """step, after (steps that follow), sum (ups and downs that follow), tail (last step); looping steps are left out.

    Finished steps are set aside, so that a round only moves the steps still under way and
    looks up both kinds.
    """
    sign = F.when(F.col("nxt").isNull(), 0).when(F.col("nxt") % 2 == 0, 1).otherwise(-1)
    state = scratch.keep(tour.select(
        "step", F.coalesce("nxt", "step").alias("at"), F.when(F.col("nxt").isNull(), 0).otherwise(1).cast("long").alias("after"),
        sign.cast("long").alias("sum"), F.col("nxt").isNull().alias("done")))
    open_before = None
    while True:
        left = state.where("not done").count()
        if left == 0 or left == open_before:
            break
        open_before = left
        there = state.select(F.col("step").alias("at"), F.col("at").alias("at2"), F.col("after").alias("after2"), F.col("sum").alias("sum2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(there, "at").select(
            "step", F.col("at2").alias("at"), (F.col("after") + F.col("after2")).alias("after"), (F.col("sum") + F.col("sum2")).alias("sum"), F.col("done2").alias("done"))
        nxt = scratch.keep(state.where("done").unionByName(moved))
        scratch.drop(state)
        state = nxt
    done = state.where("done").select("step", "after", "sum", F.col("at").alias("tail"))
    return done, left > 0


def _circles(nodes: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """id and root (smallest key of the circle reached) of nodes whose links never end."""
    state = scratch.keep(nodes.select("id", F.col("pid").alias("at"), F.col("node").alias("least")))
    size = state.count()
    for _ in range(max(1, math.ceil(math.log2(max(2, size))))):
        there = state.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("least").alias("least2"))
        nxt = scratch.keep(state.join(there, "at").select("id", F.col("at2").alias("at"), F.least("least", "least2").alias("least")))
        scratch.drop(state)
        state = nxt
    # after more steps than there are nodes every pointer stands on its circle, and the
    # smallest key of as many steps from there is the circle's
    on = state.select(F.col("id").alias("at"), F.col("least").alias("root"))
    return state.select("id", "at").join(on, "at").select("id", "root")


def node_paths(sets: DataFrame, separator: str = "/") -> DataFrame:
    """node and path (keys from the root) of every node in a tree, by joining nested-set ranges.

    The ancestors of a node are those whose range contains its lft. Ranges are cut at the nodes
    of a power-of-two grid (each range covers at most two cells a level), so the join is an
    equi-join on (root, level, cell). A path is as long as the node is deep; use it for output.
    """
    spans = sets.where("lft is not null")
    top = max(1, (spans.agg(F.max("rgt")).first()[0] or 1).bit_length())
    bits = F.length(F.bin(F.col("rgt").bitwiseXOR(F.col("lft")))).cast("int")  # the grid level that holds both ends
    a = spans.select(
        F.col("root").alias("r"), F.col("node").alias("anc"), F.col("depth").alias("ad"), F.col("lft").alias("l"), F.col("rgt").alias("g"),
        bits.alias("lev"), F.expr("shiftright(lft, cast(length(bin(rgt ^ lft)) as int))").alias("cell"))
    b = spans.select("root", "node", "lft", F.explode(F.sequence(F.lit(1), F.lit(top))).alias("lev2")).withColumn(
        "cell2", F.expr("shiftright(lft, lev2)"))
    hit = b.join(a, (F.col("root") == F.col("r")) & (F.col("lev2") == F.col("lev")) & (F.col("cell2") == F.col("cell"))
                 & (F.col("l") <= F.col("lft")) & (F.col("lft") < F.col("g")))
    return hit.groupBy("node").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ad", "anc"))), lambda x: x["anc"]), separator).alias("path"))
