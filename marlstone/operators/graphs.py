"""Iterative graph operators on edge tables: closures, components, shortest trails, orders.

Every loop writes its state to the shared folder each round and stops when a round adds
nothing. States are one row per node, never per pair of nodes, except where pairs are asked for.
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.storage import Scratch


def reaches(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """id, steps: nodes from which a path along edges (src, dst) leads to a target (id), by breadth-first rounds."""
    scratch = Scratch(edges.sparkSession, "reaches")
    e = scratch.keep(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    t = targets.select(F.col("id").alias("dst")).distinct()
    front = scratch.keep(e.join(t, "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("steps", F.lit(1)))
    seen, n = front, 1
    while not front.isEmpty():
        n += 1
        nxt = e.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("steps", F.lit(n))
        before, front = front, scratch.keep(nxt)
        if front.isEmpty():
            break
        old, seen = seen, scratch.keep(seen.unionByName(front))
        for gone in (before, old):  # read by nothing any more; the first round has one table for both
            scratch.drop(gone)
    return seen


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """id, depth: seeds (depth 0) and what lies within so many steps along edges either way."""
    scratch = Scratch(edges.sparkSession, "expand")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src is not null and dst is not null").distinct()
    e = scratch.keep(both)
    seen = front = scratch.keep(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    for n in range(1, depth + 1):
        nxt = e.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = scratch.keep(nxt.withColumn("depth", F.lit(n)))
        seen = scratch.keep(seen.unionByName(front))
    return seen


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, component (smallest id of the connected component), edges taken either way.

    Alternating large-star and small-star rounds: every node hands its smallest neighbour to its
    larger and to its smaller neighbours. Rounds grow with the logarithm of the component size,
    and neighbour sets are never gathered.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select("u")
    state = scratch.keep(e.where("u < v").distinct())
    while True:
        # large star: larger neighbours (and the node) link to the smallest of the neighbourhood
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.keep(both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct())
        # small star: smaller neighbours and the node link to the smallest
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v").unionByName(least.select(F.col("m").alias("u"), "v")).distinct()
        nxt = scratch.keep(small)
        same = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(state)
        scratch.drop(large)
        state = nxt
        if same:
            break
    linked = state.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(state.select(F.col("u").alias("id"), F.col("u").alias("component"))).distinct()
    alone = loops.select(F.col("u").alias("id")) if nodes is None else loops.select(F.col("u").alias("id")).unionByName(nodes.select("id"))
    return linked.unionByName(alone.distinct().join(linked.select("id"), "id", "left_anti").withColumn("component", F.col("id")))


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id) of nodes that lie on a circle of directed edges; others are left out.

    Nodes without a way in or out are trimmed; then each round colours nodes with the smallest id
    that reaches them, and the nodes of a colour that reach its smallest id back are a component.
    """
    scratch = Scratch(edges.sparkSession, "circles")
    e = scratch.keep(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    out = None
    while True:
        while True:  # trim
            n = e.count()
            kept = scratch.keep(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            scratch.drop(e)
            e = kept
            if e.count() == n:
                break
        if n == 0:
            break
        colour = _spread(scratch, e, e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct().withColumn("c", F.col("id")))
        own = colour.select(F.col("id").alias("src"), F.col("c").alias("cs")).join(e, "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        inner = scratch.keep(own.select("src", "dst", F.col("cs").alias("c")))
        back = scratch.keep(colour.where("id = c"))
        front = back
        while True:
            step = scratch.keep(inner.join(front.select(F.col("id").alias("dst"), "c"), ["dst", "c"], "left_semi").select(F.col("src").alias("id"), "c").distinct().join(back, ["id", "c"], "left_anti"))
            if step.isEmpty():
                break
            back, front = scratch.keep(back.unionByName(step)), step
        found = back.join(inner.select(F.col("src").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("c", "component")
        out = scratch.keep(found if out is None else out.unionByName(found))
        gone = back.select("id")
        e = scratch.keep(e.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"))
    return out if out is not None else e.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)


def _spread(scratch: Scratch, e: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest label that reaches each node along the edges."""
    now = scratch.keep(labels)
    while True:
        came = e.join(now.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
        nxt = scratch.keep(now.join(came, "id", "left").select("id", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
        scratch.drop(now)
        if not nxt.where("moved").isEmpty():
            now = nxt.select("id", "c")
            continue
        return nxt.select("id", "c")


def shortest_trails(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """id, trail, steps: the shortest way up from each start to a node without parents, backwards along edges.

    Of equally short trails the one that reads first counts; a start that only meets circles has none.
    One row per start and reached node is held, not per path.
    """
    scratch = Scratch(edges.sparkSession, "trails")
    e = scratch.keep(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    has_parent = scratch.keep(e.select(F.col("dst").alias("at")).distinct())
    front = scratch.keep(starts.select("id").distinct().select("id", F.col("id").alias("at"), F.col("id").cast("string").alias("trail")))
    seen = scratch.keep(front.select("id", "at"))
    found, n = None, 0
    while True:
        done = front.join(has_parent, "at", "left_anti").groupBy("id").agg(F.min("trail").alias("trail")).withColumn("steps", F.lit(n))
        last, found = found, scratch.keep(done if found is None else found.unionByName(done))
        if last is not None:
            scratch.drop(last)
        open_ = front.join(found.select("id"), "id", "left_anti")
        step = open_.join(e.select(F.col("dst").alias("at"), F.col("src").alias("up")), "at").groupBy("id", F.col("up").alias("at")).agg(
            F.min(F.concat_ws(" < ", "trail", F.col("up").cast("string"))).alias("trail"))
        before, front = front, scratch.keep(step.join(seen, ["id", "at"], "left_anti"))
        if front.isEmpty():
            return found
        old, seen = seen, scratch.keep(seen.unionByName(front.select("id", "at")))
        scratch.drop(before)
        scratch.drop(old)
        n += 1


def topological_orders(edges: DataFrame, nodes: DataFrame, objective=None, exact: int = 9) -> DataFrame:
    """group, position, node: an order of each group's nodes in which every edge points forward.

    Groups are documents with a bounded number of paragraphs. With an objective (a function of a
    tuple of nodes) and at most ``exact`` nodes the best of all orders is taken, ties to the one that
    reads first; else the order that reads first. A group with a circle gives one row with position -1.
    """
    def order(key: tuple, ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(ns["node"]))
        pairs = {(a, b) for a, b in zip(es["src"], es["dst"], strict=True) if a in set(names) and b in set(names)}
        best: list | None = None
        if objective is not None and len(names) <= exact:
            fits = (p for p in permutations(names) if all(p.index(a) < p.index(b) for a, b in pairs))
            scored = sorted(((-objective(p), p) for p in fits), key=lambda x: x)
            best = list(scored[0][1]) if scored else None
        else:
            todo, out = set(names), []
            while todo:
                free = sorted(x for x in todo if not any(b == x and a in todo for a, b in pairs))
                if not free:
                    break
                out.append(free[0])
                todo.remove(free[0])
            best = out if not todo else None
        if best is None:
            return pd.DataFrame({"group": [key[0]], "position": [-1], "node": [None]})
        return pd.DataFrame({"group": key[0], "position": range(len(best)), "node": best})

    return nodes.select("group", "node").groupBy("group").cogroup(edges.select("group", "src", "dst").groupBy("group")).applyInPandas(order, "group string, position int, node string")


def transitive_contradictions(implies: DataFrame, facts: DataFrame) -> DataFrame:
    """a, subject, value, against: what each claim holds, directly or by what it implies, and a value it stands against.

    implies: claim_id, target_id. facts: id, subject, value (nulls say nothing). Claim a contradicts
    all claims that state another value of the subject; ``against`` is the number of those values'
    classes, so pairs are not written out. Holding spreads backwards along implies, a row per claim
    and stated value.
    """
    scratch = Scratch(implies.sparkSession, "contradiction")
    states = facts.where("subject is not null and value is not null").select("id", "subject", "value").distinct()
    e = scratch.keep(implies.where("claim_id is not null and target_id is not null").select("claim_id", "target_id").distinct())
    held = front = scratch.keep(states.select(F.col("id").alias("a"), "subject", "value"))
    while True:
        step = front.join(e, front["a"] == e["target_id"]).select(F.col("claim_id").alias("a"), "subject", "value").distinct().join(held, ["a", "subject", "value"], "left_anti")
        before, front = front, scratch.keep(step)
        if front.isEmpty():
            break
        old, held = held, scratch.keep(held.unionByName(front))
        for gone in (before, old):
            scratch.drop(gone)
    values = states.groupBy("subject").agg(F.count_distinct("value").alias("n_values"))
    return held.join(values, "subject").where("n_values > 1").select("a", "subject", "value", (F.col("n_values") - 1).alias("against"))


def direct_contradictions(facts: DataFrame) -> DataFrame:
    """subject, value_a, value_b, claim_a, claim_b, n_a, n_b: values of a subject that differ, by classes of equal value."""
    c = facts.where("subject is not null and value is not null").groupBy("subject", "value").agg(F.min("id").alias("claim"), F.count_distinct("id").alias("n"))
    side = lambda x: c.select("subject", F.col("value").alias(f"value_{x}"), F.col("claim").alias(f"claim_{x}"), F.col("n").alias(f"n_{x}"))
    return side("a").join(side("b"), "subject").where("value_a < value_b")


def concept_clusters(forms: DataFrame) -> DataFrame:
    """cluster (smallest slug), slug, size: slugs joined by shared surface forms; single ones are left out.

    forms: slug, form. Slugs of one form are linked to its smallest, not to each other.
    """
    low = forms.where("slug is not null and form is not null").select("slug", F.lower(F.trim("form")).alias("form")).distinct()
    least = low.groupBy("form").agg(F.min("slug").alias("src"))
    found = components(low.join(least, "form").select("src", F.col("slug").alias("dst")))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return found.join(sizes, "component").select(F.col("component").alias("cluster"), F.col("id").alias("slug"), "size")
