"""Putting paragraphs together: feasibility, bridges, seams, and whether a rewrite keeps the argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.graphs import components
from marlstone.operators.style import content_words


def entities(c: Column) -> Column:
    """Sorted distinct content words of four letters or more, the stand-in for entities."""
    return F.sort_array(F.filter(content_words(c), lambda w: F.length(w) >= 4))


def feasibility(nodes: DataFrame, slots: DataFrame, most_unbound: float = 0.5) -> DataFrame:
    """group, reason of every obstacle: required slots unfilled, too many paragraphs without a slot, or no shared-entity path.

    nodes: group, id, slot (null: unbound), entities (array). slots: group, slot, required. Paragraphs of one entity are linked
    through the entity, not pairwise.
    """
    filled = nodes.where("slot is not null").select("group", "slot").distinct()
    empty = slots.where("required").join(filled, ["group", "slot"], "left_anti").select("group", F.concat(F.lit("required slot unfilled: "), "slot").alias("reason"))
    share = nodes.groupBy("group").agg(F.avg(F.col("slot").isNull().cast("int")).alias("u"), F.count_distinct("id").alias("n"))
    loose = share.where(F.col("u") > most_unbound).select("group", F.lit("too many unbound paragraphs").alias("reason"))
    key = lambda kind, c: F.concat_ws("\u001f", F.lit(kind), "group", c)
    e = nodes.select("group", "id", F.explode("entities").alias("e")).select(key("n", "id").alias("src"), key("e", "e").alias("dst"))
    comp = components(e).where(F.col("id").startswith("n\u001f"))
    of = nodes.select("group", "id", key("n", "id").alias("k")).join(comp.select(F.col("id").alias("k"), "component"), "k", "left")
    parts = of.groupBy("group").agg(F.count_distinct(F.coalesce("component", "k")).alias("parts"))
    split = parts.where("parts > 1").select("group", F.lit("entity graph is disconnected").alias("reason"))
    return empty.unionByName(loose).unionByName(split)


def bridge_problems(bridges: DataFrame, relations: list[str]) -> DataFrame:
    """id, reason: a relation that is not allowed, or entities that neither neighbour has. bridges: id, text, relation, left, right (arrays)."""
    fresh = F.array_except(entities(F.col("text")), F.array_union("left", "right"))
    reasons = F.array_compact(F.array(F.when(~F.col("relation").isin(relations) | F.col("relation").isNull(), F.concat(F.lit("relation: "), F.coalesce("relation", F.lit("none")))),
                                      F.when(F.size(fresh) > 0, F.concat(F.lit("new entities: "), F.array_join(fresh, ", ")))))
    return bridges.select("id", F.explode(reasons).alias("reason"))


def seam_problems(edits: DataFrame) -> DataFrame:
    """id, missing: words of tokens (array) that an edited sentence (text) has lost, whatever the case."""
    lost = F.filter("tokens", lambda t: ~F.contains(F.lower("text"), F.lower(t)))
    return edits.select("id", F.explode(lost).alias("missing"))


def weave_gate(pieces: DataFrame, most_bridge: float = 0.35) -> DataFrame:
    """group, bridge_share, passes: bridges may make up 35 % of the characters. pieces: group, text, is_bridge."""
    n = F.length(F.coalesce("text", F.lit("")))
    share = F.coalesce(F.sum(F.when(F.col("is_bridge"), n).otherwise(0)) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0))
    return pieces.groupBy("group").agg(share.alias("bridge_share"), (share <= most_bridge).alias("passes"))


def longest_non_decreasing(values: Column) -> Column:
    """Length of the longest non-decreasing subsequence of an array of ints: the least last members by length are kept."""
    none = F.array().cast("array<int>")

    def step(tails: Column, x: Column) -> Column:
        i = F.size(F.filter(tails, lambda t: t <= x))
        return F.concat(F.slice(tails, 1, i), F.array(x.cast("int")), F.slice(tails, i + 2, F.size(tails)))

    return F.aggregate(values, none, step, F.size)


def argument_losses(pairs: DataFrame, least: float = 0.30) -> DataFrame:
    """id, kind, detail of what a rewrite (id, before, after) loses or adds.

    dropped-claim: a sentence whose content words no window of three new sentences shares enough of. reordered-claim: fewer than
    three in five of the kept sentences stand in order. introduced-fact: numbers and names that were not there.
    """
    bags = lambda c: F.filter(F.transform(T.sentences(F.col(c)), content_words), lambda w: F.size(w) > 0)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\b(\d+(?:[.,]\d+)?)\b"), 1)
    names = lambda c: F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), 1)
    p = pairs.where("before is not null and after is not null").select("id", bags("before").alias("b"), bags("after").alias("a"), F.array_except(F.concat(numbers("after"), names("after")), F.concat(numbers("before"), names("before"))).alias("new"))
    p = p.withColumn("a3", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("a"))), lambda i: F.array_distinct(F.flatten(F.slice("a", i, 3)))))
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(x)
    window = F.transform("b", lambda x: F.coalesce(F.array_max(F.transform("a3", lambda y: share(x, y))), F.lit(0.0)))
    # of equally good sentences the first: larger share, then the smaller place
    single = F.transform("b", lambda x: F.array_max(F.transform("a", lambda y, i: F.struct(share(x, y).alias("s"), (-i).alias("i"))))["i"])
    p = p.select("id", "b", "new", window.alias("w"), single.alias("at"))
    dropped = p.select("id", F.explode(F.filter(F.transform("w", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"] < least)).alias("x")).select("id", F.lit("dropped-claim").alias("kind"), F.col("x.i").cast("string").alias("detail"))
    kept = F.transform(F.filter(F.arrays_zip(F.col("w").alias("w"), F.col("at").alias("at")), lambda z: z["w"] >= least), lambda z: -z["at"])

    order = p.select("id", kept.alias("k")).where(F.size("k") >= 2).withColumn("n", longest_non_decreasing(F.col("k"))).where(F.col("n") < F.greatest(F.lit(2), F.floor((F.size("k") * 3 + 4) / 5)))
    reordered = order.select("id", F.lit("reordered-claim").alias("kind"), F.concat_ws("/", "n", F.size("k")).alias("detail"))
    added = p.select("id", F.explode("new").alias("detail")).select("id", F.lit("introduced-fact").alias("kind"), "detail")
    return dropped.unionByName(reordered).unionByName(added)


def vitality(motion: Column, fano: Column, violations: Column) -> Column:
    """Composite of paragraph motion, burstiness and vocabulary violations in [0, 1], three decimals."""
    return F.round(motion * 0.4 + F.least(fano / 0.7, F.lit(1.0)) * 0.3 + F.greatest(F.lit(0.0), 1 - violations / 10) * 0.3, 3)


def first_introduced(concepts: DataFrame) -> DataFrame:
    """concept, first_chapter, n_chapters over (concept, chapter) rows."""
    return concepts.groupBy(F.lower("concept").alias("concept")).agg(F.min("chapter").alias("first_chapter"), F.count_distinct("chapter").alias("n_chapters"))


def by_tags(df: DataFrame, tags: list[str], column: str = "tags") -> DataFrame:
    """Rows with any of the tags."""
    return df.where(F.arrays_overlap(column, F.array(*[F.lit(t) for t in tags]))) if tags else df.limit(0)


def anchor(corpus: DataFrame, mode: str, move: str | None = None) -> DataFrame:
    """The one row of a mode (and move) with the highest weight, ties by id. corpus: id, mode, move, weight."""
    rows = corpus.where(F.col("mode") == mode)
    return (rows.where(F.col("move") == move) if move else rows).orderBy(F.col("weight").desc_nulls_last(), "id").limit(1)
