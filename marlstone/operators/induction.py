"""Inducing rules from facts: co-occurrence, holdout folds, entrenchment and revision."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.edn import List, Symbol
from marlstone.plans.rules import compile_assert


def cooccurring(facts: DataFrame, least: int = 2, atoms: int = 10, most: int = 200) -> DataFrame:
    """left_predicate, right_predicate, support: predicates stated together of a (document, subject), the most supported first.

    Empty below ``atoms`` facts. Pairs are formed of the distinct predicates of a subject, whose
    number the vocabulary bounds, not of its facts. ``most`` is the size of the report.
    """
    if facts.limit(atoms).count() < atoms:
        return facts.sparkSession.createDataFrame([], "left_predicate string, right_predicate string, support long")
    per = facts.where("predicate is not null").groupBy("doc_id", "subject").agg(F.sort_array(F.collect_set("predicate")).alias("p"))
    pairs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b > a), lambda b: F.struct(a.alias("l"), b.alias("r")))))
    return per.select(F.explode(pairs).alias("x")).groupBy(F.col("x.l").alias("left_predicate"), F.col("x.r").alias("right_predicate")).agg(F.count(F.lit(1)).alias("support")).where(
        F.col("support") >= least).orderBy(F.col("support").desc(), "left_predicate", "right_predicate").limit(most)


def enumerate_bodies(typed: dict[str, str], most: int = 4) -> list[tuple[str, ...]]:
    """Bodies of up to ``most`` predicates of one type, in order of size and name."""
    out = []
    for size in range(1, most + 1):
        for kind in sorted(set(typed.values())):
            out += combinations(sorted(p for p, k in typed.items() if k == kind), size)
    return sorted(out, key=lambda b: (len(b), b))


def document_folds(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, fold: documents in the order of their id dealt round to k folds, numbered by range so that no task orders all."""
    part = docs.select("doc_id").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("_m", F.monotonically_increasing_id())
    from marlstone.storage import Scratch

    part = Scratch(docs.sparkSession, "folds").keep(part).withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    from pyspark.sql import Window

    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(sizes, "_p").select("doc_id", F.pmod(F.col("_b") + F.col("_i"), F.lit(k)).cast("int").alias("fold"))


def holdout(facts: DataFrame, folds: DataFrame, form: object, predicates: list[str], least: float = 0.5) -> DataFrame:
    """fold, n_docs, sat_rate, passes: how often an assertion holds in the documents of each fold.

    facts: doc_id, predicate, value_num; a value that is no number counts 1, a missing predicate is not
    satisfied, approximate equality is absolute here. No predicates at all fail every fold.
    """
    value = F.when(F.col("predicate").isNotNull(), F.coalesce("value_num", F.lit(1.0)))
    wide = facts.where(F.col("predicate").isin(predicates)).groupBy("doc_id").agg(*[F.max(F.when(F.col("predicate") == p, value)).alias(p) for p in predicates]) if predicates else facts.select("doc_id").distinct()
    ok = F.coalesce(compile_assert(form, absolute=True), F.lit(False)) if predicates else F.lit(False)
    s = folds.join(wide, "doc_id", "left").withColumn("_ok", ok.cast("int")).groupBy("fold").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("_ok").alias("sat_rate"))
    return s.withColumn("passes", F.col("sat_rate") >= least)


def entrenchment(sat_rate: Column, n_docs: Column) -> Column:
    """Satisfaction rate times min(documents / 10, 1)."""
    return sat_rate * F.least(n_docs / 10, F.lit(1.0))


def entrenchment_status(e: Column) -> Column:
    return F.when(e >= 0.7, "active").when(e >= 0.4, "tentative").otherwise("quarantined")


def revise(rules: DataFrame, contradicted: DataFrame) -> DataFrame:
    """rule, sat_rate, n_docs, entrenchment, status after contradictions.

    rules: rule, sat_rate, docs (array), status. contradicted: rule, doc_id. Contradicted documents leave a
    rule's support and its rate falls in proportion; a status never rises.
    """
    gone = contradicted.groupBy("rule").agg(F.collect_set("doc_id").alias("gone"))
    j = rules.join(gone, "rule", "left").withColumn("kept", F.array_except("docs", F.coalesce("gone", F.array().cast("array<string>"))))
    rate = F.when(F.size("docs") > 0, F.col("sat_rate") * F.size("kept") / F.size("docs")).otherwise(0.0)
    e = entrenchment(rate, F.size("kept"))
    order = F.array(F.lit("quarantined"), F.lit("tentative"), F.lit("active"))
    now = F.least(F.array_position(order, F.col("status")), F.array_position(order, entrenchment_status(e)))
    return j.select("rule", rate.alias("sat_rate"), F.size("kept").alias("n_docs"), e.alias("entrenchment"), F.element_at(order, F.greatest(F.lit(1), now.cast("int"))).alias("status"))


#: Heads that a rule may use.
GRAMMAR = frozenset("= != < <= > >= + - * / mod and or not => ite ~= approx= sum count in select forall exists".split())


def conforms(form: object) -> bool:
    """Whether a form uses the assertion grammar only."""
    if not isinstance(form, List):
        return not isinstance(form, list) or all(conforms(x) for x in form)
    return bool(form) and isinstance(form[0], Symbol) and form[0].name in GRAMMAR and all(conforms(x) for x in form[1:])


def is_tautology(form: object) -> bool:
    """Whether both sides of an equality, or of an implication, are the same term."""
    return isinstance(form, List) and len(form) == 3 and form[0] in (Symbol("="), Symbol("=>"), Symbol("<="), Symbol(">=")) and form[1] == form[2]
