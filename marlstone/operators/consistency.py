"""Consistency of a thesis with the claims made for it, and the gates built on that."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.graphs import direct_contradictions, transitive_contradictions
from marlstone.operators.hierarchy import nested_sets
from marlstone.plans.catalog import GraphCatalog


def reaching(catalog: GraphCatalog) -> DataFrame:
    """id of sub-arguments and claims whose chain of supports ends at a thesis node.

    A sub-argument has one parent, so the spine is ranked as a forest in logarithmic rounds; claims hang
    on it by what they declare to support.
    """
    thesis = catalog.relation("thesis-node").select("id")
    subs = catalog.relation("sub-argument").select("id", "parent")
    forest = subs.select(F.col("id").alias("node"), "parent").unionByName(thesis.select(F.col("id").alias("node"), F.lit(None).cast("string").alias("parent"))).groupBy("node").agg(F.max("parent").alias("parent"))
    sets = nested_sets(forest)
    rooted = sets.where("depth > 0").join(thesis.select(F.col("id").alias("root")), "root", "left_semi").select(F.col("node").alias("id"))
    hold = rooted.unionByName(thesis)
    claims = catalog.relation("paragraph-supports").join(hold.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("claim_id").alias("id"))
    return rooted.unionByName(claims).distinct()


def thesis_defects(catalog: GraphCatalog) -> DataFrame:
    """kind, id, detail of every defect.

    orphan: a claim that declares support and reaches no thesis. unreachable: a declared node that is neither thesis
    nor sub-argument. contradiction: values of a subject that differ (the classes' smallest claims; detail names them).
    implied-contradiction: a claim that comes to hold, by what it implies, a value that others deny. declared-conflict:
    a conflict of the ledger. no-chapter: a sub-argument that no chapter advances. missing-evidence: required evidence
    that no claim is about. invariant: a claim against a pinned or forbidden value.
    """
    rel = catalog.relation
    row = lambda df, kind, key, detail: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), detail.alias("detail"))
    supports = rel("paragraph-supports")
    orphan = supports.select("claim_id").distinct().join(reaching(catalog).select(F.col("id").alias("claim_id")), "claim_id", "left_anti")
    known = rel("thesis-node").select("id").unionByName(rel("sub-argument").select("id")).select(F.col("id").alias("node"))
    unreachable = supports.select("claim_id", "node").join(known, "node", "left_anti").distinct()
    facts = rel("claim-fact").where("subject is not null and value is not null")
    direct = direct_contradictions(facts)
    implied = transitive_contradictions(rel("claim-implies"), facts).join(facts.select(F.col("id").alias("a"), "subject", "value"), ["a", "subject", "value"], "left_anti")
    conflicts = rel("claim-conflict").where("claim_id <> other_id").select(F.least("claim_id", "other_id").alias("a"), F.greatest("claim_id", "other_id").alias("b")).distinct()
    bare = rel("sub-argument").select("id").join(rel("sub-arg-chapter").select(F.col("sub_arg_id").alias("id")), "id", "left_anti")
    about = facts.select(F.col("subject").alias("evidence")).distinct()
    wanting = rel("sub-arg-evidence").select("sub_arg_id", "evidence").distinct().join(about, "evidence", "left_anti")
    rules = rel("invariant").select(F.col("id").alias("rule"), "subject", "pinned_value", "forbidden_value")
    broken = facts.join(rules, "subject").where("value <> pinned_value or value = forbidden_value").select("id", "rule").distinct()
    return reduce(DataFrame.unionByName, [
        row(orphan, "orphan", "claim_id", F.lit("")), row(unreachable, "unreachable", "claim_id", F.col("node")),
        row(direct, "contradiction", "claim_a", F.concat_ws(" ", "subject", "value_a", F.lit("against"), "value_b", "claim_b")),
        row(implied, "implied-contradiction", "a", F.concat_ws(" ", "subject", "value")), row(conflicts, "declared-conflict", "a", F.col("b")),
        row(bare, "no-chapter", "id", F.lit("")), row(wanting, "missing-evidence", "sub_arg_id", F.col("evidence")), row(broken, "invariant", "id", F.col("rule"))])


def consistency_gate(defects: DataFrame, facts: DataFrame) -> DataFrame:
    """n_contradictions, n_invariants, n_missing, failed: contradictions and broken invariants fail, missing evidence only where some claim has a subject."""
    stated = facts.where("subject is not null").agg((F.count(F.lit(1)) > 0).alias("stated"))
    n = lambda kinds, name: F.coalesce(F.sum(F.col("kind").isin(kinds).cast("int")), F.lit(0)).alias(name)
    s = defects.agg(n(["contradiction", "implied-contradiction", "declared-conflict"], "n_contradictions"), n(["invariant", "unreachable", "no-chapter"], "n_invariants"), n(["missing-evidence"], "n_missing")).join(stated, F.lit(True))
    return s.select("n_contradictions", "n_invariants", "n_missing", ((F.col("n_contradictions") > 0) | (F.col("n_invariants") > 0) | ((F.col("n_missing") > 0) & F.col("stated"))).alias("failed"))


def preflight(violations: DataFrame, unsupported: DataFrame, contradictions: DataFrame, contracts: DataFrame) -> DataFrame:
    """n_violations, n_unsupported, n_contradictions, n_failed_contracts, ready: all must be none. contracts: passes."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    s = one(violations, "n_violations").join(one(unsupported, "n_unsupported"), F.lit(True)).join(one(contradictions, "n_contradictions"), F.lit(True)).join(one(contracts.where("not passes"), "n_failed_contracts"), F.lit(True))
    return s.withColumn("ready", F.expr("n_violations + n_unsupported + n_contradictions + n_failed_contracts = 0"))


def fresh_verdicts(verdicts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Verdicts (chapter, verdict, at_us) that are no older than the chapter's draft (chapter, at_us)."""
    return verdicts.join(drafts.select("chapter", F.col("at_us").alias("_draft")), "chapter").where("at_us >= _draft").drop("_draft")


def veto(decisions: DataFrame, concepts: DataFrame, reachable: DataFrame) -> DataFrame:
    """decisions (id, decision) with approved candidates sent to a person if none of their concepts (id, concept) is reachable (concept).

    A candidate without concepts keeps its decision.
    """
    has = concepts.groupBy("id").agg(F.lit(1).alias("_has"))
    hit = concepts.join(reachable.select("concept").distinct(), "concept", "left_semi").select("id").distinct().withColumn("_hit", F.lit(1))
    j = decisions.join(has, "id", "left").join(hit, "id", "left")
    return j.select("id", F.when((F.col("decision") == "auto") & F.col("_has").isNotNull() & F.col("_hit").isNull(), "manual").otherwise(F.col("decision")).alias("decision"))


def gap_seeds(coverage: DataFrame, seeds: DataFrame, below: float = 1.0) -> DataFrame:
    """node of uncovered nodes (node, coverage) that are no seeds (node) yet, once each."""
    return coverage.where(F.col("coverage") < below).select("node").distinct().join(seeds.select("node"), "node", "left_anti")


def promote_addressed(counters: DataFrame, addressed: DataFrame) -> DataFrame:
    """The records to append: open counter-claims named in addressed (id, chapter), now addressed there."""
    j = counters.where("status = 'open'").join(addressed.select("id", F.col("chapter").alias("_chapter")).dropDuplicates(["id"]), "id")
    return j.withColumn("status", F.lit("addressed")).withColumn("addressed_in_chapter", F.col("_chapter")).drop("_chapter").select(*counters.columns)


def match_remedies(checks: DataFrame, remedies: DataFrame) -> DataFrame:
    """constraint, subject, remedy of failed checks whose constraint a remedy (constraint, remedy) names."""
    return checks.where("status = 'unsat'").join(remedies.select("constraint", "remedy"), "constraint").select("constraint", "subject", "remedy").distinct()
