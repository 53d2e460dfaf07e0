"""Which claims stand: grounded argumentation and the contradiction workbench."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.catalog import GraphCatalog
from marlstone.storage import Scratch


def attacks(catalog: GraphCatalog) -> tuple[DataFrame, DataFrame]:
    """Claim attacks (attacker_id, claim_id) among present claims, and open counter-claims on them."""
    ids = catalog.relation("claim").select("id")
    inner = (
        catalog.relation("claim-conflict").select(F.col("claim_id").alias("attacker_id"), F.col("other_id").alias("claim_id")).distinct()
        .join(ids.select(F.col("id").alias("attacker_id")), "attacker_id", "left_semi").join(ids.select(F.col("id").alias("claim_id")), "claim_id", "left_semi"))
    outer = (
        catalog.relation("counter-claim").where("cc_status = 'open'").select(F.col("cc_id").alias("attacker_id"), F.col("target_claim_id").alias("claim_id")).distinct()
        .join(ids.select(F.col("id").alias("claim_id")), "claim_id", "left_semi"))
    return inner.select("attacker_id", "claim_id"), outer.select("attacker_id", "claim_id")


def grounded_labels(catalog: GraphCatalog) -> DataFrame:
    """claim_id, label: accepted, rejected or undecided in the grounded labelling.

    A claim is rejected once an accepted claim or an open counter-claim attacks it, and accepted
    once all its attackers are rejected. Rounds go on until none adds a claim; a round only moves
    the claims not yet decided and the attacks among them.
    """
    scratch = Scratch(catalog.spark, "argument")
    inner, outer = attacks(catalog)
    edges = scratch.keep(inner)
    hit = scratch.keep(outer.select("claim_id").distinct())
    left = scratch.keep(catalog.relation("claim").select(F.col("id").alias("claim_id")))
    decided = scratch.keep(hit.withColumn("label", F.lit("rejected")))
    left = scratch.keep(left.join(hit, "claim_id", "left_anti"))
    while True:
        accepted = left.join(edges.select("claim_id"), "claim_id", "left_anti") if decided is None else left.join(
            edges.join(decided.where("label = 'rejected'").select(F.col("claim_id").alias("attacker_id")), "attacker_id", "left_anti").select("claim_id"), "claim_id", "left_anti")
        accepted = scratch.keep(accepted)
        rejected = edges.join(accepted.select(F.col("claim_id").alias("attacker_id")), "attacker_id", "left_semi").select("claim_id").distinct().join(left, "claim_id", "left_semi")
        fresh = scratch.keep(accepted.withColumn("label", F.lit("accepted")).unionByName(rejected.withColumn("label", F.lit("rejected"))))
        if fresh.isEmpty():
            break
        nxt_decided = scratch.keep(decided.unionByName(fresh))
        nxt_left = scratch.keep(left.join(fresh.select("claim_id"), "claim_id", "left_anti"))
        for old in (decided, left, accepted, fresh):
            scratch.drop(old)
        decided, left = nxt_decided, nxt_left
    return decided.unionByName(left.withColumn("label", F.lit("undecided")))


def argumentation(catalog: GraphCatalog) -> dict[str, DataFrame]:
    """The seven outputs: attacked, defended, undefeated-attacker, grounded-accepted, grounded-rejected, labels, warnings.

    ``defended`` pairs attackers with those who attack them in turn, for each claim.
    """
    inner, outer = attacks(catalog)
    both = inner.withColumn("attacker_type", F.lit("claim")).unionByName(outer.withColumn("attacker_type", F.lit("counter-claim")))
    labels = grounded_labels(catalog)
    standing = labels.where("label = 'accepted'").select(F.col("claim_id").alias("attacker_id"))
    undefeated = inner.join(standing, "attacker_id", "left_semi").withColumn("attacker_type", F.lit("claim")).unionByName(outer.withColumn("attacker_type", F.lit("counter-claim")))
    claim = catalog.relation("claim")
    ids = claim.select("id")
    support = (
        catalog.relation("claim-implies").select(F.col("claim_id").alias("s"), F.col("target_id").alias("claim_id")).distinct()
        .join(ids.select(F.col("id").alias("s")), "s", "left_semi").join(ids.select(F.col("id").alias("claim_id")), "claim_id", "left_semi"))
    axiom = claim.where("axiom").select(F.col("id").alias("s"))
    bearing = claim.where("load_bearing").select(F.col("id").alias("claim_id"))
    other = support.join(axiom, "s", "left_anti").select("claim_id").distinct()
    row = lambda df, kind, related, why, detail: df.select(
        F.lit(kind).alias("warning_type"), "claim_id", related.alias("related_id"), F.lit(why).alias("justification_kind"), detail.alias("justification_detail"))
    contested = undefeated.join(bearing, "claim_id", "left_semi")
    only_axioms = support.join(axiom, "s", "left_semi").join(bearing, "claim_id", "left_semi").join(other, "claim_id", "left_anti")
    unsupported = bearing.join(support.select("claim_id"), "claim_id", "left_anti")
    warnings = (
        row(contested, "contested-load-bearing-with-undefended-attack", F.col("attacker_id"), "defeater-set", F.col("attacker_id"))
        .unionByName(row(only_axioms, "axiom-only-support", F.col("s"), "axiom-support", F.col("s")))
        .unionByName(row(unsupported, "unsupported-load-bearing", F.lit(""), "missing-support", F.lit("load-bearing claim has no support edge"))).distinct())
    defended = inner.join(inner.select(F.col("attacker_id").alias("defender_id"), F.col("claim_id").alias("attacker_id")), "attacker_id").select("claim_id", "attacker_id", "defender_id")
    return {
        "attacked": both.select("claim_id", "attacker_id", "attacker_type"), "defended": defended.distinct(),
        "undefeated-attacker": undefeated.select("claim_id", "attacker_id", "attacker_type"),
        "grounded-accepted": labels.where("label = 'accepted'").select("claim_id"), "grounded-rejected": labels.where("label = 'rejected'").select("claim_id"),
        "labels": labels, "warnings": warnings}


def quantity_clashes(catalog: GraphCatalog, tolerance: float = 1e-6) -> DataFrame:
    """claim_a, claim_b, subject, predicate, left_value, right_value, unit, n_a, n_b: quantities that differ by more than the tolerance.

    Claims that state the same value of the same thing are one class, shown by its smallest claim
    and its size; a pair is given once, smaller claim first.
    """
    q = catalog.relation("claim-quantity").select(F.col("id").alias("quantity_id"), "canonical_value", "canonical_unit")
    stated = catalog.relation("claim-normal-form").where("quantity_id is not null").join(q, "quantity_id").groupBy("subject", "predicate", "canonical_unit", "canonical_value").agg(
        F.min("claim_id").alias("claim"), F.count_distinct("claim_id").alias("n"))
    side = lambda x: stated.select("subject", "predicate", "canonical_unit", F.col("claim").alias(f"claim_{x}"), F.col("canonical_value").alias(f"v_{x}"), F.col("n").alias(f"n_{x}"))
    return side("a").join(side("b"), ["subject", "predicate", "canonical_unit"]).where("claim_a < claim_b").where(F.abs(F.col("v_a") - F.col("v_b")) > tolerance).select(
        "claim_a", "claim_b", "subject", "predicate", F.col("v_a").alias("left_value"), F.col("v_b").alias("right_value"), F.col("canonical_unit").alias("unit"), "n_a", "n_b")


def interval_inconsistencies(catalog: GraphCatalog) -> DataFrame:
    """Pairs of intervals of one subject and predicate that do not stand as both require (overlap or disjoint).

    Equal intervals are one class, as in quantity_clashes.
    """
    rows = catalog.relation("claim-time-interval").groupBy("subject", "predicate", "required_relation", "start", "end").agg(
        F.min("claim_id").alias("claim"), F.count_distinct("claim_id").alias("n"))
    side = lambda x: rows.select("subject", "predicate", F.col("required_relation").alias("required"), F.col("claim").alias(f"claim_{x}"), F.col("start").alias(f"start_{x}"), F.col("end").alias(f"end_{x}"), F.col("n").alias(f"n_{x}"))
    pairs = side("a").join(side("b"), ["subject", "predicate", "required"]).where("claim_a < claim_b")
    apart = (F.col("end_a") < F.col("start_b")) | (F.col("end_b") < F.col("start_a"))
    return pairs.where(((F.col("required") == "overlap") & apart) | ((F.col("required") == "disjoint") & ~apart))


def candidate_pairs(catalog: GraphCatalog) -> DataFrame:
    """claim_a, claim_b: declared conflicts among present claims, each unordered pair once."""
    ids = catalog.relation("claim").select("id")
    c = catalog.relation("claim-conflict").where("claim_id <> other_id").select(F.least("claim_id", "other_id").alias("claim_a"), F.greatest("claim_id", "other_id").alias("claim_b")).distinct()
    return c.join(ids.select(F.col("id").alias("claim_a")), "claim_a", "left_semi").join(ids.select(F.col("id").alias("claim_b")), "claim_b", "left_semi").select("claim_a", "claim_b")
