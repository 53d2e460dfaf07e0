"""Belief in claims: evidence from sources, damped by counter-claims and by what a claim rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ledger import prior_for_status
from marlstone.storage import Scratch

#: Fixed values of the model.
ROUNDS, EPSILON = 20, 1e-4
FLOOR, CEILING = 0.05, 0.95
OPEN_DAMP, ADDRESSED_DAMP = 0.95, 0.85
TRUSTED, STALE = 0.5, 0.95


def freshness(age_seconds: Column, half_life_days: float) -> Column:
    """0.5 to the power of age over half-life; no age below zero."""
    if half_life_days <= 0:
        raise ValueError("half_life_days must be positive")
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_seconds) / F.lit(86400.0 * half_life_days))


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), c))


def local_evidence(claims: DataFrame, spans: DataFrame, trust: DataFrame, counters: DataFrame) -> DataFrame:
    """claim_id, prior, local: noisy-or of the sources' trust, damped by counter-claims.

    claims: claim_id, status, p_prior (null: by status). spans: claim_id, doc_id, a row per citation.
    trust: doc_id, trust; a source without a row counts 1. counters: target_claim_id, status; dismissed
    ones do nothing. A claim without sources has its prior as evidence.
    """
    prior = F.coalesce("p_prior", prior_for_status(F.col("status")), F.lit(0.5))
    base = claims.select("claim_id", prior.alias("prior"))
    cited = spans.where("doc_id is not null").join(trust.select("doc_id", "trust"), "doc_id", "left").groupBy("claim_id", F.coalesce("trust", F.lit(1.0)).alias("t")).agg(
        F.count(F.lit(1)).alias("n"))
    # a claim's citations by trust: a few rows, so the product needs no long list
    failed = base.join(cited, "claim_id").groupBy("claim_id").agg(F.product(F.pow(1 - F.col("prior") * F.col("t"), F.col("n"))).alias("failed"))
    damp = counters.where("target_claim_id is not null").groupBy(F.col("target_claim_id").alias("claim_id")).agg(
        F.sum((F.coalesce("status", F.lit("open")) == "open").cast("int")).alias("n_open"), F.sum((F.col("status") == "addressed").cast("int")).alias("n_addressed"))
    evidence = F.coalesce(1 - F.col("failed"), F.col("prior"))
    return base.join(failed, "claim_id", "left").join(damp, "claim_id", "left").select(
        "claim_id", "prior",
        (evidence * F.pow(F.lit(OPEN_DAMP), F.coalesce("n_open", F.lit(0))) * F.pow(F.lit(ADDRESSED_DAMP), F.coalesce("n_addressed", F.lit(0)))).alias("local"))


def propagate(local: DataFrame, edges: DataFrame, rounds: int = ROUNDS, epsilon: float = EPSILON) -> DataFrame:
    """claim_id, prior, posterior after at most ``rounds`` rounds, or once no value moves by epsilon.

    local: see local_evidence. edges: parent, claim_id; a parent that is no claim counts 1. Each round
    takes the weakest parent's value of the round before. What does not change between rounds is
    computed and written once; a round is a join, a minimum and a clamp.
    """
    scratch = Scratch(local.sparkSession, "belief")
    base = scratch.keep(local)
    links = scratch.keep(edges.where("parent is not null").select("parent", "claim_id").distinct().join(base.select(F.col("claim_id").alias("parent")), "parent", "left_semi"))
    now = scratch.keep(base.select("claim_id", "prior", "local", F.col("prior").alias("p")))
    for _ in range(rounds):
        weakest = links.join(now.select(F.col("claim_id").alias("parent"), "p"), "parent").groupBy("claim_id").agg(F.min("p").alias("weakest"))
        nxt = scratch.keep(now.select("claim_id", "prior", "local", F.col("p").alias("before")).join(weakest, "claim_id", "left").select(
            "claim_id", "prior", "local", _clamped(F.col("local") * F.coalesce("weakest", F.lit(1.0))).alias("p"), "before"))
        moved = nxt.agg(F.max(F.abs(F.col("p") - F.col("before")))).first()[0]
        scratch.drop(now)
        now = nxt
        if moved is None or moved < epsilon:
            break
    return now.select("claim_id", "prior", F.col("p").alias("posterior"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin (from 0), n of values in [0, 1]; the last bin is closed. Nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_changes(before: DataFrame, after: DataFrame, n: int = 20) -> DataFrame:
    """The n claims whose value moved most: claim_id, before (0 if absent), after, delta."""
    rows = after.select("claim_id", F.col("posterior").alias("after")).join(before.select("claim_id", F.col("p_posterior").alias("b")), "claim_id", "left")
    rows = rows.select("claim_id", F.coalesce("b", F.lit(0.0)).alias("before"), "after").withColumn("delta", F.col("after") - F.col("before"))
    return rows.orderBy(F.abs("delta").desc(), "claim_id").limit(n)


def trusted_conflicts(claims: DataFrame, conflicts: DataFrame, spans: DataFrame, sources: DataFrame) -> DataFrame:
    """target_claim_id, conflict_claim_id, source_id: conflicts from trusted sources refreshed after the target.

    claims: claim_id, created_us. conflicts: claim_id, other_id. sources: doc_id, trust (decayed), ingested_us.
    """
    fresh = sources.where((F.coalesce("trust", F.lit(1.0)) >= TRUSTED) & F.col("ingested_us").isNotNull())
    return (
        conflicts.join(claims.select(F.col("claim_id").alias("other_id"), "created_us"), "other_id")
        .join(spans.where("doc_id is not null").select("claim_id", "doc_id").distinct(), "claim_id").join(fresh, "doc_id")
        .where("ingested_us > created_us")
        .select(F.col("other_id").alias("target_claim_id"), F.col("claim_id").alias("conflict_claim_id"), F.col("doc_id").alias("source_id")).distinct())


def effective_confidence(claims: DataFrame, edges: DataFrame, spans: DataFrame, counters: DataFrame, conflicts: DataFrame, sources: DataFrame,
                         as_of_us: int, half_life_days: float = 365.0) -> DataFrame:
    """claim_id, prior, posterior, freshness_factor, reasons (why belief fell below the prior).

    Like propagate, on trust that decays with the sources' age at as_of, and with conflicts from
    trusted refreshed sources counting as open counter-claims. sources: doc_id, trust, ingested_us.
    Reasons read ``counter-claim:status:id``, ``weakened-parent:id``, ``refreshed-source-conflict:source:claim``,
    ``stale-source:id``, sorted.
    """
    factor = F.when(F.col("ingested_us").isNotNull(), freshness((F.lit(as_of_us) - F.col("ingested_us")) / 1e6, half_life_days)).otherwise(1.0)
    aged = Scratch(claims.sparkSession, "trust").keep(sources.select("doc_id", "ingested_us", factor.alias("factor"), (F.coalesce("trust", F.lit(1.0)) * factor).alias("trust")))
    synthetic = trusted_conflicts(claims, conflicts, spans, aged)
    every = counters.select("target_claim_id", "status").unionByName(synthetic.select("target_claim_id", F.lit("open").alias("status")))
    belief = propagate(local_evidence(claims, spans, aged, every), edges)
    cited = spans.where("doc_id is not null").select("claim_id", "doc_id").distinct().join(aged, "doc_id", "left")
    fresh = cited.groupBy("claim_id").agg(F.min(F.coalesce("factor", F.lit(1.0))).alias("freshness_factor"))
    parents = edges.where("parent is not null").select("parent", "claim_id").distinct().join(
        belief.select(F.col("claim_id").alias("parent"), F.col("prior").alias("pp"), F.col("posterior").alias("pq")), "parent").where("pq < pp").groupBy("claim_id").agg(
        F.concat_ws(":", F.lit("weakened-parent"), F.min(F.struct("pq", "parent"))["parent"]).alias("reason"))
    reasons = (
        counters.where("target_claim_id is not null and coalesce(status, 'open') <> 'dismissed'").select(
            F.col("target_claim_id").alias("claim_id"), F.concat_ws(":", F.lit("counter-claim"), F.coalesce("status", F.lit("open")), "id").alias("reason"))
        .unionByName(parents)
        .unionByName(synthetic.select(F.col("target_claim_id").alias("claim_id"), F.concat_ws(":", F.lit("refreshed-source-conflict"), "source_id", "conflict_claim_id").alias("reason")))
        .unionByName(cited.where(F.col("factor") < STALE).select("claim_id", F.concat_ws(":", F.lit("stale-source"), "doc_id").alias("reason"))))
    fell = belief.where("posterior < prior").select("claim_id")
    listed = reasons.join(fell, "claim_id", "left_semi").groupBy("claim_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return belief.join(fresh, "claim_id", "left").join(listed, "claim_id", "left").select(
        "claim_id", F.round("prior", 12).alias("prior"), F.round("posterior", 12).alias("posterior"),
        F.round(F.coalesce("freshness_factor", F.lit(1.0)), 12).alias("freshness_factor"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def why_provenance(claims: DataFrame, spans: DataFrame, k: int | None = 5, parents: DataFrame | None = None) -> DataFrame:
    """claim_id, witnesses (the first k of parent claims, if given as parent, claim_id, then doc_id|locator), truncated, for load-bearing claims only.

    The first k are cut by rank before they are gathered, so no list outgrows k; with None all are listed, which is
    no more than the records of a claim hold. Parents read ``parent-claim:id``.
    """
    mine = claims.where("load_bearing").select("claim_id")
    rows = spans.select("claim_id", F.lit(1).alias("kind"), F.concat_ws("|", "doc_id", "locator_text").alias("w"))
    if parents is not None:
        rows = rows.unionByName(parents.where("parent is not null").select("claim_id", F.lit(0).alias("kind"), F.concat_ws(":", F.lit("parent-claim"), "parent").alias("w")))
    rows = rows.join(mine, "claim_id", "left_semi").distinct()
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy("kind", "w"))
    rows = rows.withColumn("r", rank)
    rows = rows if k is None else rows.where(F.col("r") <= k + 1)
    kept = F.lit(True) if k is None else F.col("r") <= k
    listed = F.transform(F.sort_array(F.collect_list(F.when(kept, F.struct("r", "w")))), lambda x: x["w"])
    return mine.join(rows.groupBy("claim_id").agg(listed.alias("witnesses"), F.max(~kept).alias("truncated")), "claim_id", "left").select(
        "claim_id", F.coalesce("witnesses", F.array().cast("array<string>")).alias("witnesses"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
