"""Scores and verdicts: precision, agreement, intervals, panels, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribution(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, n_predicted, n_gold, micro_precision, micro_recall, macro_precision, macro_recall, status over (item, span) rows.

    Ratios of nothing are null; without gold rows the status is unscored.
    """
    p, g = predicted.select("item", "span").distinct(), gold.select("item", "span").distinct()
    both = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), ["item", "span"], "full_outer")
    per = both.groupBy("item").agg(F.sum(F.coalesce("p", F.lit(0)) * F.coalesce("g", F.lit(0))).alias("tp"), F.count("p").alias("np"), F.count("g").alias("ng"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    s = per.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("np"), F.lit(0)).alias("n_predicted"), F.coalesce(F.sum("ng"), F.lit(0)).alias("n_gold"),
                F.avg(ratio(F.col("tp"), F.col("np"))).alias("macro_precision"), F.avg(ratio(F.col("tp"), F.col("ng"))).alias("macro_recall"))
    return s.select("tp", "n_predicted", "n_gold", ratio(F.col("tp"), F.col("n_predicted")).alias("micro_precision"), ratio(F.col("tp"), F.col("n_gold")).alias("micro_recall"),
                    "macro_precision", "macro_recall", F.when(F.col("n_gold") > 0, "scored").otherwise("unscored").alias("status"))


def factuality(assertions: DataFrame, claims: DataFrame) -> DataFrame:
    """part (novel, unsupported, disputed, verified), n: each assertion (claim_id, check_status) by the first part that fits."""
    j = assertions.join(claims.select("claim_id", "status"), "claim_id", "left")
    part = (
        F.when(F.col("claim_id").isNull() | (F.col("claim_id") == ""), "novel").when(F.col("check_status").isin("partial", "none"), "unsupported")
        .when(F.col("status") == "disputed", "disputed").otherwise("verified"))
    return j.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def factuality_rates(parts: DataFrame) -> DataFrame:
    """n, claim_backed_rate (all but novel), span_pass_rate (disputed and verified)."""
    n = F.sum("n")
    share = lambda names: F.when(n > 0, F.coalesce(F.sum(F.when(F.col("part").isin(names), F.col("n"))), F.lit(0)) / n)
    return parts.agg(n.alias("n"), share(["unsupported", "disputed", "verified"]).alias("claim_backed_rate"), share(["disputed", "verified"]).alias("span_pass_rate"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; 0 and 0 without trials."""
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(0.0)


def win_rates(df: DataFrame, by: str, won: Column, z: float = 1.96) -> DataFrame:
    """by, n, wins, rate, low, high."""
    s = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(won.cast("int")), F.lit(0)).alias("wins"))
    low, high = wilson(F.col("wins"), F.col("n"), z)
    return s.select(by, "n", "wins", (F.col("wins") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def fleiss_kappa(ratings: DataFrame, item: str, category: str) -> DataFrame:
    """n_items, raters, kappa over the items that have the most common number of ratings; null categories are no ratings.

    kappa is 1 where all ratings fall into one category.
    """
    cells = ratings.where(F.col(category).isNotNull()).groupBy(item, category).agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy(item).agg(F.sum("n").alias("raters"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    usual = per.where("raters > 1").groupBy("raters").agg(F.count(F.lit(1)).alias("k")).agg(F.max_by("raters", F.struct("k", "raters")).alias("raters"))
    kept = per.join(usual, "raters")
    agree = kept.agg(F.count(F.lit(1)).alias("n_items"), F.first("raters").alias("raters"), F.avg((F.col("sq") - F.col("raters")) / (F.col("raters") * (F.col("raters") - 1))).alias("pa"))
    shares = cells.join(kept.select(item), item, "left_semi").groupBy(category).agg(F.sum("n").alias("n"))
    chance = shares.agg(F.sum(F.col("n") * F.col("n")).alias("q"), F.sum("n").alias("t")).select((F.col("q") / (F.col("t") * F.col("t"))).alias("pe"))
    return agree.join(chance, F.lit(True)).select("n_items", "raters", F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("pa") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def cohens_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa of two raters' labels."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"))
    left, right = rows.groupBy(F.col(a).alias("c")).agg(F.count(F.lit(1)).alias("x")), rows.groupBy(F.col(b).alias("c")).agg(F.count(F.lit(1)).alias("y"))
    pe = left.join(right, "c").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("q"))
    return n.join(pe, F.lit(True)).select("n", "agreement", F.when(F.col("q") == F.col("n") * F.col("n"), F.lit(1.0)).otherwise(
        (F.col("agreement") - F.col("q") / (F.col("n") * F.col("n"))) / (1 - F.col("q") / (F.col("n") * F.col("n")))).alias("kappa"))


def rater_summary(scores: DataFrame, item: str, score: str) -> DataFrame:
    """item, n, median, mean across raters, rounded to four places."""
    return scores.where(F.col(score).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.round(F.median(score), 4).alias("median"), F.round(F.avg(score), 4).alias("mean"))


#: The rules by which a panel decides.
PANEL_RULES = ("any_critical_from_gating", "any_critical", "majority_critical")


def panel_verdicts(reports: DataFrame, panel: DataFrame, rule: str = "any_critical_from_gating") -> DataFrame:
    """item, verdict (pass, soft-gate-fail, hard-gate-fail), gating_criticals, advisory_criticals, critical_reviewers.

    reports: item, reviewer, critical (number of critical findings; null: the report could not be read). panel: reviewer,
    role (gating or advisory). An item fails hard if a gating reviewer has no report, a report names a reviewer that the panel
    does not know, or one could not be read: missing evidence is never counted as none. Else the rule decides: any critical
    finding of a gating reviewer, any at all, or half of the gating reviewers or more with one. Findings of unknown reviewers
    count as advisory. Other rules pass.
    """
    members = panel.groupBy("reviewer").agg(F.max((F.col("role") == "gating").cast("int")).alias("gating"))
    size = members.agg(F.coalesce(F.sum("gating"), F.lit(0)).alias("n_gating"))
    each = reports.groupBy("item", "reviewer").agg(F.sum("critical").alias("critical"), F.max(F.col("critical").isNull().cast("int")).alias("unread"))
    j = each.join(members, "reviewer", "left")
    n = F.coalesce("critical", F.lit(0))
    s = j.groupBy("item").agg(
        F.sum(F.when(F.col("gating") == 1, n).otherwise(0)).alias("gating_criticals"), F.sum(F.when(F.coalesce("gating", F.lit(0)) == 0, n).otherwise(0)).alias("advisory_criticals"),
        F.sum(((F.col("gating") == 1) & (n > 0)).cast("int")).alias("critical_reviewers"), F.sum(((F.col("gating") == 1) & (F.col("unread") == 0)).cast("int")).alias("seen"),
        F.max(F.col("gating").isNull().cast("int")).alias("unknown"), F.max("unread").alias("unread")).join(size, F.lit(True))
    soft = {
        "any_critical_from_gating": F.col("gating_criticals") > 0,
        "any_critical": F.col("gating_criticals") + F.col("advisory_criticals") > 0,
        "majority_critical": (F.col("critical_reviewers") > 0) & (F.col("critical_reviewers") * 2 >= F.col("n_gating")),
    }.get(rule, F.lit(False))
    hard = (F.col("seen") < F.col("n_gating")) | (F.col("unknown") == 1) | (F.col("unread") == 1)
    return s.select("item", F.when(hard, "hard-gate-fail").when(soft, "soft-gate-fail").otherwise("pass").alias("verdict"), "gating_criticals", "advisory_criticals", "critical_reviewers")


def ballots(left: DataFrame, right: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """prompt_id, register, order (0, 1), length_matched, a_arm, a_text, b_arm, b_text: every prompt that both arms answer, in both orders.

    left, right: prompt_id, register, text, arm; one row per prompt. Lengths in words match if they differ by at most
    ``tolerance`` of the longer; an empty text matches none. The register is the left arm's.
    """
    words = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+"))
    j = left.select("prompt_id", "register", F.col("text").alias("lt"), F.col("arm").alias("la")).join(right.select("prompt_id", F.col("text").alias("rt"), F.col("arm").alias("ra")), "prompt_id")
    wl, wr = words(F.col("lt")), words(F.col("rt"))
    matched = (wl > 0) & (wr > 0) & (F.abs(wl - wr) <= F.greatest(wl, wr) * tolerance)
    side = lambda o, a, at, b, bt: F.struct(F.lit(o).alias("order"), F.col(a).alias("a_arm"), F.col(at).alias("a_text"), F.col(b).alias("b_arm"), F.col(bt).alias("b_text"))
    both = F.array(side(0, "la", "lt", "ra", "rt"), side(1, "ra", "rt", "la", "lt"))
    return j.select("prompt_id", "register", matched.alias("length_matched"), F.explode(both).alias("b")).select("prompt_id", "register", "b.order", "length_matched", "b.a_arm", "b.a_text", "b.b_arm", "b.b_text")


def decode_ballots(filled: DataFrame) -> DataFrame:
    """filled ballots with kept_arm: the arm behind ``keep`` (A or B), null for anything else."""
    return filled.withColumn("kept_arm", F.when(F.col("keep") == "A", F.col("a_arm")).when(F.col("keep") == "B", F.col("b_arm")))


def run_summary(runs: DataFrame, k: int = 5) -> DataFrame:
    """part, name, value of benchmark runs: total, reach_extract and reach_ci shares, the k commonest doc gaps and failures.

    runs: outcome, extract_passed (text or null), doc_gaps (names parted by semicolons). Equal counts come in the order of names.
    """
    got = F.coalesce(F.col("extract_passed") != "", F.lit(False))
    s = runs.agg(F.count(F.lit(1)).alias("n"), F.sum(got.cast("int")).alias("e"), F.sum((F.col("outcome") == "SUCCESS").cast("int")).alias("c"))
    share = lambda c: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.col("n")), F.lit(0.0))
    heads = s.select(F.explode(F.array(*[F.struct(F.lit("summary").alias("part"), F.lit(name).alias("name"), v.cast("double").alias("value")) for name, v in (
        ("total", F.col("n")), ("reach_extract", share("e")), ("reach_ci", share("c")))])).alias("r")).select("r.*")

    def top(df: DataFrame, part: str) -> DataFrame:
        best = df.where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("value")).orderBy(F.col("value").desc(), "name").limit(k)
        return best.select(F.lit(part).alias("part"), "name", "value")

    gaps = runs.select(F.explode(F.split(F.coalesce("doc_gaps", F.lit("")), ";")).alias("g")).select(F.trim("g").alias("name"))
    return heads.unionByName(top(gaps, "doc gap")).unionByName(top(runs.where("outcome <> 'SUCCESS'").select(F.col("outcome").alias("name")), "failure"))


def positions(evidence: DataFrame, members: DataFrame, charters: DataFrame | None = None, least_support: int = 2, least_contra: int = 1) -> DataFrame:
    """rule, school, stance (supports, contradicts, extends, silent), n_support, n_contra, declared: where each school stands on each rule.

    evidence: rule, doc_id, stance (support or contradict). members: school, doc_id. charters: school, rule, asserts (true:
    asserts, false: rejects), which decide before any evidence. Documents count once. A school is silent on a rule that its
    documents do not touch, so rules and schools meet in full; both lists are names of groups, not of rows.
    """
    per = evidence.select("rule", "doc_id", "stance").distinct().join(members.select("school", "doc_id").distinct(), "doc_id").groupBy("rule", "school").agg(
        F.sum((F.col("stance") == "support").cast("int")).alias("n_support"), F.sum((F.col("stance") == "contradict").cast("int")).alias("n_contra"))
    every = evidence.select("rule").distinct().join(members.select("school").distinct(), F.lit(True))
    j = every.join(per, ["rule", "school"], "left").select("rule", "school", F.coalesce("n_support", F.lit(0)).alias("n_support"), F.coalesce("n_contra", F.lit(0)).alias("n_contra"))
    said = F.lit(None).cast("boolean")
    if charters is not None:
        j, said = j.join(charters.groupBy("rule", "school").agg(F.max("asserts").alias("_said")), ["rule", "school"], "left"), F.col("_said")
    s, c = F.col("n_support"), F.col("n_contra")
    stance = F.when(said, "supports").when(~said, "contradicts").when((s >= least_support) & (c == 0), "supports").when((s == 0) & (c >= least_contra), "contradicts").when((s > 0) & (c == 0), "extends").otherwise("silent")
    return j.select("rule", "school", stance.alias("stance"), "n_support", "n_contra", said.isNotNull().alias("declared"))


def disputed_questions(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """topic, question (smaller claim against the larger), claim_id, stance (asserts, denies), source_id: a row per side and source of each conflict within a topic.

    claims: claim_id, topic, source_id (a row per source; null: none). conflicts: claim_id, other_id, either way once.
    """
    pair = conflicts.where("claim_id <> other_id").select(F.least("claim_id", "other_id").alias("a"), F.greatest("claim_id", "other_id").alias("b")).distinct()
    topics = claims.select("claim_id", "topic").where("topic is not null").distinct()
    same = pair.join(topics.select(F.col("claim_id").alias("a"), "topic"), "a").join(topics.select(F.col("claim_id").alias("b"), "topic"), ["b", "topic"])
    sides = same.select("topic", F.concat_ws(" against ", "a", "b").alias("question"), F.explode(F.array(F.struct(F.col("a").alias("claim_id"), F.lit("asserts").alias("stance")), F.struct(F.col("b").alias("claim_id"), F.lit("denies").alias("stance")))).alias("s"))
    return sides.select("topic", "question", "s.claim_id", "s.stance").join(claims.select("claim_id", "topic", "source_id").distinct(), ["claim_id", "topic"]).select("topic", "question", "claim_id", "stance", "source_id")


def defect_neighbours(defects: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """constraint, subject, claim_id, neighbour, score, rank: the k most similar other claims of every claim that bears a failed check.

    defects: constraint, subject, claim_id. queries: the claims' vectors (vec_id, embedding); vectors: those of all claims.
    """
    from marlstone.operators.retrieval import top_k

    near = top_k(queries, vectors, k)
    return defects.join(near.withColumnRenamed("query", "claim_id"), "claim_id").select("constraint", "subject", "claim_id", F.col("item").alias("neighbour"), "score", "rank")


def dedup_findings(findings: DataFrame) -> DataFrame:
    """text, severity, n, reviewers of findings equal after lower and trim."""
    return findings.where("text is not null").groupBy(F.lower(F.trim("text")).alias("text"), "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("reviewer").alias("reviewers"))


def convergence(findings: DataFrame, least: int = 2) -> DataFrame:
    """location, reviewers: places that at least two reviewers raise."""
    return findings.where("location is not null").groupBy("location").agg(F.count_distinct("reviewer").alias("reviewers")).where(F.col("reviewers") >= least)


def hard_fail(tickets: DataFrame) -> DataFrame:
    """chapter, n, n_critical, failed."""
    bad = F.sum((F.col("severity") == "critical").cast("int"))
    return tickets.groupBy("chapter").agg(F.count(F.lit(1)).alias("n"), bad.alias("n_critical"), (bad > 0).alias("failed"))


def arm_drift(docs: DataFrame, arm: str, terms: str, flag: float = 0.6) -> DataFrame:
    """arm, n_docs, drift (mean cosine between the term counts of its documents), flagged.

    The mean over all pairs follows from the sum of the unit vectors, so no pair is formed:
    |sum|^2 = n + 2 * sum of the cosines.
    """
    counts = docs.select(arm, "doc_id", F.explode(terms).alias("t")).groupBy(arm, "doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    norm = counts.groupBy(arm, "doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    unit = counts.join(norm, [arm, "doc_id"]).groupBy(arm, "t").agg(F.sum(F.col("n") / F.col("len")).alias("s"))
    size = norm.groupBy(arm).agg(F.count(F.lit(1)).alias("n_docs"))
    s = unit.groupBy(arm).agg(F.sum(F.col("s") * F.col("s")).alias("sq")).join(size, arm)
    drift = F.when(F.col("n_docs") > 1, (F.col("sq") - F.col("n_docs")) / (F.col("n_docs") * (F.col("n_docs") - 1)))
    return s.select(arm, "n_docs", drift.alias("drift"), F.coalesce(drift > flag, F.lit(False)).alias("flagged"))


def signal_deltas(scores: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """signal, n, mean_delta: second arm minus first per prompt where both have a score. scores: prompt, arm, signal, value."""
    a, b = (scores.where(F.col("arm") == x).groupBy("prompt", "signal").agg(F.avg("value").alias(f"v{i}")) for i, x in enumerate(arms))
    return a.join(b, ["prompt", "signal"]).groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("v1") - F.col("v0")).alias("mean_delta"))


def success(violations: Column, deltas: Column, win_rate: Column, trust_drop: Column, drift_change: Column) -> Column:
    """No floor violation, all mean deltas above 0, win rate above a half, trust not worse, drift lower."""
    return (violations == 0) & F.forall(deltas, lambda d: d > 0) & (win_rate > 0.5) & (trust_drop <= 0) & (drift_change < 0)


def floor_gate(scores: DataFrame, floors: dict[str, float]) -> DataFrame:
    """doc_id, signal, value, floor of scores below their floor. scores: doc_id, signal, value."""
    listed = F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(float(v)))])
    return scores.withColumn("floor", listed[F.col("signal")]).where(F.col("value") < F.col("floor")).select("doc_id", "signal", "value", "floor")


def coverage(df: DataFrame, node: str, n: str, required: int = 3) -> DataFrame:
    """node, n, coverage = least(1, n / required), lowest first."""
    return df.select(node, n, F.least(F.lit(1.0), F.col(n) / required).alias("coverage")).orderBy("coverage", node)


def governance(votes: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, pros, cons, state: unknown without rows, contradicted with any contradiction, insufficient below two supports, else pass."""
    s = votes.groupBy("rule").agg(F.sum((F.col("stance") == "support").cast("int")).alias("pros"), F.sum((F.col("stance") == "contradict").cast("int")).alias("cons"))
    j = rules.select("rule").distinct().join(s, "rule", "left")
    state = F.when(F.col("pros").isNull(), "unknown").when(F.col("cons") > 0, "contradicted").when(F.col("pros") < 2, "insufficient").otherwise("pass")
    return j.select("rule", F.coalesce("pros", F.lit(0)).alias("pros"), F.coalesce("cons", F.lit(0)).alias("cons"), state.alias("state"))


#: Schools that a table of consensus may have as columns.
MOST_SCHOOLS = 200


def consensus(positions: DataFrame, schools: list[str] | None = None) -> DataFrame:
    """rule by school: the prevailing stance of each cell (support, contradict, mixed). Without schools all of the table, at most MOST_SCHOOLS."""
    if schools is None:
        found = [r[0] for r in positions.select("school").where("school is not null").distinct().orderBy("school").limit(MOST_SCHOOLS + 1).collect()]
        if len(found) > MOST_SCHOOLS:
            raise ValueError(f"more than {MOST_SCHOOLS} schools")
        schools = found
    s = positions.groupBy("rule").pivot("school", schools).agg(F.sum(F.when(F.col("stance") == "support", 1).when(F.col("stance") == "contradict", -1).otherwise(0)))
    return s.select("rule", *[F.when(F.col(f"`{x}`") > 0, "support").when(F.col(f"`{x}`") < 0, "contradict").when(F.col(f"`{x}`") == 0, "mixed").alias(x) for x in schools])


def sets_difference(refs: DataFrame, defs: DataFrame, key: str) -> DataFrame:
    """key, side (missing: referred to and not defined; extra: defined and not referred to)."""
    j = refs.select(key).distinct().withColumn("r", F.lit(1)).join(defs.select(key).distinct().withColumn("d", F.lit(1)), key, "full_outer")
    return j.where("r is null or d is null").select(key, F.when(F.col("d").isNull(), "missing").otherwise("extra").alias("side"))


def stratified_sample(df: DataFrame, strata: list[str], key: str, per_stratum: int, seed: int = 0) -> DataFrame:
    """The rows of the smallest hashes of key per stratum: a sample that does not change between runs."""
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_stratum).drop("_r")


def audit_sample(df: DataFrame, strata: list[str], key: str, share: float = 0.05, seed: int = 0) -> DataFrame:
    """About a share of each stratum, at least one row of it, by hash of key."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000))
    least = df.groupBy(*strata).agg(F.min(F.struct(h.alias("h"), F.col(key).alias("k"))).alias("_least"))
    return df.join(least, strata).where((h < int(share * 1_000_000)) | (F.col(key) == F.col("_least.k"))).drop("_least")


def triage(candidates: DataFrame, cap: int = 25, auto: float = 0.75, manual: float = 0.55) -> DataFrame:
    """id, score, decision: the best up to cap at or above auto are approved, others down to manual go to a person, the rest are rejected."""
    w = Window.orderBy(F.col("score").desc(), "id")
    best = candidates.where(F.col("score") >= auto).orderBy(F.col("score").desc(), "id").limit(cap).withColumn("_r", F.row_number().over(w)).select("id", "_r")
    j = candidates.join(best, "id", "left")
    return j.select("id", "score", F.when(F.col("_r").isNotNull(), "auto").when(F.col("score") >= manual, "manual").otherwise("reject").alias("decision"))
