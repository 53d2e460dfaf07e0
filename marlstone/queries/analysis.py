"""Queries of evaluation, retrieval, rules, induction and review roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.keys import norm_key
from marlstone.operators import argument, composition, consistency, evaluation, induction, ledger, lint, ordered, retrieval
from marlstone.plans import rules
from marlstone.plans.catalog import GraphCatalog
from marlstone.queries.graph import current_claims, current_counter_claims
from marlstone.queries.instants import COUNTERS_AT, WRITERS
from marlstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_labels").where("label is not null")


def eval_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the raters over documents rated by the usual number."""
    k = evaluation.fleiss_kappa(_labels(spark, d).dropDuplicates(["doc_id", "rater"]), "doc_id", "label")
    return k.select("n_items", "raters", F.round("kappa", 6).alias("kappa"))


def eval_rater_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of objections of each rater with its Wilson interval."""
    w = evaluation.win_rates(_labels(spark, d), "rater", F.col("label") != "none")
    return w.select("rater", "n", "wins", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


def eval_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Rater r1's objections against those of r2, by document and label."""
    rows = _labels(spark, d).where("label <> 'none'")
    pick = lambda r: rows.where(F.col("rater") == r).select(F.col("doc_id").alias("item"), F.col("label").alias("span"))
    a = evaluation.attribution(pick("r1"), pick("r2"))
    return a.select("tp", "n_predicted", "n_gold", *[F.round(c, 6).alias(c) for c in ("micro_precision", "micro_recall", "macro_precision", "macro_recall")], "status")


def eval_factuality(spark: SparkSession, d: str) -> DataFrame:
    """Counter-claims as assertions about claims: targets missing, dismissed, disputed or backed."""
    a = current_counter_claims(spark, d).select(F.col("target_claim_id").alias("claim_id"), F.when(F.col("status") == "dismissed", "none").otherwise("full").alias("check_status"))
    return evaluation.factuality(a, current_claims(spark, d))


def eval_confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    """Median and mean confidence per claim type, over current claims."""
    return evaluation.rater_summary(current_claims(spark, d), "claim_type", "confidence")


def eval_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user at most an hour apart, as sessions."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return ordered.gap_clusters(e, "user_id", "t", "t", 3_600_000_000, 86_400_000_000)


def eval_arm_drift(spark: SparkSession, d: str) -> DataFrame:
    """How alike the openings of the documents of each kind are."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "doc_kind", F.transform(T.sentences(F.col("text")), T.first_word).alias("t"))
    return evaluation.arm_drift(docs, "doc_kind", "t").select("doc_kind", "n_docs", F.round("drift", 6).alias("drift"), "flagged")


def eval_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Verified claims per chapter against fifty required; the operator itself asks for three."""
    c = current_claims(spark, d).where("status = 'verified'").select("claim_id", F.explode(F.array_distinct("supports_chapters")).alias("chapter"))
    n = c.groupBy(norm_key(F.col("chapter")).alias("chapter")).agg(F.count(F.lit(1)).alias("n"))
    return evaluation.coverage(n, "chapter", "n", 50).select("chapter", "n", F.round("coverage", 6).alias("coverage"))


def eval_governance(spark: SparkSession, d: str) -> DataFrame:
    """Chapters as rules, verified claims for them and refuted ones against."""
    v = current_claims(spark, d).select(F.explode(F.array_distinct("supports_chapters")).alias("rule"), F.when(F.col("status") == "verified", "support").when(F.col("status") == "refuted", "contradict").alias("stance")).where("stance is not null")
    return evaluation.governance(v, table(spark, d, "documents").where("chapter_id is not null").select(F.col("chapter_id").alias("rule")))


def eval_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Stance of each semantic class by claim type."""
    c = current_claims(spark, d).where("semantic_class is not null").select(
        F.col("semantic_class").alias("rule"), F.col("claim_type").alias("school"), F.when(F.col("status") == "verified", "support").when(F.col("status").isin("refuted", "disputed"), "contradict").otherwise("none").alias("stance"))
    return evaluation.consensus(c)


def eval_chapter_difference(spark: SparkSession, d: str) -> DataFrame:
    """Chapters by language that transcripts hold and digests lack, and the reverse."""
    docs = table(spark, d, "documents").where("chapter_id is not null and lang is not null")
    of = lambda kind: docs.where(F.col("doc_kind") == kind).select(F.concat_ws("/", "chapter_id", "lang").alias("chapter"))
    return evaluation.sets_difference(of("transcript"), of("digest"), "chapter")


def eval_sample(spark: SparkSession, d: str) -> DataFrame:
    """Two documents of each source and kind, by hash."""
    return evaluation.stratified_sample(table(spark, d, "documents").select("doc_id", "source", "doc_kind"), ["source", "doc_kind"], "doc_id", 2)


def eval_triage(spark: SparkSession, d: str) -> DataFrame:
    c = current_claims(spark, d).where("confidence is not null").select(F.col("claim_id").alias("id"), F.col("confidence").alias("score"))
    return evaluation.triage(c).select("id", F.round("score", 6).alias("score"), "decision")


def eval_hard_fail(spark: SparkSession, d: str) -> DataFrame:
    """Open counter-claims per chapter that addresses them, critical where the vector is mechanism."""
    t = current_counter_claims(spark, d).where("addressed_in_chapter is not null").select(F.col("addressed_in_chapter").alias("chapter"), F.when(F.col("disagreement_vector") == "mechanism", "critical").otherwise("minor").alias("severity"))
    return evaluation.hard_fail(t)


def eval_convergence(spark: SparkSession, d: str) -> DataFrame:
    """Claims that two writers or more object to."""
    c = current_counter_claims(spark, d).select(F.col("target_claim_id").alias("location"), F.col("provenance.generator").alias("reviewer"))
    return evaluation.convergence(c)


def eval_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several records of the claims state, as findings of their writers."""
    c = table(spark, d, "claims").select(F.col("canonical_text").alias("text"), F.col("claim_type").alias("severity"), F.col("generated_by_run").alias("reviewer"))
    return evaluation.dedup_findings(c).where("n > 1")


# retrieval


def retrieval_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of all vectors to every vector whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    out = retrieval.top_k(e.where("vec_id % 100 = 0"), e, 5)
    return out.select("query", "item", F.round("score", 6).alias("score"), "rank")


def retrieval_coherence(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.coherence(table(spark, d, "embeddings"), "label").select("label", "n", F.round("coherence", 6).alias("coherence"))


# rules and induction

#: Lifts and constraints of the demonstration rule set.
LIFTS = r"""
(deflift :reported-cases :kind :int :pattern "^(?<subject>[A-Z]\\w+) reports (?<value>\\d+) cases")
(deflift :gained :kind :int :pattern "^Compared with the \\w+ (?<subject>[\\w-]+), .* and gained (?<value>\\d+)\\.$")
(deflift :lost :kind :int :pattern "^Compared with the \\w+ (?<subject>[\\w-]+), the [\\w-]+ lost (?<value>\\d+)")
(deflift :year :kind :int :subject "corpus" :pattern "^We (?:kept|moved|dropped|renamed|questioned) .* in (?<value>\\d{4})\\.$")
(deflift :section :kind :real :pattern "^Section (?<value>\\d+\\.\\d+) \\w+ the (?<subject>[\\w-]+)")
"""
CHECKS = """
(defconstraint :cases-positive :severity :critical :assert (> reported-cases 0))
(defconstraint :cases-below-thousand :severity :important :assert (and (>= reported-cases 0) (< reported-cases 990)))
(defconstraint :recent-years :severity :minor :scope :corpus :assert (and (>= year 1900) (<= year 2030)))
(defconstraint :gain-known :severity :minor :assert (=> (> gained 0) (>= gained 1)))
"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return rules.apply_lifts(current_claims(spark, d), rules.parse_lifts(LIFTS))


def rules_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("claim_id", "predicate", "subject", "value_num")


def rules_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rules.predicate_coverage(_facts(spark, d)).select("predicate", "n", F.round("share", 6).alias("share"))


def rules_checks(spark: SparkSession, d: str) -> DataFrame:
    c = rules.check_constraints(_facts(spark, d), rules.parse_constraints(CHECKS))
    return c.select("constraint", "severity", "subject", "status")


def rules_verdict(spark: SparkSession, d: str) -> DataFrame:
    return rules.verdict(rules.check_constraints(_facts(spark, d), rules.parse_constraints(CHECKS)))


def rules_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Quantities that read as "<subject> length is <value> <unit>", made of the parts of the trade tables."""
    p = table(spark, d, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("claim_id"),
        F.concat(F.lit("part "), F.col("p_brand"), F.lit(" length is "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " cm").otherwise(" metres")).alias("canonical_text"))
    q = ledger.normal_forms(p.withColumn("canonical_text", F.regexp_replace("canonical_text", "#", " ")))["claim-quantity"]
    return q.select("claim_id", F.round("value", 6).alias("value"), "unit", F.round("canonical_value", 6).alias("canonical_value"), "canonical_unit", "dimension")


def rules_quantity_clashes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("claim_id"),
        F.concat(F.lit("part "), F.regexp_replace("p_brand", "#", " "), F.lit(" length is "), F.col("p_size").cast("string"), F.lit(" cm")).alias("canonical_text"))
    c = GraphCatalog(spark)
    for name, df in ledger.normal_forms(p).items():
        c.put(name, df)
    out = argument.quantity_clashes(c)
    return out.select("claim_a", "claim_b", "subject", F.round("left_value", 6).alias("left_value"), F.round("right_value", 6).alias("right_value"), "unit", "n_a", "n_b")


def rules_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """The tolerance within which posterior and prior of current claims agree."""
    t = rules.fit_tolerance(current_claims(spark, d), "p_posterior", "p_prior", 100.0)
    return t.select(F.round("eps", 6).alias("eps"))


def induce_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Claim types stated together of a chapter and semantic class."""
    c = current_claims(spark, d).where("semantic_class is not null").select(F.explode("supports_chapters").alias("doc_id"), F.col("semantic_class").alias("subject"), F.col("claim_type").alias("predicate"))
    return induction.cooccurring(c)


def induce_holdout(spark: SparkSession, d: str) -> DataFrame:
    """How often prior and confidence stay close, by folds of the writers' runs."""
    c = current_claims(spark, d).where("generated_by_run is not null")
    facts = c.select(F.col("generated_by_run").alias("doc_id"), F.explode(F.array(
        F.struct(F.lit("confidence").alias("predicate"), F.col("confidence").alias("value_num")), F.struct(F.lit("p_prior").alias("predicate"), F.col("p_prior").alias("value_num")))).alias("f")).select("doc_id", "f.*")
    from marlstone.plans.edn import read_edn

    h = induction.holdout(facts, induction.document_folds(facts), read_edn("(~= confidence p_prior 0.25)"), ["confidence", "p_prior"])
    return h.select("fold", "n_docs", F.round("sat_rate", 6).alias("sat_rate"), "passes")


def induce_status(spark: SparkSession, d: str) -> DataFrame:
    """Entrenchment of chapters as rules: share of verified claims, weighted by the number of sources."""
    c = current_claims(spark, d).select(F.explode(F.array_distinct("supports_chapters")).alias("rule"), "status", F.col("generated_by_run").alias("doc"))
    s = c.groupBy("rule").agg(F.avg((F.col("status") == "verified").cast("int")).alias("rate"), F.count_distinct("doc").alias("n_docs"))
    e = induction.entrenchment(F.coalesce("rate", F.lit(0.0)), F.col("n_docs"))
    return s.select("rule", F.round(e, 6).alias("entrenchment"), induction.entrenchment_status(F.round(e, 6)).alias("status"))


QUERIES: dict[str, Query] = {
    **{f.__name__: f for f in (
        eval_kappa, eval_rater_rates, eval_attribution, eval_factuality, eval_confidence_bands, eval_sessions, eval_arm_drift, eval_coverage, eval_governance, eval_consensus,
        eval_chapter_difference, eval_sample, eval_triage, eval_hard_fail, eval_convergence, eval_dedup, retrieval_top_k, retrieval_coherence, rules_facts, rules_coverage,
        rules_checks, rules_verdict, rules_normal_forms, rules_quantity_clashes, rules_tolerance, induce_pairs, induce_holdout, induce_status)},
}

_CUR = """cur AS (SELECT * REPLACE (lower(trim(claim_id)) AS claim_id, lower(trim(status)) AS status) FROM claims
    QUALIFY row_number() OVER (PARTITION BY lower(trim(claim_id)) ORDER BY ledger_seq DESC) = 1)"""
_CC = f"""{WRITERS}, {COUNTERS_AT}, cc AS (SELECT * REPLACE (lower(trim(id)) AS id, lower(trim(target_claim_id)) AS target_claim_id, lower(trim(status)) AS status) FROM cj_at
    QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY us DESC NULLS LAST) = 1)"""
_WIL = "(wins / n + 1.9208 / n {} 1.96 * sqrt((wins / n) * (1 - wins / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)"
_FACTS = r"""fx AS (SELECT claim_id, CASE WHEN regexp_matches(canonical_text, '^[A-Z]\w+ reports \d+ cases') THEN 'reported-cases'
    WHEN regexp_matches(canonical_text, '^Compared with the \w+ [\w-]+, .* and gained \d+\.$') THEN 'gained' WHEN regexp_matches(canonical_text, '^Compared with the \w+ [\w-]+, the [\w-]+ lost \d+') THEN 'lost'
    WHEN regexp_matches(canonical_text, '^We (?:kept|moved|dropped|renamed|questioned) .* in \d{4}\.$') THEN 'year' WHEN regexp_matches(canonical_text, '^Section \d+\.\d+ \w+ the [\w-]+') THEN 'section' ELSE 'OPAQUE' END AS predicate, canonical_text AS t FROM cur),
facts AS (SELECT claim_id, predicate, lower(CASE predicate WHEN 'reported-cases' THEN regexp_extract(t, '^([A-Z]\w+) reports', 1) WHEN 'gained' THEN regexp_extract(t, '^Compared with the \w+ ([\w-]+),', 1)
    WHEN 'lost' THEN regexp_extract(t, '^Compared with the \w+ ([\w-]+),', 1) WHEN 'year' THEN 'corpus' WHEN 'section' THEN regexp_extract(t, '^Section \d+\.\d+ \w+ the ([\w-]+)', 1) END) AS subject,
    CAST(CASE predicate WHEN 'reported-cases' THEN regexp_extract(t, ' reports (\d+) cases', 1) WHEN 'gained' THEN regexp_extract(t, ' and gained (\d+)\.$', 1) WHEN 'lost' THEN regexp_extract(t, ' lost (\d+)', 1)
    WHEN 'year' THEN regexp_extract(t, ' in (\d{4})\.$', 1) WHEN 'section' THEN regexp_extract(t, '^Section (\d+\.\d+)', 1) END AS DOUBLE) AS value_num FROM fx)"""
SQL: dict[str, str] = {
    "eval_kappa": """WITH l AS (SELECT DISTINCT ON (doc_id, rater) doc_id, rater, label FROM content_labels WHERE label IS NOT NULL), c AS (SELECT doc_id, label, count(*) AS n FROM l GROUP BY 1, 2),
        p AS (SELECT doc_id, sum(n) AS r, sum(n * n) AS sq FROM c GROUP BY 1), u AS (SELECT r FROM p WHERE r > 1 GROUP BY r ORDER BY count(*) DESC, r DESC LIMIT 1), k AS (SELECT p.* FROM p JOIN u USING (r)),
        a AS (SELECT count(*) AS n_items, any_value(r) AS raters, avg((sq - r) / (r * (r - 1))) AS pa FROM k), s AS (SELECT sum(n) AS n FROM c JOIN k USING (doc_id) GROUP BY label), e AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS pe FROM s)
        SELECT n_items, CAST(raters AS BIGINT) AS raters, round((pa - pe) / (1 - pe), 6) AS kappa FROM a, e""",
    "eval_rater_rates": f"""WITH w AS (SELECT rater, count(*) AS n, count(*) FILTER (label <> 'none') AS wins FROM content_labels WHERE label IS NOT NULL GROUP BY 1)
        SELECT rater, n, wins, round(wins / n, 6) AS rate, round({_WIL.format('-')}, 6) AS low, round({_WIL.format('+')}, 6) AS high FROM w""",
    "eval_attribution": """WITH l AS (SELECT DISTINCT doc_id, rater, label FROM content_labels WHERE label <> 'none'), p AS (SELECT doc_id, label FROM l WHERE rater = 'r1'), g AS (SELECT doc_id, label FROM l WHERE rater = 'r2'),
        b AS (SELECT coalesce(p.doc_id, g.doc_id) AS i, count(*) FILTER (p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(p.doc_id) AS np, count(g.doc_id) AS ng FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.label = g.label GROUP BY 1)
        SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np) AS BIGINT) AS n_predicted, CAST(sum(ng) AS BIGINT) AS n_gold, round(sum(tp) / nullif(sum(np), 0), 6) AS micro_precision, round(sum(tp) / nullif(sum(ng), 0), 6) AS micro_recall,
        round(avg(tp / nullif(np, 0)), 6) AS macro_precision, round(avg(tp / nullif(ng, 0)), 6) AS macro_recall, CASE WHEN sum(ng) > 0 THEN 'scored' ELSE 'unscored' END AS status FROM b""",
    "eval_factuality": f"""WITH {_CUR}, {_CC} SELECT CASE WHEN target_claim_id IS NULL OR target_claim_id = '' THEN 'novel' WHEN cc.status = 'dismissed' THEN 'unsupported' WHEN cur.status = 'disputed' THEN 'disputed' ELSE 'verified' END AS part, count(*) AS n
        FROM cc LEFT JOIN cur ON cur.claim_id = target_claim_id GROUP BY 1""",
    "eval_confidence_bands": f"WITH {_CUR} SELECT claim_type, count(*) AS n, round(median(confidence), 4) AS median, round(avg(confidence), 4) AS mean FROM cur WHERE confidence IS NOT NULL GROUP BY 1",
    "eval_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 3600000000 THEN 0 ELSE 1 END AS b FROM e),
        c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM g) SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM c GROUP BY user_id, c""",
    "eval_coverage": f"""WITH {_CUR}, x AS (SELECT claim_id, unnest(list_distinct(supports_chapters)) AS c FROM cur WHERE status = 'verified') SELECT lower(trim(c)) AS chapter, count(*) AS n, round(least(1, count(*) / 50), 6) AS coverage FROM x GROUP BY 1""",
    "eval_governance": f"""WITH {_CUR}, v AS (SELECT unnest(list_distinct(supports_chapters)) AS rule, status FROM cur WHERE status IN ('verified', 'refuted')), r AS (SELECT DISTINCT chapter_id AS rule FROM documents WHERE chapter_id IS NOT NULL),
        s AS (SELECT rule, count(*) FILTER (status = 'verified') AS pros, count(*) FILTER (status = 'refuted') AS cons FROM v GROUP BY 1)
        SELECT rule, coalesce(pros, 0) AS pros, coalesce(cons, 0) AS cons, CASE WHEN pros IS NULL THEN 'unknown' WHEN cons > 0 THEN 'contradicted' WHEN pros < 2 THEN 'insufficient' ELSE 'pass' END AS state FROM r LEFT JOIN s USING (rule)""",
    "eval_consensus": f"""WITH {_CUR}, v AS (SELECT semantic_class AS rule, claim_type AS t, sum(CASE WHEN status = 'verified' THEN 1 WHEN status IN ('refuted', 'disputed') THEN -1 ELSE 0 END) AS s FROM cur WHERE semantic_class IS NOT NULL GROUP BY 1, 2)
        SELECT rule, {', '.join(f"max(CASE WHEN t = '{t}' THEN CASE WHEN s > 0 THEN 'support' WHEN s < 0 THEN 'contradict' ELSE 'mixed' END END) AS {t}" for t in ('definition', 'design_decision', 'fact', 'method', 'open_question', 'result'))} FROM v GROUP BY rule""",
    "eval_chapter_difference": """WITH x AS (SELECT DISTINCT doc_kind, chapter_id || '/' || lang AS chapter FROM documents WHERE chapter_id IS NOT NULL AND lang IS NOT NULL), r AS (SELECT chapter FROM x WHERE doc_kind = 'transcript'), t AS (SELECT chapter FROM x WHERE doc_kind = 'digest')
        SELECT coalesce(r.chapter, t.chapter) AS chapter, CASE WHEN t.chapter IS NULL THEN 'missing' ELSE 'extra' END AS side FROM r FULL JOIN t ON r.chapter = t.chapter WHERE r.chapter IS NULL OR t.chapter IS NULL""",
    "eval_triage": f"""WITH {_CUR}, b AS (SELECT claim_id FROM cur WHERE confidence >= 0.75 ORDER BY confidence DESC, claim_id LIMIT 25)
        SELECT claim_id AS id, round(confidence, 6) AS score, CASE WHEN claim_id IN (SELECT claim_id FROM b) THEN 'auto' WHEN confidence >= 0.55 THEN 'manual' ELSE 'reject' END AS decision FROM cur WHERE confidence IS NOT NULL""",
    "eval_hard_fail": f"""WITH {_CC} SELECT addressed_in_chapter AS chapter, count(*) AS n, count(*) FILTER (disagreement_vector = 'mechanism') AS n_critical, count(*) FILTER (disagreement_vector = 'mechanism') > 0 AS failed
        FROM cc WHERE addressed_in_chapter IS NOT NULL GROUP BY 1""",
    "eval_convergence": f"WITH {_CC} SELECT target_claim_id AS location, count(DISTINCT provenance.generator) AS reviewers FROM cc WHERE target_claim_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT provenance.generator) >= 2",
    "eval_dedup": "SELECT lower(trim(canonical_text)) AS text, claim_type AS severity, count(*) AS n, count(DISTINCT generated_by_run) AS reviewers FROM claims WHERE canonical_text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "retrieval_top_k": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM e),
        s AS (SELECT q.vec_id AS query, i.vec_id AS item, round(list_dot_product(q.v, i.v) / (q.l * i.l), 12) AS score FROM n q JOIN n i ON q.vec_id <> i.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query, item, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s QUALIFY rank <= 5""",
    "retrieval_coherence": """WITH e AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
        d AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM u), s AS (SELECT label, d, sum(x) AS s FROM d GROUP BY 1, 2), q AS (SELECT label, sum(s * s) AS sq FROM s GROUP BY 1), c AS (SELECT label, count(*) AS n FROM e GROUP BY 1)
        SELECT label, n, CASE WHEN n < 2 THEN 1.0 ELSE round((sq - n) / (n * (n - 1)), 6) END AS coherence FROM c JOIN q USING (label)""",
    "rules_facts": f"WITH {_CUR}, {_FACTS} SELECT * FROM facts",
    "rules_coverage": f"WITH {_CUR}, {_FACTS} SELECT predicate, count(*) AS n, round(count(*) / (SELECT count(*) FROM facts), 6) AS share FROM facts GROUP BY 1",
    "rules_checks": f"""WITH {_CUR}, {_FACTS}, r AS (SELECT subject, min(value_num) FILTER (predicate = 'reported-cases') AS lo, max(value_num) FILTER (predicate = 'reported-cases') AS hi, min(value_num) FILTER (predicate = 'gained') AS gl, max(value_num) FILTER (predicate = 'gained') AS gh
        FROM facts WHERE predicate IN ('reported-cases', 'gained') GROUP BY 1)
        SELECT 'cases-positive' AS "constraint", 'critical' AS severity, subject, CASE WHEN lo IS NULL THEN 'unknown' WHEN lo <= 0 THEN 'unsat' ELSE 'sat' END AS status FROM r
        UNION ALL SELECT 'cases-below-thousand', 'important', subject, CASE WHEN lo IS NULL THEN 'unknown' WHEN lo < 0 OR hi >= 990 THEN 'unsat' ELSE 'sat' END FROM r
        UNION ALL SELECT 'gain-known', 'minor', subject, CASE WHEN gl IS NULL THEN 'unknown' WHEN (gl > 0 AND gl < 1) OR (gh > 0 AND gh < 1) THEN 'unsat' ELSE 'sat' END FROM r
        UNION ALL SELECT 'recent-years', 'minor', '*', CASE WHEN min(value_num) < 1900 OR max(value_num) > 2030 THEN 'unsat' ELSE 'sat' END FROM facts WHERE predicate = 'year' HAVING count(*) > 0""",
    "rules_normal_forms": """SELECT 'part-' || p_partkey AS claim_id, CAST(p_size AS DOUBLE) AS value, CASE WHEN p_partkey % 2 = 0 THEN 'cm' ELSE 'metres' END AS unit,
        round(p_size * CASE WHEN p_partkey % 2 = 0 THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END, 6) AS canonical_value, 'm' AS canonical_unit, 'length' AS dimension FROM part""",
    "rules_quantity_clashes": """WITH c AS (SELECT lower('part ' || replace(p_brand, '#', ' ')) AS subject, p_size * 0.01::DOUBLE AS v, min('part-' || p_partkey) AS claim, count(*) AS n FROM part GROUP BY 1, 2)
        SELECT a.claim AS claim_a, b.claim AS claim_b, a.subject, round(a.v, 6) AS left_value, round(b.v, 6) AS right_value, 'm' AS unit, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.subject = b.subject AND a.claim < b.claim AND abs(a.v - b.v) > 1e-6""",
    "rules_tolerance": f"WITH {_CUR} SELECT round(max(abs(p_posterior - p_prior) / abs(p_prior)), 6) AS eps FROM cur WHERE p_posterior IS NOT NULL AND p_prior IS NOT NULL",
    "induce_pairs": f"""WITH {_CUR}, f AS (SELECT DISTINCT unnest(supports_chapters) AS d, semantic_class AS s, claim_type AS p FROM cur WHERE semantic_class IS NOT NULL)
        SELECT a.p AS left_predicate, b.p AS right_predicate, count(*) AS support FROM f a JOIN f b ON a.d = b.d AND a.s = b.s AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 200""",
    "induce_holdout": f"""WITH {_CUR}, f AS (SELECT generated_by_run AS d, max(coalesce(confidence, 1)) AS c, max(coalesce(p_prior, 1)) AS p FROM cur WHERE generated_by_run IS NOT NULL GROUP BY 1), o AS (SELECT *, (row_number() OVER (ORDER BY d) - 1) % 5 AS fold FROM f)
        SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_docs, round(avg(CASE WHEN abs(c - p) <= 0.25 THEN 1 ELSE 0 END), 6) AS sat_rate, avg(CASE WHEN abs(c - p) <= 0.25 THEN 1 ELSE 0 END) >= 0.5 AS passes FROM o GROUP BY fold""",
    "induce_status": f"""WITH {_CUR}, c AS (SELECT unnest(list_distinct(supports_chapters)) AS rule, status, generated_by_run AS doc FROM cur), s AS (SELECT rule, round(coalesce(avg(CASE WHEN status = 'verified' THEN 1 WHEN status IS NULL THEN NULL ELSE 0 END), 0) * least(count(DISTINCT doc) / 10, 1), 6) AS e FROM c GROUP BY 1)
        SELECT rule, e AS entrenchment, CASE WHEN e >= 0.7 THEN 'active' WHEN e >= 0.4 THEN 'tentative' ELSE 'quarantined' END AS status FROM s""",
}
SQL |= {
    "eval_arm_drift": r"""WITH s AS (SELECT doc_id, doc_kind, unnest(list_transform(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12))), lambda x: x <> ''),
        lambda x: lower(regexp_extract(x, '^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)', 1)))) AS t FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_kind, doc_id, t, count(*) AS n FROM s GROUP BY 1, 2, 3), l AS (SELECT doc_kind, doc_id, sqrt(sum(n * n)) AS len FROM c GROUP BY 1, 2), u AS (SELECT doc_kind, t, sum(n / len) AS s FROM c JOIN l USING (doc_kind, doc_id) GROUP BY 1, 2),
        q AS (SELECT doc_kind, sum(s * s) AS sq FROM u GROUP BY 1), k AS (SELECT doc_kind, count(*) AS n_docs FROM l GROUP BY 1)
        SELECT doc_kind, n_docs, round((sq - n_docs) / (n_docs * (n_docs - 1)), 6) AS drift, (sq - n_docs) / (n_docs * (n_docs - 1)) > 0.6 AS flagged FROM q JOIN k USING (doc_kind)""",
    "rules_verdict": f"""WITH {_CUR}, {_FACTS}, r AS (SELECT subject, min(value_num) FILTER (predicate = 'reported-cases') AS lo, max(value_num) FILTER (predicate = 'reported-cases') AS hi, min(value_num) FILTER (predicate = 'gained') AS gl FROM facts WHERE predicate IN ('reported-cases', 'gained') GROUP BY 1),
        c AS (SELECT CASE WHEN lo IS NULL THEN 'unknown' WHEN lo <= 0 THEN 'unsat' ELSE 'sat' END AS s FROM r UNION ALL SELECT CASE WHEN lo IS NULL THEN 'unknown' WHEN lo < 0 OR hi >= 990 THEN 'unsat' ELSE 'sat' END FROM r
        UNION ALL SELECT CASE WHEN gl IS NULL THEN 'unknown' ELSE 'sat' END FROM r UNION ALL SELECT CASE WHEN min(value_num) < 1900 OR max(value_num) > 2030 THEN 'unsat' ELSE 'sat' END FROM facts WHERE predicate = 'year' HAVING count(*) > 0)
        SELECT count(*) FILTER (s = 'sat') AS n_sat, count(*) FILTER (s = 'unknown') AS n_unknown, count(*) FILTER (s = 'unsat') AS n_unsat, CASE WHEN count(*) FILTER (s = 'unsat') > 0 THEN 'unsat' WHEN count(*) FILTER (s = 'unknown') > 0 THEN 'unknown' ELSE 'sat' END AS status FROM c""",
}


def thesis_defects(spark: SparkSession, d: str) -> DataFrame:
    """Defects of the thesis trees: roots as theses, chapters and evidence of the newest revisions, claims as facts about their type."""
    raw = table(spark, d, "thesis_nodes").withColumns({"node_id": norm_key(F.col("node_id")), "parent_id": norm_key(F.col("parent_id"))})
    newest = ledger.latest_per(raw, "node_id", "revised_at")
    parents = newest.select(F.col("node_id").alias("parent_id"), F.lit(1).alias("known"))
    nodes = newest.join(parents, "parent_id", "left")
    subs = nodes.where("known = 1")
    c = GraphCatalog(spark)
    c.put("thesis-node", nodes.where("known is null").select(F.col("node_id").alias("id"), "statement"))
    c.put("sub-argument", subs.select(F.col("node_id").alias("id"), F.col("parent_id").alias("parent"), "statement"))
    c.put("sub-arg-chapter", subs.where("chapter_id is not null").select(F.col("node_id").alias("id"), F.col("node_id").alias("sub_arg_id"), F.col("chapter_id").alias("chapter")))
    c.put("sub-arg-evidence", subs.where("required_evidence_kind is not null").select(F.col("node_id").alias("id"), F.col("node_id").alias("sub_arg_id"), F.col("required_evidence_kind").alias("evidence")))
    claims = current_claims(spark, d)
    c.put("claim-fact", claims.where("status = 'verified'").select(F.col("claim_id").alias("id"), F.col("claim_type").alias("subject"), F.col("semantic_class").alias("value")))
    c.put("claim-conflict", claims.select("claim_id", F.explode("conflicts_with").alias("o")).select(F.concat_ws("-", "claim_id", "o").alias("id"), "claim_id", norm_key(F.col("o")).alias("other_id")))
    return consistency.thesis_defects(c)


def concept_first_chapter(spark: SparkSession, d: str) -> DataFrame:
    """The first chapter of every title-case concept of the documents."""
    docs = table(spark, d, "documents").where("chapter_id is not null")
    named = lint.title_case_concepts(docs).join(docs.select("doc_id", F.col("chapter_id").alias("chapter")), "doc_id")
    return composition.first_introduced(named)


def compose_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """What the last text of a claim loses or adds against its first, by kind."""
    c = table(spark, d, "claims").where("canonical_text is not null").groupBy(norm_key(F.col("claim_id")).alias("id")).agg(
        F.min_by("canonical_text", F.struct("ledger_seq", "canonical_text")).alias("before"), F.max_by("canonical_text", F.struct("ledger_seq", "canonical_text")).alias("after"))
    return composition.argument_losses(c.where("before <> after")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_claims"))


QUERIES |= {f.__name__: f for f in (thesis_defects, concept_first_chapter, compose_rewrites)}
SQL |= {
    "thesis_defects": f"""WITH {_CUR}, n AS (SELECT lower(trim(node_id)) AS node, lower(trim(parent_id)) AS parent, chapter_id, required_evidence_kind AS ev FROM thesis_nodes WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(node_id)) ORDER BY revised_at DESC) = 1),
        s AS (SELECT * FROM n WHERE parent IN (SELECT node FROM n)), f AS (SELECT claim_type AS s, semantic_class AS v, min(claim_id) AS c FROM cur WHERE status = 'verified' AND claim_type IS NOT NULL AND semantic_class IS NOT NULL GROUP BY 1, 2),
        k AS (SELECT DISTINCT least(claim_id, o) AS a, greatest(claim_id, o) AS b FROM (SELECT claim_id, lower(trim(x)) AS o FROM (SELECT claim_id, unnest(conflicts_with) AS x FROM cur) WHERE x IS NOT NULL) WHERE claim_id <> o)
        SELECT 'no-chapter' AS kind, node AS id, '' AS detail FROM s WHERE chapter_id IS NULL UNION ALL SELECT 'missing-evidence', node, ev FROM s WHERE ev IS NOT NULL AND ev NOT IN (SELECT s FROM f)
        UNION ALL SELECT 'contradiction', x.c, x.s || ' ' || x.v || ' against ' || y.v || ' ' || y.c FROM f x JOIN f y ON x.s = y.s AND x.v < y.v UNION ALL SELECT 'declared-conflict', a, b FROM k""",
    "concept_first_chapter": r"""WITH r AS (SELECT chapter_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\b((?:[A-Z][a-z]+)(?: [A-Z][a-z]+)+)\b', 1), lambda x: regexp_replace(x, '^(The|A|An) ', '')), lambda x: contains(x, ' ') AND x <> 'New York'))) AS concept
        FROM documents WHERE text IS NOT NULL AND chapter_id IS NOT NULL) SELECT lower(concept) AS concept, min(chapter_id) AS first_chapter, count(DISTINCT chapter_id) AS n_chapters FROM r GROUP BY 1""",
}
