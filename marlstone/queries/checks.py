"""Queries over design graphs, gates, panels, ballots and runs, and closures: their relations are made of the data tables by plain expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.keys import norm_key
from marlstone.operators import argument, belief, composition, consistency, design, evaluation, graphs, ledger, lint, style
from marlstone.plans import rules
from marlstone.plans.catalog import GraphCatalog
from marlstone.plans.query import constraint_report, run_query
from marlstone.queries import analysis, graph, prose
from marlstone.queries.graph import current_claims, current_counter_claims
from marlstone.sources import ledgers
from marlstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# the design graph of the trade tables: customers are requirements, suppliers code, parts tests, nations jobs


def _requirements(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("req-"), k).alias("id"), F.concat(F.lit("REQ-"), k).alias("requirement_id"), F.col("c_mktsegment").alias("capability"), F.lit("active").alias("status"),
        F.concat(F.lit("must call `fn_"), k % 150, F.lit("()` of `src/"), F.col("c_nationkey"), F.lit(".py`")).alias("text"),
        F.concat(F.lit("specs/"), F.col("c_mktsegment"), F.lit(".md")).alias("source_path"), k.alias("source_line"))


def _code(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("fn-"), k).alias("id"), F.concat(F.lit("fn_"), k, F.lit("()")).alias("label"), F.concat(F.lit("src/"), F.col("s_nationkey"), F.lit(".py")).alias("source_file"),
        (F.pmod(k, F.lit(20)) / 20).alias("rank"), F.concat(F.lit("group-"), F.pmod(k, F.lit(7))).alias("community"))


def _modules(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("s_nationkey"), F.lit(".py"))
    return table(spark, d, "supplier").select(F.concat(F.lit("mod-"), F.col("s_nationkey")).alias("id"), name.alias("label"), F.concat(F.lit("src/"), name).alias("source_file")).distinct()


def _tests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.concat(F.lit("test-"), k).alias("id"), F.concat(F.lit("REQ-"), k * 2).alias("target"), F.concat(F.lit("tests/t"), F.col("p_size"), F.lit(".py")).alias("source_path"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.concat(F.lit("job-"), k).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("pytest -q repo/tests/t"), k, F.lit(".py other.py")).alias("command"), F.lit(True).alias("required"), F.lit("*").alias("selector"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """A link per order: the priority gives the kind, an open order's is not promoted."""
    kind = F.substring("o_orderpriority", 1, 1)
    name = F.when(kind == "1", "requirement-implemented-by").when(kind == "2", "requirement-covered-by").when(kind == "3", "requirement-gated-by").when(kind == "4", "test-exercises-code").otherwise("workflow-runs-test")
    k = F.col("o_orderkey")
    frm = F.when(kind == "4", F.concat(F.lit("test-"), k % 2000)).when(kind == "5", F.concat(F.lit("job-"), k % 25)).otherwise(F.concat(F.lit("req-"), F.col("o_custkey")))
    to = F.when(kind == "1", F.concat(F.lit("fn-"), k % 100)).when(kind == "4", F.concat(F.lit("fn-"), k % 17 * 5)).when(kind == "3", F.concat(F.lit("job-"), k % 25)).otherwise(F.concat(F.lit("test-"), k % 2000))
    return table(spark, d, "orders").select(
        F.concat(F.lit("link-"), k).alias("id"), frm.alias("from_id"), to.alias("to_id"), name.alias("kind"), F.concat(F.lit("w"), k % 3).alias("witness"), F.lit("orders").alias("provenance"),
        (F.col("o_orderstatus") != "O").alias("promoted"), F.lit("orders.csv").alias("source_path"), (k % 5).alias("source_line"))


def _claim_links(spark: SparkSession, d: str) -> DataFrame:
    """Claims linked to code by the number in their key."""
    n = F.substring(norm_key(F.col("claim_id")), -6, 6).cast("long")
    return current_claims(spark, d).select(F.concat(F.lit("fn-"), n % 120).alias("code_id"), "claim_id", F.lit("exact-symbol").alias("kind"))


def _design(spark: SparkSession, d: str) -> GraphCatalog:
    c = GraphCatalog(spark)
    c.put("design-requirement", _requirements(spark, d)).put("code-node", _code(spark, d)).put("ci-job", _jobs(spark, d)).put("traceability-link", _links(spark, d))
    return c.put("code-claim-link", _claim_links(spark, d)).put("claim", current_claims(spark, d).withColumnRenamed("claim_id", "id"))


def _ask(name: str, target: str | None = None) -> Query:
    return lambda spark, d: design.run_design_query(_design(spark, d), name, target)


def design_traceability(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "part").select(F.concat(F.lit("tests/t"), F.col("p_size"), F.lit(".py")).alias("source_path"), F.concat(F.lit("./src/"), F.col("p_size") % 25, F.lit(".py")).alias("module_path"))
    nodes = _code(spark, d).select("id", "label", "source_file").unionByName(_modules(spark, d))
    return design.traceability(_requirements(spark, d), nodes, _tests(spark, d), _jobs(spark, d), used)


def design_communities(spark: SparkSession, d: str) -> DataFrame:
    chosen = current_claims(spark, d).where("load_bearing").select("claim_id")
    return design.dominant_communities(_code(spark, d), _claim_links(spark, d), chosen)


# panels, ballots, runs, positions


def _panel(rule: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Raters as reviewers: r1 and r2 gate, r3 and r4 advise; an objection is a critical finding, an empty label an unreadable report."""
        panel = spark.createDataFrame([("r1", "gating"), ("r2", "gating"), ("r3", "advisory"), ("r4", "advisory")], "reviewer string, role string")
        reports = table(spark, d, "content_labels").select(_text("doc_id").alias("item"), F.col("rater").alias("reviewer"), (F.col("label") != "none").cast("int").alias("critical"))
        return evaluation.panel_verdicts(reports, panel, rule)

    return run


def _arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first and the last text of each claim as two arms."""
    c = table(spark, d, "claims").where("canonical_text is not null").withColumn("k", norm_key(F.col("claim_id"))).groupBy("k").agg(
        F.min(F.struct("ledger_seq", "canonical_text"))["canonical_text"].alias("v1"), F.max(F.struct("ledger_seq", "canonical_text"))["canonical_text"].alias("v2"))
    return tuple(c.select(F.col("k").alias("prompt_id"), F.lit("plain").alias("register"), F.col(v).alias("text"), F.lit(v).alias("arm")) for v in ("v1", "v2"))


def eval_ballots(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ballots(*_arms(spark, d)).select("prompt_id", "order", "length_matched", "a_arm", "a_text", "b_arm", "b_text")


def eval_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as benchmark runs: purchases succeed, values above 50 pass extraction."""
    e = table(spark, d, "events").select(
        F.when(F.col("event_type") == "purchase", "SUCCESS").otherwise(F.upper("event_type")).alias("outcome"), F.when(F.col("value") > 50, _text("ts")).alias("extract_passed"),
        F.concat(F.lit("gap "), F.col("user_id") % 11, F.lit(" ; gap "), F.col("event_id") % 7, F.lit(";")).alias("doc_gaps"))
    return evaluation.run_summary(e).select("part", "name", F.round("value", 6).alias("value"))


def eval_positions(spark: SparkSession, d: str) -> DataFrame:
    """Chapters as rules, the families of sources as schools; refuted and disputed claims contradict."""
    c = current_claims(spark, d)
    stance = F.when(F.col("status") == "verified", "support").when(F.col("status").isin("refuted", "disputed"), "contradict")
    cited = c.select(F.explode(F.array_distinct("supports_chapters")).alias("rule"), stance.alias("stance"), "source_spans").where("stance is not null and rule is not null").select("rule", "stance", F.explode("source_spans.doc_id").alias("s"))
    ev = cited.select(norm_key(F.col("rule")).alias("rule"), norm_key(F.col("s")).alias("doc_id"), "stance").where("doc_id is not null")
    members = graph.current_sources(spark, d).select(F.substring_index("doc_id", "-", 1).alias("school"), "doc_id")
    charter = spark.createDataFrame([("thesis", "ch-01", True), ("style", "ch-01", False)], "school string, rule string, asserts boolean")
    return evaluation.positions(ev, members, charter)


def eval_disputed_questions(spark: SparkSession, d: str) -> DataFrame:
    c = current_claims(spark, d)
    sources = c.select("claim_id", F.col("claim_type").alias("topic"), F.explode_outer("source_spans.doc_id").alias("s")).select("claim_id", "topic", norm_key(F.col("s")).alias("source_id"))
    conflicts = c.select("claim_id", F.explode("conflicts_with").alias("o")).select("claim_id", norm_key(F.col("o")).alias("other_id")).where("other_id is not null")
    return evaluation.disputed_questions(sources, conflicts)


def eval_cohens_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the first two raters."""
    rows = table(spark, d, "content_labels").where("label is not null and rater in ('r1', 'r2')").groupBy("doc_id").agg(F.min(F.when(F.col("rater") == "r1", F.col("label"))).alias("a"), F.min(F.when(F.col("rater") == "r2", F.col("label"))).alias("b"))
    return evaluation.cohens_kappa(rows, "a", "b").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


def eval_factuality_rates(spark: SparkSession, d: str) -> DataFrame:
    r = evaluation.factuality_rates(analysis.eval_factuality(spark, d))
    return r.select("n", F.round("claim_backed_rate", 6).alias("claim_backed_rate"), F.round("span_pass_rate", 6).alias("span_pass_rate"))


def eval_signal_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Change of confidence and posterior from the proposed to the verified records of each claim."""
    c = table(spark, d, "claims").select(norm_key(F.col("claim_id")).alias("prompt"), norm_key(F.col("status")).alias("arm"), "confidence", "p_posterior").distinct()
    scores = c.select("prompt", "arm", F.explode(F.array(F.struct(F.lit("confidence").alias("signal"), F.col("confidence").alias("value")), F.struct(F.lit("p_posterior").alias("signal"), F.col("p_posterior").alias("value")))).alias("s")).select("prompt", "arm", "s.*").where("value is not null")
    return evaluation.signal_deltas(scores, ("proposed", "verified")).select("signal", "n", F.round("mean_delta", 6).alias("mean_delta"))


def eval_floor_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents below 300 characters or three sentences."""
    t = prose.text_counts(spark, d).select("doc_id", F.lit("sentences").alias("signal"), F.col("n_sentences").cast("double").alias("value"))
    n = table(spark, d, "documents").where("n_chars is not null").select("doc_id", F.lit("characters").alias("signal"), F.col("n_chars").cast("double").alias("value"))
    return evaluation.floor_gate(t.unionByName(n), {"sentences": 3, "characters": 300})


# rules

#: Constraints that some subjects fail, of both scopes.
STRICT = """
(defconstraint :few-cases :severity :important :assert (< reported-cases 800))
(defconstraint :small-gains :severity :critical :assert (<= gained 60))
(defconstraint :late-years :severity :minor :scope :corpus :assert (>= year 1950))
(defconstraint :any-cases :severity :minor :assert (>= reported-cases 0))
"""


def _strict(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    facts, constraints = analysis._facts(spark, d), rules.parse_constraints(STRICT)
    checks = rules.check_constraints(facts, constraints)
    return checks, rules.defect_confidence(checks, current_claims(spark, d), weak=0.9, witnesses=rules.constraint_witnesses(facts, constraints))


def rules_opaque(spark: SparkSession, d: str) -> DataFrame:
    g = rules.opaque_gate(analysis._facts(spark, d))
    return g.select("n", F.round("opaque_share", 6).alias("opaque_share"), "passes")


def rules_defects(spark: SparkSession, d: str) -> DataFrame:
    """Failed checks with the least confidence of all their witnesses, one step milder where all stay below 0.9."""
    return _strict(spark, d)[1].select("constraint", "subject", F.round("confidence", 6).alias("confidence"), "severity")


def rules_verdict_confidence(spark: SparkSession, d: str) -> DataFrame:
    return rules.verdict_confidence(_strict(spark, d)[1]).select(F.round("confidence", 6).alias("confidence"))


def rules_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The three vectors nearest to those of the failed checks' witnesses; a claim's vector is that of the number in its key."""
    facts, constraints = analysis._facts(spark, d), rules.parse_constraints(STRICT)
    failed = rules.check_constraints(facts, constraints).where("status = 'unsat' and subject <> '*'").select("constraint", "subject")
    n = F.substring("claim_id", -6, 6).cast("long")
    bear = rules.constraint_witnesses(facts, constraints).join(failed, ["constraint", "subject"], "left_semi").select("constraint", "subject", n.alias("claim_id"))
    vectors = table(spark, d, "embeddings")
    asked = vectors.join(bear.select(F.col("claim_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    return evaluation.defect_neighbours(bear.distinct(), asked, vectors).select("constraint", "subject", "claim_id", "neighbour", F.round("score", 6).alias("score"), "rank")


def rules_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as spells of a customer that must not overlap, read from sentences."""
    said = table(spark, d, "orders").select(
        F.concat(F.lit("order-"), F.col("o_orderkey")).alias("claim_id"),
        F.concat(F.lit("customer "), F.col("o_custkey"), F.lit(" active from "), F.year("o_orderdate"), F.lit(" to "), F.year("o_orderdate") + F.col("o_orderkey") % 2, F.lit(" requires disjoint")).alias("canonical_text"))
    c = GraphCatalog(spark)
    for name, df in ledger.normal_forms(said).items():
        c.put(name, df)
    return argument.interval_inconsistencies(c).select("claim_a", "claim_b", "subject", "required", "start_a", "end_a", "start_b", "end_b", "n_a", "n_b")


# ledger and belief


def ledger_problems(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "claims").select(_text("ledger_seq").alias("claim_id"), "canonical_text", "status", "claim_type", "confidence", "created_at").distinct()
    return ledgers.validate_claims(raw).select(F.col("claim_id").alias("ledger_seq"), "problem")


def ledger_next_ids(spark: SparkSession, d: str) -> DataFrame:
    """Numbers for every pair of source and kind, after those of the claims."""
    new = table(spark, d, "documents").where("source is not null and doc_kind is not null").select("source", "doc_kind").distinct()
    return ledger.next_ids(new, current_claims(spark, d), "claim_id", "clm-2016-")


def ledger_not_ingested(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose hash only withdrawn manifests hold."""
    m = table(spark, d, "source_manifests")
    return ledgers.not_ingested(m.select("sha256").where("sha256 is not null").distinct(), m.where("withdrawn_at is null"))


def belief_top_changes(spark: SparkSession, d: str) -> DataFrame:
    c = current_claims(spark, d)
    after = graph.belief_two_rounds(spark, d)
    return belief.top_changes(c, after).select("claim_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round("delta", 6).alias("delta"))


def kg_spans_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The count aggregate: bindings of claim and span per source."""
    return run_query("(defquery :spans :find [?src (count ?span)] :where [[?s :source-span/id ?span] [?s :source-span/doc-id ?src]])", graph.catalog(spark, d))


# closures


def _derived(spark: SparkSession, d: str) -> DataFrame:
    c = current_claims(spark, d)
    return c.select(F.explode("derived_from").alias("p"), "claim_id").select(norm_key(F.col("p")).alias("src"), F.col("claim_id").alias("dst")).where("src is not null")


def graph_reaches(spark: SparkSession, d: str) -> DataFrame:
    """Claims from which a chain of derivations leads to a definition, and its least length."""
    return graphs.reaches(_derived(spark, d), current_claims(spark, d).where("claim_type = 'definition'").select(F.col("claim_id").alias("id")))


def graph_trails(spark: SparkSession, d: str) -> DataFrame:
    """The shortest way from every claim up to one that derives from nothing."""
    return graphs.shortest_trails(_derived(spark, d), current_claims(spark, d).select(F.col("claim_id").alias("id")))


def graph_circles(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts in rings: edges among nations by the nations of customers and their orders' keys."""
    e = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("src"), F.pmod(F.col("c_nationkey") * 3 + F.col("c_custkey") % 2 * 5, F.lit(23)).cast("long").alias("dst"))
    return graphs.strong_components(e)


def graph_implied_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of the semantic class that claims hold, directly or by what derives from them, and how many others stand against each."""
    c = current_claims(spark, d)
    facts = c.where("status = 'verified'").select(F.col("claim_id").alias("id"), F.col("claim_type").alias("subject"), F.col("semantic_class").alias("value"))
    return graphs.transitive_contradictions(_derived(spark, d).select(F.col("src").alias("claim_id"), F.col("dst").alias("target_id")), facts)


def graph_concept_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Sources that share a name, whatever the case."""
    m = table(spark, d, "source_manifests").select(norm_key(F.col("doc_id")).alias("slug"), F.coalesce("tree_root", "doc_name").alias("form"))
    by_kind = table(spark, d, "source_manifests").select(norm_key(F.col("doc_id")).alias("slug"), F.date_format(F.col("ingested_at").try_cast("timestamp"), "yyyy-MM-dd HH").alias("form"))
    return graphs.concept_clusters(m.unionByName(by_kind))


# gates


def gate_thesis(spark: SparkSession, d: str) -> DataFrame:
    facts = current_claims(spark, d).where("status = 'verified'").select(F.col("claim_type").alias("subject"))
    return consistency.consistency_gate(analysis.thesis_defects(spark, d), facts)


def _contracts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").where("chapter_id is not null").groupBy(F.col("chapter_id").alias("chapter")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("n_chars").cast("double").alias("c"), (F.max("n_chars") > 20000).cast("double").alias("l"))
    metrics = n.select("chapter", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(v).alias("value")) for k, v in (("documents", "n"), ("characters", "c"), ("has_long", "l"))])).alias("m")).select("chapter", "m.*")
    wants = n.select("chapter", F.explode(F.array(*[F.lit(t) for t in ("documents >= 20", "characters < 30000", "has_long == false", "has_long >= true", "unknown == 1", "documents != 21")])).alias("test"))
    return design.evaluate_contract(metrics, wants)


def gate_contracts(spark: SparkSession, d: str) -> DataFrame:
    return _contracts(spark, d)


def gate_preflight(spark: SparkSession, d: str) -> DataFrame:
    c = graph.catalog(spark, d)
    return consistency.preflight(constraint_report(graph.CONSTRAINTS.values(), c), run_query(graph.COMPETENCY["unsupported_claims"][0], c), run_query(graph.COMPETENCY["contradiction_scan"][0], c), _contracts(spark, d))


def gate_remedies(spark: SparkSession, d: str) -> DataFrame:
    named = spark.createDataFrame([("few-cases", "recount"), ("late-years", "redate"), ("late-years", "drop"), ("nothing", "x")], "constraint string, remedy string")
    return consistency.match_remedies(_strict(spark, d)[0], named)


def gate_veto(spark: SparkSession, d: str) -> DataFrame:
    """Triage decisions of claims, approved only if their chapters are among the first ten."""
    chapters = current_claims(spark, d).select(F.col("claim_id").alias("id"), F.explode("supports_chapters").alias("concept"))
    near = table(spark, d, "documents").where("chapter_id <= 'ch-10'").select(F.col("chapter_id").alias("concept"))
    return consistency.veto(analysis.eval_triage(spark, d), chapters, near)


def gate_gaps(spark: SparkSession, d: str) -> DataFrame:
    cov = analysis.eval_coverage(spark, d).select(F.col("chapter").alias("node"), "coverage")
    seeds = current_counter_claims(spark, d).where("status = 'dismissed' and addressed_in_chapter is not null").select(F.col("addressed_in_chapter").alias("node"))
    return consistency.gap_seeds(cov, seeds)


def gate_promotions(spark: SparkSession, d: str) -> DataFrame:
    """Open counter-claims on claims that support a chapter, addressed in the first of them."""
    cc = current_counter_claims(spark, d).select("id", "target_claim_id", "status", "addressed_in_chapter")
    first = current_claims(spark, d).select(F.col("claim_id").alias("target_claim_id"), F.array_min("supports_chapters").alias("chapter")).where("chapter is not null")
    return consistency.promote_addressed(cc, cc.join(first, "target_claim_id").select("id", "chapter"))


def gate_fresh_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots as verdicts on a chapter a month, against the newest document of the month."""
    v = table(spark, d, "claim_snapshots").select(F.date_format("taken_at", "yyyy-MM").alias("chapter"), "snapshot_id", F.unix_micros(F.col("taken_at").cast("timestamp")).alias("at_us")).distinct()
    drafts = table(spark, d, "documents").where("ingested_at is not null").groupBy(F.date_format("ingested_at", "yyyy-MM").alias("chapter")).agg(F.min(F.unix_micros(F.col("ingested_at").cast("timestamp"))).alias("at_us"))
    return consistency.fresh_verdicts(v, drafts)


def gate_weave(spark: SparkSession, d: str) -> DataFrame:
    """Review notes as bridges between the documents of a chapter."""
    p = table(spark, d, "documents").where("chapter_id is not null").select(F.col("chapter_id").alias("group"), "text", (F.col("doc_kind") == "review_note").alias("is_bridge"))
    return composition.weave_gate(p).select("group", F.round("bridge_share", 6).alias("bridge_share"), "passes")


# prose


def style_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by how their deviation stands to a fixed band."""
    s = prose.style_delta(spark, d)
    return s.select("doc_id", style.delta_verdict(F.col("delta"), F.col("words"), 0.55, 0.75).alias("verdict"))


def style_vitality(spark: SparkSession, d: str) -> DataFrame:
    docs = prose._docs(spark, d)
    hedges = lint.phrase_findings(docs, ["hedge"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    j = lint.paragraph_motion(docs).join(lint.burstiness(docs), "doc_id").join(hedges, "doc_id", "left")
    return j.select("doc_id", composition.vitality(1 - F.col("flat_share"), F.col("fano"), F.coalesce("n", F.lit(0))).alias("vitality"))


QUERIES: dict[str, Query] = {
    "design_impact": _ask("impact", "src/7.py"),
    "design_why": _ask("why", "REQ-12"),
    "design_coverage_gaps": _ask("coverage-gaps"),
    "design_stale_docs": _ask("stale-docs"),
    "design_untested": _ask("untested-god-nodes"),
    "design_claim_grounding": _ask("claim-grounding", "src/7.py"),
    "design_ci_gates": _ask("ci-gates", "BUILDING"),
    **{f"eval_panel_{r}": _panel(r) for r in evaluation.PANEL_RULES},
    **{f.__name__: f for f in (
        design_traceability, design_communities, eval_ballots, eval_runs, eval_positions, eval_disputed_questions, eval_cohens_kappa, eval_factuality_rates, eval_signal_deltas, eval_floor_gate,
        rules_opaque, rules_defects, rules_verdict_confidence, rules_neighbours, rules_intervals, ledger_problems, ledger_next_ids, ledger_not_ingested, belief_top_changes, kg_spans_per_source,
        graph_reaches, graph_trails, graph_circles, graph_implied_values, graph_concept_clusters, gate_thesis, gate_contracts, gate_preflight, gate_remedies, gate_veto, gate_gaps, gate_promotions,
        gate_fresh_verdicts, gate_weave, style_verdicts, style_vitality)},
    "style_diction": lambda spark, d: style.diction(prose._docs(spark, d)),
}

_CUR = graph._CUR
_DESIGN = """req AS (SELECT 'req-' || c_custkey AS id, 'REQ-' || c_custkey AS requirement_id, c_mktsegment AS capability, 'must call `fn_' || (c_custkey % 150) || '()` of `src/' || c_nationkey || '.py`' AS text, 'specs/' || c_mktsegment || '.md' AS source_path, c_custkey AS source_line FROM customer),
code AS (SELECT 'fn-' || s_suppkey AS id, 'fn_' || s_suppkey || '()' AS label, 'src/' || s_nationkey || '.py' AS source_file, (s_suppkey % 20) / 20 AS rank, 'group-' || (s_suppkey % 7) AS community FROM supplier),
job AS (SELECT 'job-' || n_nationkey AS id, n_name AS name, 'pytest -q repo/tests/t' || n_nationkey || '.py other.py' AS command, n_nationkey AS k FROM nation),
tst AS (SELECT 'test-' || p_partkey AS id, 'REQ-' || p_partkey * 2 AS target, 'tests/t' || p_size || '.py' AS source_path, p_size FROM part),
lnk AS (SELECT *, left(o_orderpriority, 1) AS p FROM orders),
tl AS (SELECT CASE p WHEN '4' THEN 'test-' || o_orderkey % 2000 WHEN '5' THEN 'job-' || o_orderkey % 25 ELSE 'req-' || o_custkey END AS from_id,
    CASE WHEN p = '1' THEN 'fn-' || o_orderkey % 100 WHEN p = '4' THEN 'fn-' || o_orderkey % 17 * 5 WHEN p = '3' THEN 'job-' || o_orderkey % 25 ELSE 'test-' || o_orderkey % 2000 END AS to_id,
    CASE p WHEN '1' THEN 'requirement-implemented-by' WHEN '2' THEN 'requirement-covered-by' WHEN '3' THEN 'requirement-gated-by' WHEN '4' THEN 'test-exercises-code' ELSE 'workflow-runs-test' END AS kind,
    'w' || o_orderkey % 3 AS witness, 'orders' AS provenance, o_orderstatus <> 'O' AS promoted, 'orders.csv' AS source_path, o_orderkey % 5 AS source_line FROM lnk),
pr AS (SELECT * FROM tl WHERE promoted)"""
_ROW = "kind, from_id, to_id, witness, provenance, source_path, source_line"
_CCL = "ccl AS (SELECT 'fn-' || CAST(right(claim_id, 6) AS BIGINT) % 120 AS code_id, claim_id, 'exact-symbol' AS kind FROM cur)"
_RP = """r AS (SELECT CAST(doc_id AS VARCHAR) AS item, rater, sum(CAST(label <> 'none' AS INTEGER)) AS n, bool_or(label IS NULL) AS unread FROM content_labels GROUP BY 1, 2),
s AS (SELECT item, coalesce(sum(n) FILTER (rater IN ('r1', 'r2')), 0) AS g, coalesce(sum(n) FILTER (rater IN ('r3', 'r4')), 0) AS a, count(*) FILTER (rater IN ('r1', 'r2') AND n > 0) AS cr,
    count(*) FILTER (rater IN ('r1', 'r2') AND NOT unread) AS seen, bool_or(unread OR rater IS NULL OR rater NOT IN ('r1', 'r2', 'r3', 'r4')) AS bad FROM r GROUP BY item)"""
_SOFT = {"any_critical_from_gating": "g > 0", "any_critical": "g + a > 0", "majority_critical": "cr > 0 AND cr * 2 >= 2"}
_DER = "der AS (SELECT DISTINCT lower(trim(x)) AS src, claim_id AS dst FROM (SELECT claim_id, unnest(derived_from) AS x FROM cur) WHERE x IS NOT NULL)"
_CONTRACTS = """mt AS (SELECT chapter_id AS chapter, CAST(count(*) AS DOUBLE) AS n, CAST(sum(n_chars) AS DOUBLE) AS c, CAST(max(n_chars) > 20000 AS DOUBLE) AS l FROM documents WHERE chapter_id IS NOT NULL GROUP BY 1),
ct AS (SELECT chapter, 'documents >= 20' AS test, n AS value, n >= 20 AS passes FROM mt UNION ALL SELECT chapter, 'characters < 30000', c, coalesce(c < 30000, true) FROM mt UNION ALL SELECT chapter, 'has_long == false', l, coalesce(l = 0, true) FROM mt
    UNION ALL SELECT chapter, 'has_long >= true', l, l IS NULL FROM mt UNION ALL SELECT chapter, 'unknown == 1', NULL, true FROM mt UNION ALL SELECT chapter, 'documents != 21', n, n <> 21 FROM mt)"""
_CHECKED = f"""{analysis._CUR}, {analysis._FACTS}, un AS (SELECT 'few-cases' AS c, 'important' AS sv, 'reported-cases' AS p, subject FROM facts WHERE predicate = 'reported-cases' GROUP BY subject HAVING max(value_num) >= 800
    UNION ALL SELECT 'small-gains', 'critical', 'gained', subject FROM facts WHERE predicate = 'gained' GROUP BY subject HAVING max(value_num) > 60 UNION ALL SELECT 'late-years', 'minor', 'year', '*' FROM facts WHERE predicate = 'year' HAVING min(value_num) < 1950),
wt AS (SELECT c, un.subject, sv, claim_id, coalesce(cur.confidence, 1.0) AS f FROM un JOIN facts ON predicate = p AND (un.subject = '*' OR facts.subject IS NOT DISTINCT FROM un.subject) JOIN cur USING (claim_id)),
df AS (SELECT c AS "constraint", subject, min(f) AS confidence, CASE WHEN max(f) < 0.9 THEN CASE sv WHEN 'critical' THEN 'important' WHEN 'important' THEN 'minor' ELSE sv END ELSE sv END AS severity FROM wt GROUP BY c, subject, sv)"""
_TH = analysis.SQL["thesis_defects"]
SQL: dict[str, str] = {
    "design_impact": f"WITH {_DESIGN}, t AS (SELECT id FROM code WHERE source_file LIKE '%src/7.py') SELECT DISTINCT {_ROW} FROM pr WHERE from_id IN (SELECT id FROM t) OR to_id IN (SELECT id FROM t)",
    "design_why": f"WITH {_DESIGN} SELECT 'requirement' AS kind, id AS from_id, NULL AS to_id, text AS witness, capability AS provenance, source_path, source_line FROM req WHERE requirement_id = 'REQ-12' UNION ALL SELECT DISTINCT {_ROW} FROM pr WHERE from_id = 'req-12'",
    "design_coverage_gaps": f"""WITH {_DESIGN}, k AS (SELECT unnest(['requirement-implemented-by', 'requirement-covered-by', 'requirement-gated-by']) AS kind, unnest([1, 2, 3]) AS o),
        m AS (SELECT req.id, kind, o FROM req CROSS JOIN k WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.from_id = req.id AND pr.kind = k.kind)) SELECT requirement_id, capability, string_agg(kind, ',' ORDER BY o) AS missing, source_path, source_line FROM m JOIN req USING (id) GROUP BY ALL""",
    "design_stale_docs": f"WITH {_DESIGN} SELECT {_ROW} FROM tl WHERE NOT promoted AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.kind = tl.kind AND pr.from_id = tl.from_id AND pr.to_id = tl.to_id)",
    "design_untested": f"WITH {_DESIGN} SELECT id, label, source_file, rank FROM code WHERE rank >= 0.9 AND id NOT IN (SELECT to_id FROM pr WHERE kind = 'test-exercises-code')",
    "design_claim_grounding": f"""WITH {_CUR}, {_DESIGN}, {_CCL} SELECT code_id, label AS code_label, claim_id, status AS claim_status, canonical_text AS claim_text, kind, source_file FROM ccl JOIN code ON code.id = code_id JOIN cur USING (claim_id) WHERE source_file LIKE '%src/7.py'""",
    "design_ci_gates": f"""WITH {_DESIGN} SELECT requirement_id, capability, to_id AS ci_job_id, job.name AS job, true AS required, '*' AS selector, command, pr.source_path, pr.source_line FROM pr JOIN req ON req.id = from_id LEFT JOIN job ON job.id = to_id
        WHERE kind = 'requirement-gated-by' AND (capability = 'BUILDING' OR contains(req.source_path, 'BUILDING'))""",
    "design_traceability": f"""WITH {_DESIGN}, nd AS (SELECT DISTINCT 'mod-' || s_nationkey AS id, 'src/' || s_nationkey || '.py' AS f FROM supplier)
        SELECT req.id AS from_id, code.id AS to_id, 'requirement-implemented-by' AS kind, left(label, length(label) - 2) AS witness, true AS promoted FROM req JOIN code ON label = 'fn_' || (source_line % 150) || '()'
        UNION ALL SELECT req.id, nd.id, 'requirement-implemented-by', f, true FROM req JOIN customer ON c_custkey = source_line JOIN nd ON f = 'src/' || c_nationkey || '.py'
        UNION ALL SELECT req.id, tst.id, 'requirement-covered-by', target, true FROM tst JOIN req ON requirement_id = target UNION ALL SELECT job.id, tst.id, 'workflow-runs-test', source_path, true FROM job JOIN tst ON p_size = k
        UNION ALL SELECT DISTINCT req.id, job.id, 'requirement-gated-by', tst.source_path, true FROM job JOIN tst ON p_size = k JOIN req ON requirement_id = target UNION ALL SELECT tst.id, nd.id, 'test-exercises-code', f, true FROM tst JOIN nd ON f = 'src/' || (p_size % 25) || '.py'""",
    "design_communities": f"""WITH {_CUR}, {_DESIGN}, {_CCL}, x AS (SELECT DISTINCT community, claim_id FROM ccl JOIN code ON code.id = code_id JOIN cur USING (claim_id) WHERE load_bearing),
        y AS (SELECT community, count(*) AS n_claims, min(claim_id) AS first_claim FROM x GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY n_claims DESC, community) AS INTEGER) AS rank, * FROM y""",
    **{f"eval_panel_{k}": f"WITH {_RP} SELECT item, CASE WHEN seen < 2 OR bad THEN 'hard-gate-fail' WHEN {v} THEN 'soft-gate-fail' ELSE 'pass' END AS verdict, CAST(g AS BIGINT) AS gating_criticals, CAST(a AS BIGINT) AS advisory_criticals, cr AS critical_reviewers FROM s" for k, v in _SOFT.items()},
    "eval_ballots": r"""WITH c AS (SELECT lower(trim(claim_id)) AS k, arg_min(canonical_text, (ledger_seq, canonical_text)) AS v1, arg_max(canonical_text, (ledger_seq, canonical_text)) AS v2 FROM claims WHERE canonical_text IS NOT NULL GROUP BY 1),
        n AS (SELECT *, len(regexp_extract_all(v1, '\S+')) AS a, len(regexp_extract_all(v2, '\S+')) AS b FROM c), m AS (SELECT *, a > 0 AND b > 0 AND abs(a - b) <= greatest(a, b) * 0.15 AS ok FROM n)
        SELECT k AS prompt_id, 0 AS "order", ok AS length_matched, 'v1' AS a_arm, v1 AS a_text, 'v2' AS b_arm, v2 AS b_text FROM m UNION ALL SELECT k, 1, ok, 'v2', v2, 'v1', v1 FROM m""",
    "eval_runs": """WITH e AS (SELECT CASE event_type WHEN 'purchase' THEN 'SUCCESS' ELSE upper(event_type) END AS o, value > 50 AS x, ['gap ' || user_id % 11, 'gap ' || event_id % 7] AS g FROM events),
        gp AS (SELECT unnest(g) AS name FROM e), a AS (SELECT name, count(*) AS n FROM gp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5), f AS (SELECT o AS name, count(*) AS n FROM e WHERE o <> 'SUCCESS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
        SELECT 'summary' AS part, 'total' AS name, CAST(count(*) AS DOUBLE) AS value FROM e UNION ALL SELECT 'summary', 'reach_extract', round(count(*) FILTER (x) / count(*), 6) FROM e UNION ALL SELECT 'summary', 'reach_ci', round(count(*) FILTER (o = 'SUCCESS') / count(*), 6) FROM e
        UNION ALL SELECT 'doc gap', name, n FROM a UNION ALL SELECT 'failure', name, n FROM f""",
    "eval_positions": f"""WITH {_CUR}, ev AS (SELECT DISTINCT lower(trim(rule)) AS rule, lower(trim(s.doc_id)) AS doc_id, CASE WHEN status = 'verified' THEN 1 ELSE 0 END AS st FROM (SELECT unnest(supports_chapters) AS rule, status, source_spans FROM cur WHERE status IN ('verified', 'refuted', 'disputed')) t, unnest(t.source_spans) u(s) WHERE rule IS NOT NULL AND s.doc_id IS NOT NULL),
        mb AS (SELECT DISTINCT split_part(doc_id, '-', 1) AS school, doc_id FROM src), p AS (SELECT rule, school, sum(st) AS s, sum(1 - st) AS c FROM ev JOIN mb USING (doc_id) GROUP BY 1, 2),
        j AS (SELECT rule, school, CAST(coalesce(s, 0) AS BIGINT) AS s, CAST(coalesce(c, 0) AS BIGINT) AS c, CASE WHEN rule = 'ch-01' AND school = 'thesis' THEN true WHEN rule = 'ch-01' AND school = 'style' THEN false END AS d FROM (SELECT DISTINCT rule FROM ev) CROSS JOIN (SELECT DISTINCT school FROM mb) LEFT JOIN p USING (rule, school))
        SELECT rule, school, CASE WHEN d THEN 'supports' WHEN NOT d THEN 'contradicts' WHEN s >= 2 AND c = 0 THEN 'supports' WHEN s = 0 AND c >= 1 THEN 'contradicts' WHEN s > 0 AND c = 0 THEN 'extends' ELSE 'silent' END AS stance, s AS n_support, c AS n_contra, d IS NOT NULL AS declared FROM j""",
    "eval_disputed_questions": f"""WITH {_CUR}, k AS (SELECT DISTINCT least(claim_id, o) AS a, greatest(claim_id, o) AS b FROM (SELECT claim_id, lower(trim(x)) AS o FROM (SELECT claim_id, unnest(conflicts_with) AS x FROM cur) WHERE x IS NOT NULL) WHERE claim_id <> o),
        q AS (SELECT x.claim_type AS topic, a, b FROM k JOIN cur x ON x.claim_id = a JOIN cur y ON y.claim_id = b AND x.claim_type = y.claim_type), z AS (SELECT topic, a || ' against ' || b AS question, a AS claim_id, 'asserts' AS stance FROM q UNION ALL SELECT topic, a || ' against ' || b, b, 'denies' FROM q),
        so AS (SELECT DISTINCT claim_id, lower(trim(s.doc_id)) AS source_id FROM (SELECT claim_id, unnest(CASE WHEN len(source_spans) > 0 THEN source_spans ELSE [NULL] END) AS s FROM cur)) SELECT z.*, source_id FROM z JOIN so USING (claim_id)""",
    "eval_cohens_kappa": """WITH p AS (SELECT doc_id, min(label) FILTER (rater = 'r1') AS a, min(label) FILTER (rater = 'r2') AS b FROM content_labels WHERE label IS NOT NULL GROUP BY 1), k AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
        e AS (SELECT sum(x.n * y.n) AS q FROM (SELECT a AS c, count(*) AS n FROM k GROUP BY 1) x JOIN (SELECT b AS c, count(*) AS n FROM k GROUP BY 1) y USING (c)), s AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS g FROM k)
        SELECT n, round(g, 6) AS agreement, round(CASE WHEN q = n * n THEN 1.0 ELSE (g - q / (n * n)) / (1 - q / (n * n)) END, 6) AS kappa FROM s, e""",
    "eval_factuality_rates": f"""WITH f AS ({analysis.SQL['eval_factuality']}) SELECT CAST(sum(n) AS BIGINT) AS n, round(coalesce(sum(n) FILTER (part <> 'novel'), 0) / sum(n), 6) AS claim_backed_rate, round(coalesce(sum(n) FILTER (part IN ('disputed', 'verified')), 0) / sum(n), 6) AS span_pass_rate FROM f""",
    "eval_signal_deltas": """WITH c AS (SELECT DISTINCT lower(trim(claim_id)) AS p, lower(trim(status)) AS a, confidence, p_posterior FROM claims), u AS (SELECT p, a, 'confidence' AS signal, confidence AS v FROM c UNION ALL SELECT p, a, 'p_posterior', p_posterior FROM c),
        g AS (SELECT p, signal, avg(v) FILTER (a = 'proposed') AS x, avg(v) FILTER (a = 'verified') AS y FROM u WHERE v IS NOT NULL GROUP BY 1, 2) SELECT signal, count(*) AS n, round(avg(y - x), 6) AS mean_delta FROM g WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1""",
    "eval_floor_gate": f"""WITH {prose._S} SELECT doc_id, 'sentences' AS signal, CAST(len(s) AS DOUBLE) AS value, 3.0::DOUBLE AS floor FROM s WHERE len(s) < 3 UNION ALL SELECT doc_id, 'characters', CAST(n_chars AS DOUBLE), 300.0::DOUBLE FROM documents WHERE n_chars < 300""",
    "rules_opaque": f"WITH {analysis._CUR}, {analysis._FACTS} SELECT count(*) AS n, round(count(*) FILTER (predicate = 'OPAQUE') / count(*), 6) AS opaque_share, count(*) FILTER (predicate = 'OPAQUE') / count(*) <= 0.5 AS passes FROM facts",
    "rules_defects": f"WITH {_CHECKED} SELECT \"constraint\", subject, round(confidence, 6) AS confidence, severity FROM df",
    "rules_verdict_confidence": f"WITH {_CHECKED} SELECT round(CASE WHEN count(*) = 0 THEN 1.0 WHEN min(confidence) <= 0 THEN 0.0 ELSE exp(avg(ln(confidence))) END, 6) AS confidence FROM df",
    "rules_intervals": """WITH o AS (SELECT 'order-' || o_orderkey AS c, 'customer ' || o_custkey AS subject, year(o_orderdate) AS s, year(o_orderdate) + o_orderkey % 2 AS e FROM orders), k AS (SELECT subject, s, e, min(c) AS c, count(*) AS n FROM o GROUP BY 1, 2, 3)
        SELECT a.c AS claim_a, b.c AS claim_b, a.subject, 'disjoint' AS required, a.s AS start_a, a.e AS end_a, b.s AS start_b, b.e AS end_b, a.n AS n_a, b.n AS n_b FROM k a JOIN k b ON a.subject = b.subject AND a.c < b.c WHERE NOT (a.e < b.s OR b.e < a.s)""",
    "ledger_problems": """WITH r AS (SELECT DISTINCT CAST(ledger_seq AS VARCHAR) AS ledger_seq, canonical_text, status, claim_type, confidence, created_at FROM claims)
        SELECT ledger_seq, 'canonical_text is missing' AS problem FROM r WHERE canonical_text IS NULL UNION ALL SELECT ledger_seq, 'status is missing' FROM r WHERE status IS NULL UNION ALL SELECT ledger_seq, 'claim_type is missing' FROM r WHERE claim_type IS NULL
        UNION ALL SELECT ledger_seq, 'confidence is missing' FROM r WHERE confidence IS NULL UNION ALL SELECT ledger_seq, 'created_at is missing' FROM r WHERE created_at IS NULL
        UNION ALL SELECT ledger_seq, 'unknown status' FROM r WHERE lower(trim(status)) NOT IN ('proposed', 'verified', 'disputed', 'superseded', 'refuted')
        UNION ALL SELECT ledger_seq, 'unknown claim_type' FROM r WHERE claim_type NOT IN ('fact', 'definition', 'design_decision', 'method', 'result', 'open_question') UNION ALL SELECT ledger_seq, 'confidence outside [0, 1]' FROM r WHERE NOT confidence BETWEEN 0 AND 1""",
    "ledger_next_ids": f"""WITH {_CUR}, n AS (SELECT DISTINCT source, doc_kind FROM documents WHERE source IS NOT NULL AND doc_kind IS NOT NULL), t AS (SELECT max(TRY_CAST(regexp_extract(claim_id, '^clm-2016-(\\d+)$', 1) AS BIGINT)) AS t FROM cur)
        SELECT 'clm-2016-' || lpad(CAST(row_number() OVER (ORDER BY source, doc_kind) + t AS VARCHAR), 6, '0') AS new_id, source, doc_kind FROM n, t""",
    "ledger_not_ingested": "SELECT DISTINCT sha256 FROM source_manifests WHERE sha256 IS NOT NULL AND sha256 NOT IN (SELECT sha256 FROM source_manifests WHERE withdrawn_at IS NULL AND sha256 IS NOT NULL)",
    "belief_top_changes": f"""WITH {_CUR}, {graph._LOCAL}, r1 AS {graph._round('loc', 'prior')}, r2 AS {graph._round('r1', 'p')}, d AS (SELECT claim_id, coalesce(p_posterior, 0) AS b, round(p, 6) AS a FROM r2 JOIN cur USING (claim_id))
        SELECT claim_id, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS delta FROM d ORDER BY abs(a - b) DESC, claim_id LIMIT 20""",
    "kg_spans_per_source": f"WITH {_CUR} SELECT doc_id AS src, count(*) AS count_span FROM spans GROUP BY 1",
    "graph_reaches": f"""WITH RECURSIVE {_CUR}, {_DER}, w AS (SELECT src AS id, 1 AS steps FROM der WHERE dst IN (SELECT claim_id FROM cur WHERE claim_type = 'definition') UNION SELECT src, steps + 1 FROM w JOIN der ON dst = id WHERE steps < 60)
        SELECT id, min(steps) AS steps FROM w GROUP BY id""",
    "graph_trails": f"""WITH RECURSIVE {_CUR}, {_DER}, w AS (SELECT claim_id AS id, claim_id AS pt, claim_id AS trail, 0 AS steps FROM cur UNION ALL SELECT w.id, src, trail || ' < ' || src, steps + 1 FROM w JOIN der ON dst = pt WHERE NOT contains(trail, src)),
        e AS (SELECT * FROM w WHERE pt NOT IN (SELECT dst FROM der)) SELECT id, arg_min(trail, (steps, trail)) AS trail, min(steps) AS steps FROM e GROUP BY id""",
    "graph_circles": """WITH RECURSIVE e AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS s, CAST((c_nationkey * 3 + c_custkey % 2 * 5) % 23 AS BIGINT) AS d FROM customer), w AS (SELECT s AS a, d AS b FROM e UNION SELECT a, d FROM w JOIN e ON s = b)
        SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM w x JOIN w y ON y.a = x.b AND y.b = x.a GROUP BY x.a""",
    "graph_implied_values": f"""WITH RECURSIVE {_CUR}, {_DER}, f AS (SELECT claim_id AS id, claim_type AS s, semantic_class AS v FROM cur WHERE status = 'verified' AND claim_type IS NOT NULL AND semantic_class IS NOT NULL), h AS (SELECT id AS a, s, v FROM f UNION SELECT src, s, v FROM h JOIN der ON dst = a)
        SELECT a, s AS subject, v AS value, n - 1 AS against FROM h JOIN (SELECT s, count(DISTINCT v) AS n FROM f GROUP BY 1) USING (s) WHERE n > 1""",
    "graph_concept_clusters": """WITH RECURSIVE m AS (SELECT lower(trim(doc_id)) AS slug, lower(trim(coalesce(tree_root, doc_name))) AS form FROM source_manifests WHERE doc_id IS NOT NULL UNION SELECT lower(trim(doc_id)), strftime(TRY_CAST(ingested_at AS TIMESTAMP), '%Y-%m-%d %H') FROM source_manifests WHERE doc_id IS NOT NULL),
        f AS (SELECT DISTINCT slug, form FROM m WHERE form IS NOT NULL), e AS (SELECT DISTINCT f.slug AS a, g.slug AS b FROM f JOIN f g USING (form)), r AS (SELECT a AS id, a AS pt FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.pt), c AS (SELECT id, min(pt) AS cluster FROM r GROUP BY id)
        SELECT cluster, id AS slug, count(*) OVER (PARTITION BY cluster) AS size FROM c QUALIFY count(*) OVER (PARTITION BY cluster) > 1""",
    "gate_thesis": f"""WITH t AS ({_TH}), n AS (SELECT count(*) FILTER (kind IN ('contradiction', 'implied-contradiction', 'declared-conflict')) AS a, count(*) FILTER (kind IN ('invariant', 'unreachable', 'no-chapter')) AS b, count(*) FILTER (kind = 'missing-evidence') AS c FROM t)
        SELECT a AS n_contradictions, b AS n_invariants, c AS n_missing, a > 0 OR b > 0 OR c > 0 AS failed FROM n""",
    "gate_contracts": f"WITH {_CONTRACTS} SELECT * FROM ct",
    "gate_preflight": f"""WITH {_CUR}, {graph._VIOLATIONS}, {_CONTRACTS}, x AS (SELECT (SELECT count(*) FROM viol) AS a, (SELECT count(*) FROM ({graph._KG['unsupported_claims']})) AS b, (SELECT count(*) FROM ({graph._KG['contradiction_scan']})) AS c, (SELECT count(*) FROM ct WHERE NOT passes) AS d)
        SELECT a AS n_violations, b AS n_unsupported, c AS n_contradictions, d AS n_failed_contracts, a + b + c + d = 0 AS ready FROM x""",
    "gate_remedies": f"""WITH {_CHECKED} SELECT DISTINCT c AS "constraint", subject, remedy FROM un JOIN (VALUES ('few-cases', 'recount'), ('late-years', 'redate'), ('late-years', 'drop')) r(k, remedy) ON k = c""",
    "rules_neighbours": f"""WITH {_CHECKED}, e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), l AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM e),
        b AS (SELECT DISTINCT c AS "constraint", subject, CAST(right(wt.claim_id, 6) AS BIGINT) AS claim_id FROM wt WHERE subject <> '*'), s AS (SELECT q.vec_id AS q, i.vec_id AS i, round(list_dot_product(q.v, i.v) / (q.l * i.l), 12) AS score FROM l q JOIN l i ON q.vec_id <> i.vec_id WHERE q.vec_id IN (SELECT claim_id FROM b)),
        t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, i) AS rank FROM s QUALIFY rank <= 3) SELECT "constraint", subject, claim_id, i AS neighbour, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM b JOIN t ON q = claim_id""",
    "gate_veto": f"""WITH t AS ({analysis.SQL['eval_triage']}), c AS (SELECT claim_id, unnest(supports_chapters) AS ch FROM (SELECT *, lower(trim(claim_id)) AS k FROM claims QUALIFY row_number() OVER (PARTITION BY lower(trim(claim_id)) ORDER BY ledger_seq DESC) = 1)),
        k AS (SELECT lower(trim(claim_id)) AS id, bool_or(ch IN (SELECT chapter_id FROM documents WHERE chapter_id <= 'ch-10')) AS ok FROM c GROUP BY 1) SELECT id, CASE WHEN decision = 'auto' AND k.id IS NOT NULL AND NOT ok THEN 'manual' ELSE decision END AS decision FROM t LEFT JOIN k USING (id)""",
    "gate_gaps": f"""WITH c AS ({analysis.SQL['eval_coverage']}), {analysis._CC} SELECT DISTINCT chapter AS node FROM c WHERE coverage < 1 AND chapter NOT IN (SELECT addressed_in_chapter FROM cc WHERE status = 'dismissed' AND addressed_in_chapter IS NOT NULL)""",
    "gate_promotions": f"""WITH {_CUR}, c AS (SELECT claim_id, list_min(list_filter(supports_chapters, lambda x: x IS NOT NULL)) AS ch FROM cur) SELECT id, target AS target_claim_id, 'addressed' AS status, ch AS addressed_in_chapter FROM cc JOIN c ON claim_id = target WHERE status = 'open' AND ch IS NOT NULL""",
    "gate_fresh_verdicts": """WITH v AS (SELECT DISTINCT strftime(taken_at, '%Y-%m') AS chapter, snapshot_id, epoch_us(taken_at) AS at_us FROM claim_snapshots), g AS (SELECT strftime(ingested_at, '%Y-%m') AS chapter, min(epoch_us(ingested_at)) AS w FROM documents WHERE ingested_at IS NOT NULL GROUP BY 1)
        SELECT v.* FROM v JOIN g USING (chapter) WHERE at_us >= w""",
    "gate_weave": """WITH g AS (SELECT chapter_id AS "group", coalesce(sum(length(text)) FILTER (doc_kind = 'review_note'), 0) AS b, coalesce(sum(length(text)), 0) AS n FROM documents WHERE chapter_id IS NOT NULL GROUP BY 1)
        SELECT "group", round(coalesce(b / nullif(n, 0), 0), 6) AS bridge_share, coalesce(b / nullif(n, 0), 0) <= 0.35 AS passes FROM g""",
    "style_verdicts": f"""WITH s AS ({prose.SQL['style_delta']}) SELECT doc_id, CASE WHEN words < {style.LEAST_WORDS} THEN 'abstain' WHEN delta <= 0.75 THEN 'in-band' WHEN delta <= 0.75::DOUBLE + (0.75::DOUBLE - 0.55::DOUBLE) THEN 'near' ELSE 'out' END AS verdict FROM s""",
    "style_vitality": f"""WITH m AS ({prose.SQL['lint_paragraph_motion']}), b AS ({prose.SQL['lint_burstiness']}), h AS (SELECT doc_id, count(*) AS n FROM ({prose.SQL['lint_hedges']}) GROUP BY 1)
        SELECT doc_id, round((1 - flat_share) * 0.4 + least(fano / 0.7, 1.0) * 0.3 + greatest(0.0, 1 - coalesce(n, 0) / 10) * 0.3, 3) AS vitality FROM m JOIN b USING (doc_id) LEFT JOIN h USING (doc_id)""",
}
