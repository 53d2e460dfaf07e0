"""Ledger, belief, argumentation, graphs, evaluation, retrieval and induction on hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import argument, belief, design, evaluation, graphs, induction, ledger, ordered, retrieval
from marlstone.plans.catalog import GraphCatalog
from marlstone.plans.edn import read_edn


def rows(df, *cols):
    return {tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()}


# ledger


def test_latest_and_ids(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, None), ("b", None, "y"), (None, 5, "z")], "k string, n int, v string")
    assert rows(ledger.latest_per(df, "k", "n")) == {("a", 2, None), ("b", None, "y")}
    new = spark.createDataFrame([("q",), ("p",)], "v string")
    assert rows(ledger.next_ids(new, spark.createDataFrame([("clm-000007",), ("clm-x",), ("other-9",)], "id string"), "id", "clm-")) == {("clm-000008", "p"), ("clm-000009", "q")}
    assert rows(ledger.next_ids(new.limit(0), spark.createDataFrame([], "id string"), "id", "clm-")) == set()


def test_transitions(spark):
    df = spark.createDataFrame([("a", 1, "proposed"), ("a", 2, "verified"), ("a", 3, "verified"), ("a", 4, "refuted")], "k string, n int, s string")
    t = ledger.check_transitions(ledger.transitions(df, "k", "s", "n"), "from_status", "to_status")
    assert rows(t, "from_status", "to_status", "n", "is_allowed") == {("proposed", "verified", 1, True), ("verified", "refuted", 1, False)}
    odd = spark.createDataFrame([(None, "verified"), ("pending", "waived")], "f string, t string")
    assert rows(ledger.check_transitions(odd, "f", "t", ledger.OBLIGATION_TRANSITIONS), "t", "is_allowed") == {("verified", False), ("waived", True)}


def test_supersession(spark):
    df = spark.createDataFrame([("a", "verified", "b"), ("b", "superseded", None), ("c", "verified", "zz"), ("d", "x", "e"), ("e", "x", "d"), ("f", "x", "d"), ("g", "verified", "a"), ("h", "x", "")], "claim_id string, status string, supersedes string")
    assert rows(ledger.supersession_alerts(df), "claim_id", "kind") == {("c", "missing-target"), ("d", "cycle"), ("e", "cycle"), ("f", "cycle"), ("g", "target-still-current")}


CLAIMS = "claim_id string, status string, semantic_class string, canonical_text string, source_spans array<struct<doc_id: string>>, supports_chapters array<string>"


def test_claim_filters(spark):
    df = spark.createDataFrame([("1", "verified", "causal", "The Ledger", [("d1",), ("d2",)], ["ch-1"]), ("2", "refuted", "causal", "ledger", [], ["ch-1"]), ("3", "disputed", "norm", None, None, ["ch-1"]), ("4", "superseded", "norm", "x", [("d2",)], ["ch-1", "ch-2"])], CLAIMS)
    ids = lambda x: {r["claim_id"] for r in x.collect()}
    assert ids(ledger.query_claims(df)) == {"1", "3", "4"} and ids(ledger.query_claims(df, sources=["d2"])) == {"4"} and ids(ledger.query_claims(df, topics=["LEDGER", "q"])) == {"1"} and ids(ledger.query_claims(df, ["verified"], tags=["norm"])) == set()
    assert ids(ledger.chapter_slice(df, "ch-1")) == {"1"} and ids(ledger.chapter_slice(df, "ch-1", ["3"], ["2"])) == {"1", "2", "3"}


def test_antonym_conflicts(spark):
    said = [("1", "verified", "Smoking allowed here"), ("2", "verified", "smoking forbidden indoors"), ("3", "verified", "smoking forbidden there"), ("4", "proposed", "smoking forbidden"), ("5", "verified", "it is forbidden"), ("6", "verified", "Visits allowed or forbidden")]
    df = spark.createDataFrame([(i, st, "", t, None, None) for i, st, t in said], CLAIMS)
    # claim 6 holds both halves but no other claim shares its words
    got = rows(ledger.antonym_conflicts(df), "pair", "word", "claim_a", "claim_b", "n_a", "n_b")
    assert ("allowed/forbidden", "smoking", "1", "2", 1, 2) in got and not any(r[1] == "visits" for r in got)
    assert ("allowed/forbidden", "allowed", "1", "6", 2, 1) in got and ("allowed/forbidden", "forbidden", "6", "2", 1, 4) in got
    assert rows(ledger.antonym_members(df).where("word = 'smoking'"), "side", "claim_id") == {("first", "1"), ("second", "2"), ("second", "3")}


def test_normal_forms(spark):
    df = spark.createDataFrame([("1", "The hull length is 2 km."), ("2", "mast height was 3.5 metres from 1990 to 1999 requires overlap"), ("3", "dock active from 2001 to 2005 requires disjoint"), ("4", "dock active from 2009 to 2005 requires disjoint"), ("5", None)], "claim_id string, canonical_text string")
    n = ledger.normal_forms(df)
    assert rows(n["claim-quantity"], "claim_id", "canonical_value", "canonical_unit") == {("1", 2000.0, "m"), ("2", 3.5, "m")}
    assert rows(n["claim-time-interval"], "claim_id", "start", "end", "required_relation") == {("2", 1990, 1999, "overlap"), ("3", 2001, 2005, "disjoint")}
    assert rows(n["claim-normal-form"], "claim_id", "subject", "object") == {("1", "the hull", "2000 m"), ("2", "mast", "3.5 m"), ("3", "dock", "2001-2005")}


@pytest.mark.parametrize("seed", range(4))
def test_ordered_operators_match_plain_ones(spark, seed):
    rng = random.Random(seed)
    data = sorted({(rng.choice("gh"), rng.randrange(-40, 200)) for _ in range(60)})
    df = spark.createDataFrame([(g, s, s + rng.randrange(0, 30), str(i)) for i, (g, s) in enumerate(data)], "g string, s int, e int, v string")
    plain = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))
    want = {r[3]: (plain[i - 1][3] if i and plain[i - 1][0] == r[0] else None) for i, r in enumerate(plain)}
    got = ordered.lag_in_buckets(df, "g", "s", ["v"], 7)
    assert {r["v"]: r["before"] and r["before"]["v"] for r in got.collect()} == want
    clusters = []
    for g, s, e, _ in plain:
        if clusters and clusters[-1][0] == g and s - clusters[-1][2] <= 3:
            clusters[-1][2] = max(clusters[-1][2], e)
            clusters[-1][3] += 1
        else:
            clusters.append([g, s, e, 1])
    assert rows(ordered.gap_clusters(df, "g", "s", "e", 3, 10)) == {tuple(c) for c in clusters}
    assert ordered.gap_clusters(df.limit(0), "g", "s", "e", 3, 10).count() == 0


# belief


def plain_belief(claims, spans, trust, counters, edges):
    prior = {c: p if p is not None else ledger.PRIOR_BY_STATUS[s] for c, s, p in claims}
    local = {}
    for c in prior:
        fail, cited = 1.0, [d for k, d in spans if k == c and d is not None]
        for d in cited:
            fail *= 1 - prior[c] * trust.get(d, 1.0)
        e = 1 - fail if cited else prior[c]
        for t, s in counters:
            if t == c:
                e *= {"open": 0.95, "addressed": 0.85}.get(s, 1.0)
        local[c] = e
    p = dict(prior)
    for _ in range(20):
        new = {c: max(0.05, min(0.95, local[c] * min([p.get(a, 1.0) for a, b in edges if b == c], default=1.0))) for c in p}
        moved = max(abs(new[c] - p[c]) for c in p)
        p = new
        if moved < 1e-4:
            break
    return p


def test_belief_matches_a_plain_loop(spark):
    rng = random.Random(2)
    names = [f"c{i}" for i in range(25)]
    claims = [(c, rng.choice(list(ledger.PRIOR_BY_STATUS)), rng.choice([None, round(rng.random(), 2)])) for c in names]
    spans = [(rng.choice(names), rng.choice(["d1", "d2", "d3", None])) for _ in range(40)]
    trust = {"d1": 0.4, "d2": 0.9}
    counters = [(rng.choice(names), rng.choice(["open", "addressed", "dismissed"])) for _ in range(20)]
    edges = list({(rng.choice(names + ["gone"]), rng.choice(names)) for _ in range(30)})
    local = belief.local_evidence(
        spark.createDataFrame(claims, "claim_id string, status string, p_prior double"), spark.createDataFrame(spans, "claim_id string, doc_id string"),
        spark.createDataFrame(list(trust.items()), "doc_id string, trust double"), spark.createDataFrame(counters, "target_claim_id string, status string"))
    out = belief.propagate(local, spark.createDataFrame(edges, "parent string, claim_id string"))
    got = {r["claim_id"]: r["posterior"] for r in out.collect()}
    want = plain_belief(claims, spans, trust, counters, edges)
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-9) and 0.05 <= got[c] <= 0.95 for c in want)


def test_effective_confidence_gives_reasons(spark):
    day = 86_400_000_000
    claims = spark.createDataFrame([("a", "verified", None, 0), ("b", "verified", None, 0), ("c", "verified", 0.9, 0)], "claim_id string, status string, p_prior double, created_us long")
    edges = spark.createDataFrame([("a", "b")], "parent string, claim_id string")
    spans = spark.createDataFrame([("a", "old"), ("c", "new")], "claim_id string, doc_id string")
    counters = spark.createDataFrame([("cc1", "a", "open"), ("cc2", "a", "dismissed")], "id string, target_claim_id string, status string")
    conflicts = spark.createDataFrame([("c", "a")], "claim_id string, other_id string")
    sources = spark.createDataFrame([("old", 1.0, 0), ("new", 1.0, 360 * day)], "doc_id string, trust double, ingested_us long")
    out = {r["claim_id"]: r for r in belief.effective_confidence(claims, edges, spans, counters, conflicts, sources, 365 * day).collect()}
    assert out["a"]["reasons"] == ["counter-claim:open:cc1", "refreshed-source-conflict:new:c", "stale-source:old"] and out["a"]["freshness_factor"] == 0.5
    assert out["b"]["reasons"] == ["weakened-parent:a"] and out["c"]["freshness_factor"] > 0.98
    with pytest.raises(ValueError):
        belief.freshness(None, 0)


def test_histogram_and_witnesses(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.95,), (1.0,), (None,)], "p double")
    assert rows(belief.histogram(df, "p")) == {(0, 2), (9, 2)}
    c = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "claim_id string, load_bearing boolean")
    s = spark.createDataFrame([("a", "d", str(i)) for i in range(5)] + [("b", "d", "x")], "claim_id string, doc_id string, locator_text string")
    assert {(r["claim_id"], tuple(r["witnesses"]), r["truncated"]) for r in belief.why_provenance(c, s, 2).collect()} == {("a", ("d|0", "d|1"), True), ("c", (), False)}


# argumentation


def graph(spark, ids, conflicts, counters=(), implies=(), axioms=(), bearing=()):
    c = GraphCatalog(spark)
    c.put("claim", spark.createDataFrame([(i, i in axioms, i in bearing) for i in ids], "id string, axiom boolean, load_bearing boolean"))
    c.put("claim-conflict", spark.createDataFrame([(f"{a}>{b}", a, b) for a, b in conflicts], "id string, claim_id string, other_id string"))
    c.put("counter-claim", spark.createDataFrame([(x, x, t, s) for x, t, s in counters], "id string, cc_id string, target_claim_id string, cc_status string"))
    c.put("claim-implies", spark.createDataFrame([(f"{a}>{b}", a, b) for a, b in implies], "id string, claim_id string, target_id string"))
    return c


def plain_labels(ids, conflicts, counters):
    inner = {(a, b) for a, b in conflicts if a in ids and b in ids}
    outer = {t for _, t, s in counters if s == "open" and t in ids}
    acc, rej = {c for c in ids if c not in outer and not any(b == c for _, b in inner)}, set()
    for _ in ids:
        rej = rej | {b for a, b in inner if a in acc} | outer
        acc = acc | {c for c in ids if c not in outer and all(a in rej for a, b in inner if b == c)}
    return {(c, "rejected" if c in rej else "accepted" if c in acc else "undecided") for c in ids}


@pytest.mark.parametrize("seed", range(4))
def test_grounded_labels_match_the_stages(spark, seed):
    rng = random.Random(seed)
    ids = [f"c{i}" for i in range(12)]
    conflicts = list({(rng.choice(ids), rng.choice(ids + ["gone"])) for _ in range(14)})
    counters = [(f"k{i}", rng.choice(ids), rng.choice(["open", "addressed"])) for i in range(2)]
    assert rows(argument.grounded_labels(graph(spark, ids, conflicts, counters))) == plain_labels(ids, conflicts, counters)


def test_argumentation_outputs(spark):
    out = argument.argumentation(graph(spark, ["a", "b", "c", "x"], [("a", "b"), ("b", "c")], [("k", "c", "open")], [("x", "b")], ["x"], ["b", "c", "x"]))
    assert rows(out["labels"]) == {("a", "accepted"), ("b", "rejected"), ("c", "rejected"), ("x", "accepted")}
    assert rows(out["defended"]) == {("c", "b", "a")}
    assert rows(out["undefeated-attacker"]) == {("b", "a", "claim"), ("c", "k", "counter-claim")}
    assert rows(out["warnings"], "warning_type", "claim_id", "related_id") == {
        ("contested-load-bearing-with-undefended-attack", "b", "a"), ("contested-load-bearing-with-undefended-attack", "c", "k"), ("axiom-only-support", "b", "x"), ("unsupported-load-bearing", "c", ""), ("unsupported-load-bearing", "x", "")}


def test_workbench(spark):
    texts = [("1", "hull length is 2 km"), ("2", "hull length is 2000 m"), ("3", "hull length is 3 km"), ("4", "dock active from 1990 to 1995 requires overlap"), ("5", "dock active from 1996 to 1999 requires overlap")]
    c = GraphCatalog(spark)
    for name, df in ledger.normal_forms(spark.createDataFrame(texts, "claim_id string, canonical_text string")).items():
        c.put(name, df)
    assert rows(argument.quantity_clashes(c), "claim_a", "claim_b", "n_a", "n_b") == {("1", "3", 2, 1)}
    assert rows(argument.interval_inconsistencies(c), "claim_a", "claim_b") == {("4", "5")}


# graphs


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_reaches_and_expand(spark):
    e = edges(spark, [("a", "b"), ("b", "t"), ("c", "d"), ("d", "c"), (None, "t"), ("t", "t")])
    t = spark.createDataFrame([("t",)], "id string")
    assert rows(graphs.reaches(e, t)) == {("b", 1), ("a", 2), ("t", 1)}
    assert rows(graphs.expand(e, t, 1)) == {("t", 0), ("b", 1)}
    assert rows(graphs.reaches(e.limit(0), t)) == set()


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(28)] + ([(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] if seed == 0 else [])
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert rows(graphs.components(edges(spark, pairs))) == {(x, find(x)) for x in parent}
    assert rows(graphs.components(edges(spark, []), spark.createDataFrame([("z",)], "id string"))) == {("z", "z")}


def test_strong_components(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("e", "y"), ("s", "s")])
    assert rows(graphs.strong_components(e)) == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("s", "s")}
    assert rows(graphs.strong_components(edges(spark, [("a", "b")]))) == set()


def test_trails_and_orders(spark):
    e = edges(spark, [("root", "m"), ("m", "f"), ("root2", "f"), ("l1", "l2"), ("l2", "l1")])
    s = spark.createDataFrame([("f",), ("l1",), ("root",)], "id string")
    assert rows(graphs.shortest_trails(e, s)) == {("f", "f < root2", 1), ("root", "root", 0)}
    n = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "c"), ("h", "x"), ("h", "y")], "group string, node string")
    k = spark.createDataFrame([("g", "c", "a"), ("h", "x", "y"), ("h", "y", "x")], "group string, src string, dst string")
    assert rows(graphs.topological_orders(k, n)) == {("g", 0, "b"), ("g", 1, "c"), ("g", 2, "a"), ("h", -1, None)}
    best = graphs.topological_orders(k.where("group = 'g'"), n.where("group = 'g'"), objective=lambda p: p.index("b"))
    assert rows(best) == {("g", 0, "c"), ("g", 1, "a"), ("g", 2, "b")}


def test_contradictions_and_clusters(spark):
    f = spark.createDataFrame([("a", "s", "1"), ("b", "s", "2"), ("c", "s", "2"), ("d", "t", "9"), ("e", None, "1")], "id string, subject string, value string")
    assert rows(graphs.direct_contradictions(f), "value_a", "value_b", "claim_a", "claim_b", "n_a", "n_b") == {("1", "2", "a", "b", 1, 2)}
    i = spark.createDataFrame([("z", "y"), ("y", "a"), ("w", "d")], "claim_id string, target_id string")
    assert rows(graphs.transitive_contradictions(i, f), "a", "value", "against") == {("a", "1", 1), ("b", "2", 1), ("c", "2", 1), ("y", "1", 1), ("z", "1", 1)}
    c = spark.createDataFrame([("x", "Form "), ("y", "form"), ("y", "other"), ("z", "OTHER"), ("q", "alone"), (None, "form")], "slug string, form string")
    assert rows(graphs.concept_clusters(c)) == {("x", "x", 3), ("x", "y", 3), ("x", "z", 3)}


# evaluation


def test_agreement(spark):
    r = spark.createDataFrame([("i1", "a"), ("i1", "a"), ("i1", "b"), ("i2", "b"), ("i2", "b"), ("i2", "b"), ("i3", "a"), ("i3", None)], "item string, c string")
    k = evaluation.fleiss_kappa(r, "item", "c").first()
    assert (k["n_items"], k["raters"]) == (2, 3) and k["kappa"] == pytest.approx((2 / 3 - 5 / 9) / (1 - 5 / 9))
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    assert evaluation.cohens_kappa(p, "x", "y").first()["kappa"] == pytest.approx(0.5)
    w = evaluation.win_rates(spark.createDataFrame([("m", True)] * 8 + [("m", False)] * 2, "k string, w boolean"), "k", evaluation.F.col("w")).first()
    assert w["low"] == pytest.approx(0.4901, abs=1e-3) and w["high"] == pytest.approx(0.9433, abs=1e-3)


def test_attribution_and_factuality(spark):
    s = "item string, span string"
    a = evaluation.attribution(spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "z"), ("2", "z")], s), spark.createDataFrame([("1", "x"), ("3", "q")], s)).first()
    assert (a["tp"], a["n_predicted"], a["n_gold"], a["status"]) == (1, 3, 2, "scored") and a["macro_precision"] == pytest.approx(0.25) and a["macro_recall"] == pytest.approx(0.5)
    none = evaluation.attribution(spark.createDataFrame([], s), spark.createDataFrame([], s)).first()
    assert none["status"] == "unscored" and none["micro_precision"] is None
    t = spark.createDataFrame([(None, "full"), ("1", "none"), ("2", "full"), ("3", "full"), ("9", "full")], "claim_id string, check_status string")
    parts = evaluation.factuality(t, spark.createDataFrame([("1", "verified"), ("2", "disputed"), ("3", "verified")], "claim_id string, status string"))
    assert rows(parts) == {("novel", 1), ("unsupported", 1), ("disputed", 1), ("verified", 2)}
    assert tuple(evaluation.factuality_rates(parts).first()) == (5, 0.8, 0.6)


def test_panels_and_rollups(spark):
    panel = spark.createDataFrame([("g", "gating"), ("h", "gating"), ("i", "advisory")], "reviewer string, role string")
    said = {"ok": (0, 0, 0), "gating": (1, 0, 0), "advisory": (0, 0, 2), "missing": (0,), "both": (1, 3, 0)}
    r = spark.createDataFrame([(i, w, c) for i, n in said.items() for w, c in zip("ghi", n)] + [("unknown", w, 0) for w in "ghx"] + [("unread", "g", None), ("unread", "h", 0)], "item string, reviewer string, critical int")
    verdicts = lambda rule: {k: v for k, v in rows(evaluation.panel_verdicts(r, panel, rule), "item", "verdict")}
    hard = {k: "hard-gate-fail" for k in ("missing", "unknown", "unread")}
    assert verdicts("any_critical_from_gating") == hard | {"ok": "pass", "gating": "soft-gate-fail", "advisory": "pass", "both": "soft-gate-fail"}
    assert verdicts("any_critical") == hard | {"ok": "pass", "gating": "soft-gate-fail", "advisory": "soft-gate-fail", "both": "soft-gate-fail"}
    assert verdicts("majority_critical") == hard | {"ok": "pass", "gating": "soft-gate-fail", "advisory": "pass", "both": "soft-gate-fail"}  # a tie does not pass
    f = spark.createDataFrame([(" A b", "minor", "x", "l1"), ("a B ", "minor", "y", "l1"), (None, "minor", "z", "l2")], "text string, severity string, reviewer string, location string")
    assert rows(evaluation.dedup_findings(f)) == {("a b", "minor", 2, 2)} and rows(evaluation.convergence(f)) == {("l1", 2)}
    g = spark.createDataFrame([("d", 1, 9), ("d", 2, 3), ("d", 13, 14), ("d", 20, 20), ("e", 1, 1)], "g string, s int, e int")
    assert rows(ordered.gap_clusters(g, "g", "s", "e", 5, 4)) == {("d", 1, 14, 3), ("d", 20, 20, 1), ("e", 1, 1, 1)}


def test_drift_is_the_mean_pairwise_cosine(spark):
    docs = [("a", 1, ["x", "x", "y"]), ("a", 2, ["x"]), ("a", 3, ["z"]), ("b", 4, ["x"])]
    got = {r["arm"]: r["drift"] for r in evaluation.arm_drift(spark.createDataFrame(docs, "arm string, doc_id int, t array<string>"), "arm", "t").collect()}
    assert got["a"] == pytest.approx((2 / 5**0.5 + 0 + 0) / 3) and got["b"] is None


def test_decisions(spark):
    c = spark.createDataFrame([(f"i{i}", s) for i, s in enumerate([0.9, 0.9, 0.8, 0.6, 0.2])], "id string, score double")
    assert rows(evaluation.triage(c, cap=2), "id", "decision") == {("i0", "auto"), ("i1", "auto"), ("i2", "manual"), ("i3", "manual"), ("i4", "reject")}
    v = spark.createDataFrame([("r1", "support"), ("r1", "support"), ("r2", "support"), ("r3", "support"), ("r3", "contradict")], "rule string, stance string")
    assert rows(evaluation.governance(v, spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "rule string")), "rule", "state") == {("r1", "pass"), ("r2", "insufficient"), ("r3", "contradicted"), ("r4", "unknown")}
    k = spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(evaluation.sets_difference(k, spark.createDataFrame([("b",), ("c",)], "k string"), "k")) == {("a", "missing"), ("c", "extra")}
    d = spark.createDataFrame([(i, i % 3) for i in range(90)], "id int, s int")
    assert evaluation.stratified_sample(d, ["s"], "id", 4).count() == 12 and {r["s"] for r in evaluation.audit_sample(d, ["s"], "id").collect()} == {0, 1, 2}
    s = spark.createDataFrame([("p", "v1", "n", 1.0), ("p", "v2", "n", 1.5), ("q", "v1", "n", 1.0)], "prompt string, arm string, signal string, value double")
    assert rows(evaluation.signal_deltas(s, ("v1", "v2"))) == {("n", 1, 0.5)}


# retrieval


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8)).astype("float32")
    x[7] = x[3]
    data = [(i, [float(v) for v in x[i]]) for i in range(40)] + [(90, None), (91, []), (92, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted((r["query"], r["rank"], r["item"]) for r in retrieval.top_k(df.where("vec_id % 5 = 0"), df, 3).collect())
    unit = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1)[:, None]
    want = []
    for q in range(0, 40, 5):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        want += [(q, k + 1, int(i)) for k, i in enumerate(np.lexsort((np.arange(40), -s))[:3])]
    assert got == want
    assert retrieval.top_k(df.limit(0), df, 3).count() == 0


def test_coherence_is_the_mean_pairwise_cosine(spark):
    v = {"a": [[1.0, 0.0], [0.0, 2.0], [3.0, 3.0]], "b": [[1.0, 1.0]]}
    df = spark.createDataFrame([(i, g, x) for g, xs in v.items() for i, x in enumerate(xs)], "vec_id long, g string, embedding array<double>")
    got = {r["g"]: r["coherence"] for r in retrieval.coherence(df, "g").collect()}
    assert got["a"] == pytest.approx((0 + 2 * 0.5**0.5) / 3) and got["b"] == 1.0


# induction and design


def test_induction(spark):
    f = spark.createDataFrame([(f"d{i % 4}", "s", p, float(i)) for i in range(12) for p in ("p", "q")], "doc_id string, subject string, predicate string, value_num double")
    assert rows(induction.cooccurring(f)) == {("p", "q", 4)} and rows(induction.cooccurring(f.limit(3))) == set()
    folds = induction.document_folds(f, 3)
    assert rows(folds) == {("d0", 0), ("d1", 1), ("d2", 2), ("d3", 0)}
    h = rows(induction.holdout(f, folds, read_edn("(> p 9)"), ["p"]), "fold", "n_docs", "sat_rate", "passes")
    assert h == {(0, 2, 0.5, True), (1, 1, 0.0, False), (2, 1, 1.0, True)}
    assert {r[3] for r in rows(induction.holdout(f, folds, read_edn("(> 1 0)"), []))} == {False}
    r = spark.createDataFrame([("r", 1.0, [f"d{i}" for i in range(10)], "active"), ("t", 1.0, [f"d{i}" for i in range(10)], "tentative")], "rule string, sat_rate double, docs array<string>, status string")
    out = induction.revise(r, spark.createDataFrame([("r", f"d{i}") for i in range(3)], "rule string, doc_id string"))
    assert rows(out, "rule", "n_docs", "status") == {("r", 7, "tentative"), ("t", 10, "tentative")}
    assert induction.conforms(read_edn("(and (> a 1) (= b 2))")) and not induction.conforms(read_edn("(launch a)")) and induction.is_tautology(read_edn("(= a a)"))
    assert induction.enumerate_bodies({"a": "n", "b": "n", "c": "m"}, 2) == [("a",), ("b",), ("c",), ("a", "b")]


def test_traceability_and_communities(spark):
    reqs = spark.createDataFrame([("r1", "REQ-1", "uses `load` of `src/io.py`"), ("r2", "REQ-A-VERY-LONG-NAME-OF-MANY-PARTS-2", None)], "id string, requirement_id string, text string")
    nodes = spark.createDataFrame([("m", "io.py", "src/io.py"), ("f", "load()", "src/io.py"), ("g", "load()", "src/b.py")], "id string, label string, source_file string")
    tests = spark.createDataFrame([("t1", "REQ-1", "tests/test_a.py"), ("t2", "REQ-A-VERY-LONG-NAME-OF-MANY-PARTS-2", "tests/test_b.py"), ("t3", None, "tests/test_a.py")], "id string, target string, source_path string")
    jobs = spark.createDataFrame([("j1", "pytest -q tools/tests/test_a.py"), ("j2", "make all"), ("j3", None)], "id string, command string")
    used = spark.createDataFrame([("tests/test_a.py", "./src/io.py"), ("tests/test_b.py", "os.py")], "source_path string, module_path string")
    got = rows(design.traceability(reqs, nodes, tests, jobs, used), "from_id", "to_id", "kind", "promoted")
    assert got == {("r1", "f", "requirement-implemented-by", False), ("r1", "g", "requirement-implemented-by", False), ("r1", "m", "requirement-implemented-by", True),
                   ("r1", "t1", "requirement-covered-by", True), ("r2", "t2", "requirement-covered-by", True), ("j1", "t1", "workflow-runs-test", True), ("j1", "t3", "workflow-runs-test", True),
                   ("r1", "j1", "requirement-gated-by", True), ("t1", "m", "test-exercises-code", True), ("t3", "m", "test-exercises-code", True)}
    owned = spark.createDataFrame([("m", "x"), ("f", "x"), ("g", "y"), ("h", None)], "id string, community string")
    links = spark.createDataFrame([("m", "c1"), ("f", "c1"), ("f", "c2"), ("g", "c1"), ("g", "c3"), ("h", "c2")], "code_id string, claim_id string")
    chosen = spark.createDataFrame([("c1",), ("c2",)], "claim_id string")
    assert rows(design.dominant_communities(owned, links, chosen)) == {(1, "x", 2, "c1"), (2, "y", 1, "c1")}


def test_ballots_positions_and_questions(spark):
    arm = lambda name, texts: spark.createDataFrame([(k, "plain", t, name) for k, t in texts.items()], "prompt_id string, register string, text string, arm string")
    b = evaluation.ballots(arm("v1", {"a": "one two three", "b": "one two three", "c": ""}), arm("v2", {"a": "x y z", "b": "x", "c": "x", "d": "x"}))
    assert rows(b, "prompt_id", "order", "length_matched", "a_arm", "b_arm") == {(p, o, p == "a", *(("v1", "v2") if o == 0 else ("v2", "v1"))) for p in "abc" for o in (0, 1)}
    assert rows(evaluation.decode_ballots(b.where("prompt_id = 'a'").withColumn("keep", F.lit("B"))), "order", "kept_arm") == {(0, "v2"), (1, "v1")}
    runs = spark.createDataFrame([("SUCCESS", "t", "a; b"), ("LINT", None, "a;;"), ("LINT", "", None), (None, "t", "")], "outcome string, extract_passed string, doc_gaps string")
    assert rows(evaluation.run_summary(runs)) == {("summary", "total", 4.0), ("summary", "reach_extract", 0.5), ("summary", "reach_ci", 0.25), ("doc gap", "a", 2.0), ("doc gap", "b", 1.0), ("failure", "LINT", 2.0)}
    ev = spark.createDataFrame([("r", "d1", "support"), ("r", "d2", "support"), ("r", "d1", "support"), ("s", "d1", "support"), ("s", "d3", "contradict"), ("t", "d3", "contradict")], "rule string, doc_id string, stance string")
    mem = spark.createDataFrame([("x", "d1"), ("x", "d2"), ("y", "d3")], "school string, doc_id string")
    ch = spark.createDataFrame([("y", "r", False)], "school string, rule string, asserts boolean")
    assert rows(evaluation.positions(ev, mem, ch), "rule", "school", "stance", "declared") == {
        ("r", "x", "supports", False), ("r", "y", "contradicts", True), ("s", "x", "extends", False), ("s", "y", "contradicts", False), ("t", "x", "silent", False), ("t", "y", "contradicts", False)}
    c = spark.createDataFrame([("1", "t", "s1"), ("2", "t", "s2"), ("2", "t", None), ("3", "u", "s3")], "claim_id string, topic string, source_id string")
    k = spark.createDataFrame([("2", "1"), ("1", "2"), ("1", "3"), ("1", "1")], "claim_id string, other_id string")
    assert rows(evaluation.disputed_questions(c, k)) == {("t", "1 against 2", "1", "asserts", "s1"), ("t", "1 against 2", "2", "denies", "s2"), ("t", "1 against 2", "2", "denies", None)}


def test_code_links_and_design_queries(spark):
    nodes = spark.createDataFrame([("m", "io.py", "src/io.py"), ("f", "load()", "src/io.py"), ("g", "save()", "src/a.py"), ("h", "save()", "src/b.py")], "id string, label string, source_file string")
    e = spark.createDataFrame([("m", "f", "contains")], "source_id string, target_id string, relationship string")
    claims = spark.createDataFrame([("c1", "calls `load` and `save`", ["./src\\io.py"]), ("c2", None, None)], "claim_id string, text string, source_files array<string>")
    links, evidence = design.code_claim_links(claims, nodes, e)
    assert rows(links) == {("m", "c1", "file-path"), ("f", "c1", "exact-symbol")}
    assert rows(evidence, "code_id", "score") == {("m", 1.0), ("f", 1.0), ("g", 0.5), ("h", 0.5)}
    c = GraphCatalog(spark)
    c.put("code-node", spark.createDataFrame([("m", "io.py", "src/io.py", 0.95), ("g", "save", "src/a.py", 0.99)], "id string, label string, source_file string, rank double"))
    c.put("design-requirement", spark.createDataFrame([("r1", "REQ-1", "cap", "must load", "specs/cap/spec.md")], "id string, requirement_id string, capability string, text string, source_path string"))
    t = [("1", "r1", "m", "requirement-implemented-by", True), ("2", "t1", "m", "test-exercises-code", True), ("3", "r1", "zz", "requirement-covered-by", False), ("4", "r1", "j1", "requirement-gated-by", True)]
    c.put("traceability-link", spark.createDataFrame(t, "id string, from_id string, to_id string, kind string, promoted boolean"))
    c.put("ci-job", spark.createDataFrame([("j1", "unit")], "id string, name string"))
    q = lambda n, *a: design.run_design_query(c, n, *a)
    assert rows(q("impact", "io.py"), "kind") == {("requirement-implemented-by",), ("test-exercises-code",)}
    assert rows(q("coverage-gaps"), "requirement_id", "missing") == {("REQ-1", "requirement-covered-by")}
    assert rows(q("stale-docs"), "to_id") == {("zz",)} and rows(q("untested-god-nodes"), "id") == {("g",)} and rows(q("ci-gates", "cap"), "job") == {("unit",)}
    assert ("requirement",) in rows(q("why", "REQ-1"), "kind") and q("claim-grounding", "m").count() == 0
    with pytest.raises(ValueError):
        q("nothing")
    m = spark.createDataFrame([("ch", "words", 1800.0), ("ch", "done", 1.0)], "chapter string, metric string, value double")
    k = spark.createDataFrame([("ch", "words >= 1700"), ("ch", "words < 10"), ("ch", "done == true"), ("ch", "done > true"), ("ch", "odd == 1")], "chapter string, test string")
    assert rows(design.evaluate_contract(m, k), "test", "passes") == {("words >= 1700", True), ("words < 10", False), ("done == true", True), ("done > true", False), ("odd == 1", True)}
