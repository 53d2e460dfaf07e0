"""Thesis consistency, gates, composition."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import composition, consistency
from marlstone.plans.catalog import GraphCatalog


def rows(df, *cols):
    return {tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()}


@pytest.fixture
def thesis(spark):
    c = GraphCatalog(spark)
    c.put("thesis-node", spark.createDataFrame([("t", "s")], "id string, statement string"))
    c.put("sub-argument", spark.createDataFrame([("a", "t"), ("b", "a"), ("x", "y"), ("y", "x")], "id string, parent string"))
    c.put("paragraph-supports", spark.createDataFrame([("1", "c1", "b"), ("2", "c2", "x"), ("3", "c3", "gone"), ("4", "c1", "t")], "id string, claim_id string, node string"))
    c.put("claim-fact", spark.createDataFrame([("c1", "s", "1"), ("c2", "s", "2"), ("c4", None, "2")], "id string, subject string, value string"))
    c.put("claim-implies", spark.createDataFrame([("i", "c5", "c1")], "id string, claim_id string, target_id string"))
    c.put("claim-conflict", spark.createDataFrame([("k", "c2", "c1"), ("l", "c1", "c2")], "id string, claim_id string, other_id string"))
    c.put("sub-arg-chapter", spark.createDataFrame([("q", "a", "ch")], "id string, sub_arg_id string, chapter string"))
    c.put("sub-arg-evidence", spark.createDataFrame([("e", "a", "s"), ("f", "a", "z")], "id string, sub_arg_id string, evidence string"))
    c.put("invariant", spark.createDataFrame([("pin", "s", "1", None), ("bad", "s", None, "2")], "id string, subject string, pinned_value string, forbidden_value string"))
    return c


def test_defects_and_gate(spark, thesis):
    d = consistency.thesis_defects(thesis)
    assert rows(consistency.reaching(thesis)) == {("a",), ("b",), ("c1",)}
    assert rows(d, "kind", "id") == {("orphan", "c2"), ("orphan", "c3"), ("unreachable", "c3"), ("contradiction", "c1"), ("implied-contradiction", "c5"), ("declared-conflict", "c1"), ("no-chapter", "b"), ("no-chapter", "x"), ("no-chapter", "y"),
                                    ("missing-evidence", "a"), ("invariant", "c2")}
    assert consistency.consistency_gate(d, thesis.relation("claim-fact")).first()["failed"]
    clean = GraphCatalog(spark)
    assert not consistency.consistency_gate(consistency.thesis_defects(clean), clean.relation("claim-fact")).first()["failed"]


def test_gates_and_feeds(spark):
    none, one = spark.range(0), spark.range(1)
    ok = spark.createDataFrame([(True,)], "passes boolean")
    assert consistency.preflight(none, none, none, ok).first()["ready"] and not consistency.preflight(none, one, none, ok).first()["ready"]
    v = spark.createDataFrame([("a", "go", 5), ("b", "go", 1)], "chapter string, verdict string, at_us long")
    assert rows(consistency.fresh_verdicts(v, spark.createDataFrame([("a", 5), ("b", 2)], "chapter string, at_us long")), "chapter") == {("a",)}
    d = spark.createDataFrame([("1", "auto"), ("2", "auto"), ("3", "auto"), ("4", "reject")], "id string, decision string")
    c = spark.createDataFrame([("1", "x"), ("2", "y"), ("4", "y")], "id string, concept string")
    assert rows(consistency.veto(d, c, spark.createDataFrame([("x",)], "concept string"))) == {("1", "auto"), ("2", "manual"), ("3", "auto"), ("4", "reject")}
    g = spark.createDataFrame([("n", 0.3), ("m", 0.3), ("o", 1.0)], "node string, coverage double")
    assert rows(consistency.gap_seeds(g, spark.createDataFrame([("m",)], "node string"))) == {("n",)}
    k = spark.createDataFrame([("1", "open", None), ("2", "dismissed", None)], "id string, status string, addressed_in_chapter string")
    assert rows(consistency.promote_addressed(k, spark.createDataFrame([("1", "ch"), ("1", "ch"), ("2", "ch")], "id string, chapter string"))) == {("1", "addressed", "ch")}
    checks = spark.createDataFrame([("c", "s", "unsat"), ("d", "s", "sat")], "constraint string, subject string, status string")
    assert rows(consistency.match_remedies(checks, spark.createDataFrame([("c", "retract"), ("d", "x")], "constraint string, remedy string"))) == {("c", "s", "retract")}


def test_composition(spark):
    n = spark.createDataFrame([("g", "1", "s1", ["a"]), ("g", "2", None, ["b"]), ("g", "3", None, ["a", "b"]), ("h", "1", "s1", ["a"]), ("h", "2", "s2", ["z"]), ("h", "3", "s2", [])], "group string, id string, slot string, entities array<string>")
    s = spark.createDataFrame([("g", "s1", True), ("g", "s9", True), ("h", "s2", False)], "group string, slot string, required boolean")
    assert rows(composition.feasibility(n, s)) == {("g", "required slot unfilled: s9"), ("g", "too many unbound paragraphs"), ("h", "entity graph is disconnected")}
    b = spark.createDataFrame([("1", "the ledger holds", "cause", ["ledger"], ["holds"]), ("2", "the dragon", "odd", ["ledger"], [])], "id string, text string, relation string, left array<string>, right array<string>")
    assert rows(composition.bridge_problems(b, ["cause"])) == {("2", "relation: odd"), ("2", "new entities: dragon")}
    assert rows(composition.seam_problems(spark.createDataFrame([("1", "The Ledger", ["ledger", "claim"])], "id string, text string, tokens array<string>"))) == {("1", "claim")}
    w = spark.createDataFrame([("g", "aaaa", False), ("g", "bb", True), ("h", "a", False), ("h", "bb", True)], "group string, text string, is_bridge boolean")
    assert rows(composition.weave_gate(w), "group", "passes") == {("g", True), ("h", False)}
    v = spark.createDataFrame([(1, [3, 1, 2, 2, 0, 5]), (2, []), (3, [5, 4, 3]), (4, [1, 1, 1])], "i int, v array<int>")
    assert rows(v.select("i", composition.longest_non_decreasing(F.col("v")).alias("n"))) == {(1, 4), (2, 0), (3, 1), (4, 3)}


def test_rewrites(spark):
    a = "Ledgers keep every record. Claims cite their sources. Writers object loudly. Numbers grow quickly. Readers judge fairly."
    same = "Every record stays in ledgers. Claims cite sources. Writers object. Numbers grow. Readers judge."
    back = " ".join(reversed(a.split(". "))).replace("fairly.", "fairly. ")
    back = ". ".join(x.strip(".") for x in reversed(a.split(". "))) + "."
    df = spark.createDataFrame([("same", a, same), ("lost", a, "Claims cite their sources."), ("back", a, back), ("new", a, a + " In 1999 Grand Canal won."), ("null", None, a), ("empty", "", "")], "id string, before string, after string")
    got = rows(composition.argument_losses(df), "id", "kind", "detail")
    assert {k for i, k, _ in got if i == "same"} == set() and ("lost", "dropped-claim", "0") in got and ("back", "reordered-claim", "1/5") in got
    assert {("new", "introduced-fact", "1999"), ("new", "introduced-fact", "Grand Canal")} <= got and not any(i in ("null", "empty") for i, _, _ in got)


def test_small_ones(spark):
    v = spark.createDataFrame([(0.5, 0.35, 2.0)], "m double, f double, a double").select(composition.vitality(F.col("m"), F.col("f"), F.col("a")).alias("v")).first()["v"]
    assert v == pytest.approx(0.59)
    c = spark.createDataFrame([("Canal", "ch-2"), ("canal", "ch-1")], "concept string, chapter string")
    assert rows(composition.first_introduced(c)) == {("canal", "ch-1", 2)}
    t = spark.createDataFrame([("1", ["a", "b"]), ("2", ["c"]), ("3", None)], "id string, tags array<string>")
    assert rows(composition.by_tags(t, ["b", "x"]), "id") == {("1",)} and composition.by_tags(t, []).count() == 0
    k = spark.createDataFrame([("1", "m", "x", 0.5), ("2", "m", "y", 0.9), ("3", "n", "x", 1.0)], "id string, mode string, move string, weight double")
    assert rows(composition.anchor(k, "m"), "id") == {("2",)} and rows(composition.anchor(k, "m", "x"), "id") == {("1",)}
