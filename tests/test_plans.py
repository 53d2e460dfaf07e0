"""The query language against its plain evaluator, its errors, EDN, the catalogue, rules."""

from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marlstone.plans import rules
from marlstone.plans.catalog import CLAIM_GRAPH, GraphCatalog, schema_from_edn
from marlstone.plans.edn import EdnError, Keyword, List, Symbol, Tagged, read_all, read_edn, write_edn
from marlstone.plans.oracle import evaluate
from marlstone.plans.query import assert_not_blocked, competency_report, constraint_report, run_constraint, run_query

# EDN


def test_edn_values():
    text = '{:a [1 -2.5 1/2 "x\\n\\"y" \\c \\newline nil true] #{:k} (f ?x) :t #inst "2024-01-01T00:00:00Z" ; note' + "\n" + ' #_ dropped :u 3M}'
    v = read_edn(text)
    assert v[Keyword("a")] == [1, -2.5, 0.5, 'x\n"y', "c", "\n", None, True]
    assert v[frozenset({Keyword("k")})] == List([Symbol("f"), Symbol("?x")])
    assert v[Keyword("t")] == datetime(2024, 1, 1, tzinfo=timezone.utc) and v[Keyword("u")] == 3.0
    assert read_all("1 #_ 2 3") == [1, 3]


@pytest.mark.parametrize("bad", ["(", "]", '{:a}', '"open', "(]", ":", "#{1"])
def test_edn_errors(bad):
    with pytest.raises(EdnError):
        read_edn(bad)


edn = st.recursive(
    st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(max_size=5) | st.sampled_from([Keyword("a/b"), Symbol("?x"), Symbol("<=")]),
    lambda x: st.lists(x, max_size=3) | st.lists(x, max_size=3).map(List) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(edn)
def test_edn_round_trip(v):
    assert read_edn(write_edn(v)) == v


def test_edn_tags_are_kept():
    assert read_edn("#money 3") == Tagged("money", 3)


# catalogue


def test_schemas():
    s = CLAIM_GRAPH
    assert s["claim"]["confidence"] == "float" and s["source-span"]["page-index"] == "int" and next(iter(s["counter-claim"])) == "id"
    assert schema_from_edn("{:entities {:a {:attrs [:id :n] :types {:n :int}}}}") == {"a": {"id": "string", "n": "int"}}


def test_catalogue_upserts_and_refuses(spark):
    c = GraphCatalog(spark, {"a": {"id": "string", "n": "int", "x-y": "string"}})
    assert c.relation("a").count() == 0 and c.relation("a").columns == ["id", "n", "x_y"]
    c.put("a", spark.createDataFrame([("1", 5), ("2", 6)], "id string, n int"))
    c.upsert("a", spark.createDataFrame([("2", 7), ("3", None)], "id string, n int"))
    assert {(r["id"], r["n"], r["x_y"]) for r in c.relation("a").collect()} == {("1", 5, None), ("2", 7, None), ("3", None, None)}
    with pytest.raises(ValueError, match="unknown relation"):
        c.put("b", c.relation("a"))


# queries

SCHEMA = {"p": {"id": "string", "a": "string", "n": "int"}, "q": {"id": "string", "ref": "string", "m": "int"}, "r": {"id": "string", "ref": "string"}}
QUERIES = [
    "(defquery :one :find [?x ?n] :where [[?e :p/a ?x] [?e :p/n ?n]])",
    "(defquery :join :find [?i ?m] :where [[?e :p/id ?i] [?e :p/a ?k] [?f :q/ref ?k] [?f :q/m ?m]])",
    "(defquery :compare :find [?i] :where [[?e :p/id ?i] [?e :p/n ?n] [?f :q/ref ?i] [?f :q/m ?m]] :filter [[< ?n ?m] [!= ?m 2]])",
    "(defquery :two-nots :find [?i] :where [[?e :p/id ?i]] :not [[?f :q/ref ?i] [?g :r/ref ?i]])",
    "(defquery :literal :find [?i] :where [[?e :p/id ?i] [?e :p/n 1]] :not [[?f :q/ref ?i] [?f :q/m 1]])",
    "(defquery :counted :find [?a (count ?i) (count-distinct ?n)] :where [[?e :p/a ?a] [?e :p/id ?i] [?e :p/n ?n]])",
    "(defquery :positional :find [?i ?m] :where [(p ?i ?k _) (q _ ?k ?m) (>= ?m 1)])",
    "(defquery :same :find [?i] :where [[?e :p/id ?i] [?e :p/a ?i]])",
]
cell, num = st.sampled_from(["x", "y", "z", None]), st.sampled_from([0, 1, 2, None])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cell, cell, num), max_size=6), st.lists(st.tuples(cell, cell, num), max_size=6), st.lists(st.tuples(cell, cell), max_size=4))
def test_queries_match_the_plain_evaluator(spark, p, q, r):
    c = GraphCatalog(spark, SCHEMA)
    tables = {"p": [dict(zip(("id", "a", "n"), x)) for x in set(p)], "q": [dict(zip(("id", "ref", "m"), x)) for x in set(q)], "r": [dict(zip(("id", "ref"), x)) for x in set(r)]}
    for name, types in (("p", "id string, a string, n long"), ("q", "id string, ref string, m long"), ("r", "id string, ref string")):
        c.put(name, spark.createDataFrame([tuple(x.values()) for x in tables[name]], types))
    for text in QUERIES:
        rows = run_query(text, c).collect()
        assert len({tuple(x) for x in rows}) == len(rows)
        assert {tuple(x) for x in rows} == evaluate(text, c, tables), text


@pytest.mark.parametrize("text,what", [
    ("(defrule :x)", "expected"), ("(defquery :x :find [?a] :where [])", "empty"), ("(defquery :x :find [] :where [[?e :p/a ?a]])", ":find"), ("(defquery :x :find [?b] :where [[?e :p/a ?a]])", r"\?b"),
    ("(defquery :x :find [?a] :where [[?e :p/zz ?a]])", "zz"), ("(defquery :x :find [?a] :where [[?e :zz/a ?a]])", "zz"), ("(defquery :x :find [?a] :where [[?e :p/a]])", "three parts"),
    ("(defquery :x :find [?a] :where [[?e :p/a ?a]] :filter [[~ ?a 1]])", "comparator"), ("(defquery :x :find [?a] :where [[?e :p/a ?a]] :filter [[< ?b 1]])", r"\?b"), ("(defquery :x :find [?a] :where [[?e :p/a ?a]] :filter [[< 2 1]])", "variable"),
    ("(defquery :x :find [?a] :where [[?e :p/a ?a]] :not [[?f :q/ref ?a] [?f :q/m ?free]])", "unsafe"), ("(defquery :x :find [?a] :where [[?e :p/a ?a]] :not [[?f :q/m 1]])", "shares no variable"), ("(defquery :x :find [(sum ?a)] :where [[?e :p/a ?a]])", "aggregate"),
    ("(defquery :x :find [?a] :where [(p ?a ?b ?c ?d)])", "at most"), ("(defquery :x :find [?a] :where [[?e :p/a ?a] [?e :q/m ?m]])", "stands for"), ("(defquery :x :find [?a ?m] :where [[?e :p/a ?a] [?f :q/m ?m]])", "cartesian")])
def test_errors_name_the_offender(spark, text, what):
    with pytest.raises(ValueError, match=what):
        run_query(text, GraphCatalog(spark, SCHEMA))


def test_constraints(spark):
    c = GraphCatalog(spark, SCHEMA)
    c.put("p", spark.createDataFrame([("1", "x", 1), ("2", None, 2), ("3", "y", None)], "id string, a string, n long"))
    missing = '(defconstraint :has-a :message "no a" :path "a" :where [[?e :p/id ?focus]] :not [[?f :p/id ?focus] [?f :p/a ?any]])'
    big = '(defconstraint :small :message "too big" :component "x#Max" :where [[?e :p/id ?focus] [?e :p/n ?n]] :filter [[> ?n 1]])'
    assert {tuple(r) for r in constraint_report([missing, big], c).collect()} == {("has-a", "2", "a", "no a", ""), ("small", "2", "", "too big", "x#Max")}
    for bad in ('(defconstraint :x :message "m" :where [[?e :p/id ?i]])', '(defconstraint :x :where [[?e :p/id ?focus]])', '(defconstraint :x :message "m" :find [?focus] :where [[?e :p/id ?focus]])'):
        with pytest.raises(ValueError):
            run_constraint(bad, c)
    report = competency_report({"q": (QUERIES[0], "defeasible", "critical")}, c)
    with pytest.raises(ValueError, match="blocked by q"):
        assert_not_blocked(report)


# rules


def test_lifts_take_the_first_match(spark):
    lifts = rules.parse_lifts(r'(deflift :cases :kind :int :pattern "^(?P<subject>\\w+) has (?P<value>[\\d,]+|three) cases") (deflift :any :kind :string :subject "s" :pattern "has (?<value>\\w+)") (deflift :flag :kind :bool :subject "s" :pattern "is open")')
    rows = spark.createDataFrame([("1", "Rome has 1,250 cases"), ("2", "Rome has three cases"), ("3", "it has none"), ("4", "it is open"), ("5", None), ("6", "")], "claim_id string, canonical_text string")
    got = {r["claim_id"]: (r["predicate"], r["subject"], r["value_num"], r["value_str"], r["value_bool"]) for r in rules.apply_lifts(rows, lifts).collect()}
    assert got == {"1": ("cases", "rome", 1250.0, None, None), "2": ("cases", "rome", 3.0, None, None), "3": ("any", "s", None, "none", None), "4": ("flag", "s", None, None, True), "5": ("OPAQUE", None, None, None, None), "6": ("OPAQUE", None, None, None, None)}
    assert rules.opaque_gate(rules.apply_lifts(rows, lifts)).first()["passes"]
    with pytest.raises(ValueError):
        rules.Lift("x", "abc", "int")


@pytest.mark.parametrize("form,want", [
    ("(= (+ a b) 5)", True), ("(=> (> a 1) (> b 9))", False), ("(ite (< a b) true false)", True), ("(< 1 a b)", True), ("(not (= a b))", True), ("(~= a 2.1 0.1)", True), ("(approx= 1000 1001 0.0001)", False), ("(= (mod 7 a) 1)", True),
    ("(= (sum v) 6)", True), ("(= (count v) 3)", True), ("(in 3 v)", True), ("(= (select v 0) 1)", True), ("(forall [x v] (> x 0))", True), ("(exists [x v] (> x 3))", False), ("(> z 1)", None), ("(= (/ a 0) 1)", None), ("(or (and (> a 1) (< a 3)) (= b 0))", True), ("(= (- a) -2)", True)])
def test_assertions(spark, form, want):
    df = spark.createDataFrame([(2.0, 3.0, None, [1.0, 2.0, 3.0])], "a double, b double, z double, v array<double>")
    assert df.select(rules.compile_assert(form).alias("x")).first()["x"] == want


def test_checks_by_subject_and_corpus(spark):
    facts = spark.createDataFrame([("1", "s", "a", 5.0), ("2", "s", "a", -1.0), ("3", "t", "a", 5.0), ("4", "u", "b", 1.0), ("5", "t", "b", 1.0)], "claim_id string, subject string, predicate string, value_num double")
    cs = rules.parse_constraints("(defconstraint :pos :assert (> a 0)) (defconstraint :all :scope :corpus :severity :minor :assert (= b 1)) (defconstraint :both :assert (> a b))")
    got = {(r["constraint"], r["subject"]): (r["status"], r["witnesses"]) for r in rules.check_constraints(facts, cs).collect()}
    assert got[("pos", "s")] == ("unsat", ["1", "2"]) and got[("pos", "t")][0] == "sat" and got[("pos", "u")][0] == "unknown" and got[("all", "*")][0] == "sat" and got[("both", "s")][0] == "unknown" and got[("both", "t")][0] == "sat"
    checks = rules.check_constraints(facts, cs)
    assert rules.verdict(checks).first()["status"] == "unsat"
    claims = spark.createDataFrame([("1", 0.4), ("2", 0.3)], "claim_id string, confidence double")
    d = rules.defect_confidence(checks, claims)
    assert [(r["confidence"], r["severity"]) for r in d.collect()] == [(0.3, "important")]
    assert rules.verdict_confidence(d).first()[0] == pytest.approx(0.3) and rules.verdict_confidence(d.limit(0)).first()[0] == 1.0


def test_forms():
    a, b = read_edn("(and (= ?x 1) (< 2 ?y))"), read_edn("(and (< 2 ?q) (= 1 ?p))")
    assert len(rules.dedup_rules([("m", a), ("n", read_edn("(and (= ?z 1) (< 2 ?w))")), ("o", b)])) <= 2
    assert rules.dedup_rules([("m", a), ("n", read_edn("(and (= ?z 1) (< 2 ?w))"))])[0][1] == ["m", "n"]
    assert rules.canonical_form(read_edn("(+ b (+ a c))")) == rules.canonical_form(read_edn("(+ (+ c b) a)"))


def test_tolerance_and_proposals(spark):
    p = spark.createDataFrame([(10.0, 11.0), (5.0, 5.0), (None, 1.0)], "l double, r double")
    assert rules.fit_tolerance(p, "l", "r", 1.0).first()[0] == pytest.approx(1 / 11) and rules.fit_tolerance(p, "l", "r", 0.01).first()[0] is None
    t = spark.createDataFrame([("1", "contradiction"), ("2", "replaced"), ("3", "other")], "claim_id string, kind string")
    c = spark.createDataFrame([("1", "verified"), ("2", "refuted"), ("3", "verified")], "claim_id string, status string")
    assert {tuple(r) for r in rules.propose(t, c).collect()} == {("1", "verified", "disputed", True), ("2", "refuted", "superseded", False)}
