"""Odd inputs of the general operators: nulls, ties, repeats, empty tables, hot keys, clashing names."""

import json
import random
from datetime import datetime

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marlstone.operators import hierarchy, history, nested, references, snapshots, timestamps, units
from tests import brute

REFS = "ref_table string, ref_key string, ref_field string, target_table string, target_key string, ref_us long"
PARENTS = "target_table string, target_key string, first_us long, gone boolean"


# p1


def orphans(spark, refs, parents):
    out = references.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    return {(r["ref_key"], r["target_key"], r["reason"]) for r in out.collect()}


def test_reasons_in_order(spark):
    parents = [("t", "a", 10, False), ("t", "b", None, True), ("t", "c", 50, False), ("t", "d", None, False), ("u", "x", 1, False)]
    refs = [("r", "1", "f", "t", "a", 20), ("r", "2", "f", "t", "b", 20), ("r", "3", "f", "t", "c", 20), ("r", "4", "f", "t", "c", None), ("r", "5", "f", "t", "d", 20),
            ("r", "6", "f", "t", "zz", 20), ("r", "7", "f", "t", "x", 20), ("r", "8", "f", "t", None, 20), ("r", "9", "f", "t", "", 20)]
    assert orphans(spark, refs, parents) == {("2", "b", "deleted"), ("3", "c", "late"), ("6", "zz", "missing"), ("7", "x", "missing"), ("9", "", "missing")}


def test_no_parents_and_no_references(spark):
    assert orphans(spark, [("r", "1", "f", "t", "a", 1)], []) == {("1", "a", "missing")}
    assert orphans(spark, [], [("t", "a", 1, False)]) == set()
    assert orphans(spark, [], []) == set()


def test_hot_target_is_split_over_parts(spark, monkeypatch):
    monkeypatch.setattr(references, "REFERENCES_PER_BATCH", 50)
    monkeypatch.setattr(references, "PARENTS_PER_RANGE", 3)
    parents = [("t", f"k{i}", i, i % 7 == 0) for i in range(40)]
    refs = [("r", str(i), "f", "t", "k1", 0) for i in range(400)] + [("r", f"x{i}", "f", "t", f"k{i}", 100) for i in range(60)]
    want = {(str(i), "k1", "late") for i in range(400)} | {(f"x{i}", f"k{i}", "missing" if i >= 40 else "deleted") for i in range(60) if i >= 40 or i % 7 == 0}
    assert orphans(spark, refs, parents) == want


def test_probe_tells_keys_of_one_hash_apart():
    parents = pd.DataFrame({"hash": [5, 5, 9], "target_table": ["t"] * 3, "target_key": ["a", "b", "c"], "first_us": [1, 99, None], "gone": [False, False, True]})
    refs = pd.DataFrame({"hash": [5, 5, 5, 9, 1], "ref_table": "r", "ref_key": list("12345"), "ref_field": "f", "target_table": "t", "target_key": ["a", "b", "q", "c", "a"], "ref_us": [3, 3, 3, 3, 3]})
    out = references._probe(parents, refs)
    assert dict(zip(out["ref_key"], out["reason"])) == {"2": "late", "3": "missing", "4": "deleted", "5": "missing"}


def test_report_counts_by_month(spark):
    rows = [("r", "1", "f", "t", "a", 0, "missing"), ("r", "2", "f", "t", "a", 1, "missing"), ("r", "3", "f", "t", "a", None, "late")]
    out = references.orphan_report(spark.createDataFrame(rows, REFS + ", reason string")).collect()
    assert {(r["month"], r["reason"], r["n_references"]) for r in out} == {("1970-01", "missing", 2), (None, "late", 1)}


# p2


@pytest.mark.parametrize("payload", [None, "", "not json", '{"claim_id": "a"', "null", "3", "[]", '"text"', '{"source_spans": [{"locator_text": "x"}]}', '{"claim_id": null, "supports_chapters": "c"}'])
def test_payloads_without_rows(spark, payload):
    df = spark.createDataFrame([(1, payload)], "record_id long, payload string")
    assert nested.claim_child_rows(df).collect() == []


def test_children_in_every_shape(spark):
    spans = [None, {"doc_id": "d1", "locator_text": "x"}, {"doc_id": "d2", "locators": [{"locator_text": "y"}, {"doc_id": "d3", "locator_text": "z"}]}, {"locator_text": None}, {"locator_text": "w"}]
    claim = {"supports_chapters": "ch-1; ch-2,ch-1", "claim_id": "c|1", "source_spans": json.dumps(spans)}
    payload = "﻿" + json.dumps({"batch": {"records": [claim, {"claim_id": "c2", "supports_chapters": [{"chapter_id": "a", "sections": [{"chapter_id": "deep"}]}, "b", None]}]}})
    rows = [(7, payload), (7, payload)]
    out = {tuple(r) for r in nested.claim_child_rows(spark.createDataFrame(rows, "record_id long, payload string")).collect()}
    c = lambda *x: (7, "c|1", "source_spans", *x)
    assert {r for r in out if r[1] == "c|1"} == {c(0, "d1|x"), c(1, "d2|y"), c(2, "d3|z"), c(3, "|w"), (7, "c|1", "supports_chapters", 0, "ch-1"), (7, "c|1", "supports_chapters", 1, "ch-2"), (7, "c|1", "supports_chapters", 2, "ch-1")}
    assert {r[4] for r in out if r[1] == "c2"} >= {"a", "b"}


def test_depth_and_length_are_open(spark):
    deep = {"locator_text": "bottom"}
    for i in range(400):
        deep = {"n": [deep]} if i % 2 else {"n": deep}
    payload = json.dumps({"claim_id": "c", "source_spans": [{"doc_id": "d", "x": deep}, {"locator_text": "y" * 200_000}]})
    out = nested.claim_child_rows(spark.createDataFrame([(1, payload)], "record_id long, payload string")).collect()
    assert {(r["pos"], r["child_key"][:8]) for r in out} == {(0, "d|bottom"), (1, "|" + "y" * 7)}


def test_dewey_labels_give_back_the_tree(spark):
    value = {"a": [1, {"b": None}], "c": {"d": "x", "e": True}}
    df = spark.createDataFrame([("k", json.dumps(value), "clash")], "record_id string, payload string, dewey string")
    rows = {r["dewey"]: r for r in nested.shred(df, "record_id", "payload").collect()}
    assert len(rows) == 8
    for label, r in rows.items():
        if label:
            assert r["parent_dewey"] in rows and label.startswith(r["parent_dewey"])
    assert {(r["path"], r["value"]) for r in rows.values() if r["kind"] not in ("object", "array")} == {("$.a[]", "1"), ("$.a[].b", None), ("$.c.d", "x"), ("$.c.e", "true")}


# p3


def periods(spark, rows, bucket=10, tie=None):
    df = spark.createDataFrame(rows, "k string, us long, a string, b int, seq long")
    out = history.validity_periods(df, "k", "us", ["a", "b"], tie=tie, bucket_us=bucket).collect()
    return sorted((tuple(r) for r in out), key=lambda r: (r[0], r[3]))


def plain_periods(rows):
    best = {}
    for k, us, a, b, seq in rows:
        if k is not None and us is not None and ((k, us) not in best or best[k, us][0] < seq):
            best[k, us] = (seq, a, b)
    out = []
    for k in sorted({k for k, _ in best}):
        for us in sorted(u for q, u in best if q == k):
            _, a, b = best[k, us]
            if out and out[-1][0] == k and out[-1][1:3] == [a, b]:
                out[-1][5] += 1
            else:
                if out and out[-1][0] == k:
                    out[-1][4] = us
                out.append([k, a, b, us, None, 1])
    return [tuple(r) for r in out]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.one_of(st.none(), st.integers(-30, 60)), st.sampled_from(["p", "q", None]), st.sampled_from([1, None])), max_size=40))
def test_periods_match_a_plain_scan(spark, rows):
    rows = [(*r, i) for i, r in enumerate(rows)]
    assert periods(spark, rows, tie="seq") == plain_periods(rows)


def test_one_key_over_many_buckets(spark):
    rng = random.Random(5)
    rows = [("hot", i, rng.choice("ppppq"), 1, i) for i in range(600)]
    assert periods(spark, rows, bucket=7, tie="seq") == plain_periods(rows)


def test_periods_of_nothing(spark):
    assert periods(spark, []) == []


# p4


def test_snapshot_changes(spark):
    t = datetime
    rows = [
        ("s1", t(2025, 1, 1), t(2025, 1, 2), "A ", "x", 0.5), ("s1", t(2025, 1, 1), t(2025, 1, 2), "a", "X", 0.5000000001), ("s1", t(2025, 1, 1), t(2025, 1, 2), "b", None, None), ("s1", t(2025, 1, 1), t(2025, 1, 2), "c", "x", 0.1),
        ("s2", t(2025, 2, 1), t(2025, 2, 2), "a", "wrong", 9.0), ("s2", t(2025, 2, 1), t(2025, 2, 9), "a", " x", 0.5), ("s2", t(2025, 2, 1), t(2025, 2, 9), "b", None, 0.0), ("s2", t(2025, 2, 1), t(2025, 2, 9), "d", "x", None),
        ("s3", t(2025, 3, 1), t(2025, 3, 2), "d", "x", None), ("s3", t(2025, 3, 1), None, "z", "x", None), (None, t(2025, 3, 1), t(2025, 3, 2), "q", "x", None), ("s3", t(2025, 3, 1), t(2025, 3, 2), None, "x", None)]
    df = spark.createDataFrame(rows, "snapshot_id string, taken_at timestamp, delivered_at timestamp, claim_id string, status string, p double").withColumnRenamed("p", "p_posterior")
    df = df.selectExpr("*", "1 as s", "2 as k", "'clash' as h0")
    from pyspark.sql import functions as F

    from marlstone.functions.keys import norm_key, stable_double

    def run(x):
        out = snapshots.snapshot_changes(x, "snapshot_id", "taken_at", norm_key(F.col("claim_id")), [norm_key(F.col("status")), stable_double(F.col("p_posterior"))], "delivered_at")
        return {tuple(r) for r in out.collect()}

    assert run(df) == {("s2", "b", "changed"), ("s2", "c", "removed"), ("s2", "d", "added"), ("s3", "a", "removed"), ("s3", "b", "removed")}
    assert run(df.where("snapshot_id = 's1'")) == set()
    assert run(df.limit(0)) == set()


# p5

REGISTRY = [("m", "length", "m", 1.0, 0.0), ("mm", "length", "m", 0.001, 0.0), ("in", "length", "m", 0.0254, 0.0), ("g", "mass", "kg", 0.001, 0.0), ("kg", "mass", "kg", 1.0, 0.0),
            ("degC", "temperature", "degC", 1.0, 0.0), ("K", "temperature", "degC", 1.0, -273.15), ("cells", "count", "cells", 1.0, 0.0), ("mg/l", "concentration", "mg/l", 1.0, 0.0), ("mg", "mass", "kg", 1e-6, 0.0)]
CLAIM = "claim_id string, canonical_text string, measure string, dimension string, value double, unit string, canonical_unit string"


def quantities(spark, rows):
    reg = spark.createDataFrame(REGISTRY, "unit string, dimension string, canonical_unit string, scale_to_canonical double, offset_to_canonical double")
    out = units.canonical_quantities(spark.createDataFrame(rows, CLAIM), reg)
    return {r["claim_id"]: (r["canonical_unit"], r["canonical_value"], r["is_unique"]) for r in out.collect()}


@pytest.mark.parametrize("text,dim,want", [
    ("a tract of 34-mm. was probed", "length", "3.400e-02"), ("it measured 4,8 inches", "length", "1.219e-01"), ('of 2.5" wide', "length", "6.350e-02"), ("weighed 78,927grams", "mass", "7.893e+01"),
    ("weighed 53 274 g", "mass", "5.327e+01"), ("kept at minus 80 °C", "temperature", "-8.000e+01"), ("kept at −57 C", "temperature", "-5.700e+01"), ("at 198 K was required", "temperature", "-7.515e+01"),
    ("held 4.2E+08 cells", "count", "4.200e+08"), ("held 4.5×10⁶ cells", "count", "4.500e+06"), ("held 9 x 10^7 cells", "count", "9.000e+07"), ("620 million cells in one session", "count", "6.200e+08"),
    ("reduced to three g", "mass", "3.000e-03"), ("stood at 7 mg per litre", "concentration", "7.000e+00"), ("dose 7 mg per visit", "mass", "7.000e-06"), ("At centre 39, C-reactive protein", "temperature", None),
    ("18 finger breadths", "mass", None), ("in 2010 it was 5", "length", None), ("", "length", None), (None, "length", None), ("x" * 100_000 + " 3 mm", "length", "3.000e-03")])
def test_quantities_in_text(text, dim, want):
    reg = {}
    for u, d, c, s, o in REGISTRY:
        reg.setdefault(d, {})[u] = (c, s, o)
    found = units._candidates(text, None, None, dim, reg)
    assert (found[0]["shown"] if found else None) == want


def test_columns_decide_between_readings(spark):
    rows = [("a", "weighed 1,250 g", "mass_of", "mass", 1.25, "g", None), ("b", "weighed 1,250 g", "mass_of", "mass", 1250.0, "g", "kg"), ("c", "weighed 900 g", "mass_of", None, None, None, "kg"),
            ("d", "weighed the listed figure", "mass_of", None, 2.0, "kg", None), ("e", "weighed 5 things", "mass_of", None, 2.0, "odd", None), ("f", "weighed 3 kg", None, "mass", None, None, None), ("c", "weighed 900 g", "mass_of", None, None, None, "kg"),
            (None, "weighed 800 g", "mass_of", None, None, None, None)]
    got = quantities(spark, rows)
    assert got["a"] == ("kg", "1.250e-03", True) and got["b"] == ("kg", "1.250e+00", True) and got["c"][1] == "9.000e-01" and got["d"][1] == "2.000e+00"
    assert "e" not in got and "f" not in got and got[None][1] == "8.000e-01"
    assert quantities(spark, []) == {}


# p6


def sets(spark, pairs, per_task=hierarchy.SIBLINGS_PER_TASK):
    df = hierarchy.nested_sets(spark.createDataFrame(pairs, "node string, parent string"), per_task)
    return {r["node"]: r for r in df.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-2, 14), min_size=1, max_size=15))
def test_hierarchies_match_a_walk(spark, parents):
    pairs = [(f"n{i:02d}", None if p == -1 else "" if p == -2 else f"n{p:02d}") for i, p in enumerate(parents)]
    got = sets(spark, pairs, 2)
    want = brute.p6([{"node_id": a, "parent_id": b, "revised_at": 0} for a, b in pairs])
    assert {(k, r["root"], r["depth"]) for k, r in got.items()} == want
    parent = {a: b for a, b in pairs}
    for a, r in got.items():
        if r["depth"] < 0:
            continue
        under = [b for b, x in got.items() if x["root"] == r["root"] and r["lft"] < x["lft"] < r["rgt"]]
        true = []
        for b in got:
            x, steps = parent[b], 0
            while x and steps < 20:
                if x == a:
                    true.append(b)
                    break
                x, steps = parent.get(x), steps + 1
        assert sorted(under) == sorted(true) and r["n_descendants"] == len(true)


def test_long_chain_and_hot_parent(spark):
    chain = [("c0000", None)] + [(f"c{i:04d}", f"c{i - 1:04d}") for i in range(1, 600)]
    star = [("s", None)] + [(f"s{i:04d}", "s") for i in range(500)]
    got = sets(spark, chain + star, 20)
    assert got["c0599"]["depth"] == 599 and got["c0599"]["root"] == "c0000" and got["s"]["n_descendants"] == 500


def test_newest_revision_and_paths(spark):
    rows = [("a", None, 1), ("b", "zz", 1), ("b", "a", 2), ("b", "a", 2), ("c", "b", None), (None, "a", 3), ("d", "d", 1)]
    links = hierarchy.latest_links(spark.createDataFrame(rows, "n string, p string, t int"), "n", "p", "t")
    got = hierarchy.nested_sets(links)
    assert {r["node"]: r["path"] for r in hierarchy.node_paths(got).collect()} == {"a": "a", "b": "a/b", "c": "a/b/c"}
    assert next(r["depth"] for r in got.collect() if r["node"] == "d") == -1


def test_no_nodes(spark):
    assert sets(spark, []) == {}


# p7

ZONES = ["UTC", "Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo", "Europe/London"]
SPELL = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%d.%m.%Y %H:%M:%S", "%d %b %Y %H:%M:%S", "%B %d, %Y %I:%M:%S %p", "%d/%m/%Y %H:%M", "%Y-%m-%d"]


@settings(max_examples=300, deadline=None)
@given(st.datetimes(min_value=pd.Timestamp(2023, 1, 1).to_pydatetime(), max_value=pd.Timestamp(2027, 12, 31).to_pydatetime()), st.sampled_from(ZONES), st.sampled_from(SPELL))
def test_local_times_match_the_standard_library(when, zone, spelling):
    text = when.strftime(spelling)
    out = timestamps.to_utc_micros(pd.Series([text]), pd.Series([zone]), pd.Series([True], dtype=object), timestamps.abbreviations(ZONES))
    assert out[0] == brute.instant(text, zone, True)


@pytest.mark.parametrize("text", [None, "", " ", "2024-02-30", "2023-02-29 10:00:00", "31/11/2024 10:44", "99/99/2025 25:61", "0000-00-00 00:00:00", "2024-01-01 24:00:00", "2024-01-01 10:60:00", "2024-01-01 10:00:61", "13/13/2024",
                                  "1/1/2024 13:00 PM", "1/1/2024 0:30 AM", "2024-01-01 10:00:00 Mars/Olympus", "2024-01-01 10:00:00 XYZ", "2024-01-01Q10:00", "week 4 of 2025", "12", "9" * 30, "x" * 100_000, "2024-01-01T10:00+99:00"])
def test_texts_that_name_no_instant(text):
    out = timestamps.to_utc_micros(pd.Series([text]), pd.Series(["UTC"]), pd.Series([True], dtype=object), timestamps.abbreviations(ZONES))
    assert out[0] == timestamps.NONE


@pytest.mark.parametrize("text,zone,first,want", [
    ("2024-03-31 02:30:00", "Europe/Berlin", None, "2024-03-31 01:30:00"), ("2024-10-27 02:30:00", "Europe/Berlin", None, "2024-10-27 00:30:00"), ("2024-10-27 02:30:00 CET", "UTC", None, "2024-10-27 01:30:00"),
    ("2024-07-01 10:00:00+02:00[America/New_York]", "UTC", None, "2024-07-01 08:00:00"), ("05/06/2024 10:00", "UTC", None, None), ("25/06/2024 10:00", "UTC", None, "2024-06-25 10:00:00"), ("05.06.2024 10:00", "UTC", None, "2024-06-05 10:00:00"),
    ("1700000000", "Asia/Kolkata", None, "2023-11-14 22:13:20"), ("1700000000123456789", None, None, "2023-11-14 22:13:20.123456"), ("1700000000.5", None, None, "2023-11-14 22:13:20.5"), ("2024-01-01T00:00:00.1234567Z", None, None, "2024-01-01 00:00:00.123456")])
def test_known_instants(text, zone, first, want):
    out = timestamps.to_utc_micros(pd.Series([text]), pd.Series([zone]), pd.Series([first], dtype=object), timestamps.abbreviations(ZONES))
    assert (None if out[0] == timestamps.NONE else pd.Timestamp(out[0], unit="us")) == (None if want is None else pd.Timestamp(want))


def test_unknown_and_repeated_writers(spark):
    from pyspark.sql import functions as F

    writers = spark.createDataFrame([("w", "Asia/Kolkata", True), ("w", "Asia/Kolkata", True), (None, "Asia/Tokyo", None), ("z", None, None)], "writer string, zone_id string, day_first boolean")
    rows = spark.createDataFrame([(1, "2024-01-01 05:30:00", "w"), (2, "2024-01-01 00:00:00", None), (3, "2024-01-01 00:00:00", "new"), (4, None, "w"), (5, "2024-01-01 00:00:00", "z")], "id int, created_at string, writer string")
    got = {r["id"]: r["utc_us"] for r in timestamps.with_utc_micros(rows.withColumn("zone_id", F.lit("clash")), "created_at", F.col("writer"), writers).collect()}
    day = 1_704_067_200_000_000
    assert got == {1: day, 2: day, 3: day, 4: None, 5: day}
