"""Units chosen by physical identities among columns, and of claims."""

import itertools
import math

import pytest

from marlstone.operators import units

REGISTRY = [
    ("kg", "mass", "kg", 1.0, 0.0), ("g", "mass", "kg", 0.001, 0.0), ("lb", "mass", "kg", 0.45359237, None),
    ("l", "volume", "l", 1.0, 0.0), ("ml", "volume", "l", 0.001, 0.0),
    ("kg/l", "density", "kg/l", 1.0, 0.0), ("g/l", "density", "kg/l", 0.001, 0.0), ("mg/l", "density", "kg/l", 1e-6, 0.0),
    ("K", "temperature", "K", 1.0, 0.0), ("degC", "temperature", "K", 1.0, 273.15), (None, "mass", "kg", 1.0, 0.0)]
QUANTITIES = {"mass": ("m", "mu", "mass"), "density": ("d", "du", "density"), "volume": ("v", None, "volume")}
LAW = [{"mass": 1, "density": -1, "volume": -1}]


@pytest.fixture
def registry(spark):
    return spark.createDataFrame(REGISTRY, "unit string, dimension string, canonical_unit string, scale_to_canonical double, offset_to_canonical double")


def run(spark, registry, rows, **k):
    df = spark.createDataFrame(rows, "id string, m double, mu string, d double, du string, v double, residual string")
    return {r["id"]: r for r in units.reconcile_units(df, "id", QUANTITIES, LAW, registry, **k).collect()}


def test_combination_of_least_residual(spark, registry):
    rows = [
        ("plain", 2.0, "kg", 0.8, "kg/l", 2.5, "x"), ("ml", 2.0, "kg", 0.8, "kg/l", 2500.0, None), ("no units", 1360.0, None, 13.6, None, 100.0, None),
        ("pounds", 3.0, "pounds", 1360.7771, "g/l", 1000.0, None), ("spelled", 2.0, " KG ", 800.0, "grams per litre", 2.5, None)]
    out = run(spark, registry, rows)
    got = {k: (r["mass_unit"], r["density_unit"], r["volume_unit"]) for k, r in out.items()}
    assert got["plain"] == ("kg", "kg/l", "l") and got["ml"] == ("kg", "kg/l", "ml") and got["pounds"] == ("lb", "g/l", "ml") and got["spelled"] == ("kg", "g/l", "l")
    assert out["ml"]["volume_value"] == pytest.approx(2.5) and out["plain"]["residual"] == pytest.approx(0, abs=1e-9) and out["plain"]["is_unique"]
    # grams against millilitres fit as well as kilograms against litres
    assert not out["no units"]["is_unique"] and out["no units"]["residual"] == pytest.approx(0, abs=1e-9)


def test_against_all_combinations(spark, registry):
    rows = [(f"r{i}", m, None, d, None, v, None) for i, (m, d, v) in enumerate(itertools.product((0.5, 37.0, 9100.0), (0.9, 640.0), (3.0, 770.0)))]
    out = run(spark, registry, rows, same=1e-6)
    of = {n: {u: s for u, dim, _, s, _ in REGISTRY if dim == n and u} for n in ("mass", "density", "volume")}
    for k, m, _, d, _, v, _ in rows:
        r = {(a, b, c): abs(math.log10(m * x) - math.log10(d * y) - math.log10(v * z)) for (a, x), (b, y), (c, z) in itertools.product(*[of[n].items() for n in ("mass", "density", "volume")])}
        least = min(r.values())
        assert out[k]["residual"] == pytest.approx(least, abs=1e-9)
        assert r[(out[k]["mass_unit"], out[k]["density_unit"], out[k]["volume_unit"])] == pytest.approx(least, abs=1e-9)
        assert out[k]["is_unique"] == (sum(x <= least + 1e-6 for x in r.values()) == 1)


def test_missing_values_and_edges(spark, registry):
    rows = [("null", None, "kg", 0.8, "kg/l", 2.5, None), ("zero", 0.0, "kg", 0.8, "kg/l", 2.5, None), ("nan", float("nan"), "kg", 0.8, "kg/l", 2.5, None), ("twice", 2.0, "kg", 0.8, "kg/l", 2.5, None), ("twice", 2.0, "kg", 0.8, "kg/l", 2.5, None), (None, 2.0, "stone", 0.8, "", 2.5, None)]
    out = run(spark, registry, rows)
    # without the mass no identity decides the volume's unit
    assert out["null"]["mass_unit"] is None and not out["null"]["is_unique"] and not out["zero"]["is_unique"] and not out["nan"]["is_unique"]
    assert not out[None]["is_unique"] and out[None]["residual"] == pytest.approx(0, abs=1e-9) and out["twice"]["is_unique"]
    assert run(spark, registry, []) == {}
    with pytest.raises(ValueError, match="unknown"):
        units.reconcile_units(registry, "unit", QUANTITIES, [{"length": 1}], registry)


def test_offsets_count(spark, registry):
    df = spark.createDataFrame([(1, 20.0, 293.15), (2, 5.0, 5.0)], "id int, a double, b double")
    q = {"a": ("a", None, "temperature"), "b": ("b", None, "temperature")}
    out = {r["id"]: r for r in units.reconcile_units(df, "id", q, [{"a": 1, "b": -1}], registry).collect()}
    assert (out[1]["a_unit"], out[1]["b_unit"], out[1]["a_value"], out[1]["is_unique"]) == ("degC", "K", 293.15, True)
    assert not out[2]["is_unique"]


def test_a_bare_value_bears_out_a_reading(spark):
    reg = spark.createDataFrame([("kg", "mass", "kg", 1.0, 0.0), ("g", "mass", "kg", 0.001, 0.0), ("ug", "mass", "kg", 1e-9, 0.0)], "unit string, dimension string, canonical_unit string, scale_to_canonical double, offset_to_canonical double")
    schema = "claim_id string, canonical_text string, measure string, dimension string, value double, unit string, canonical_unit string"
    usual = [(f"u{i}", "the dose was 3 g", "dose", "mass", None, None, None) for i in range(5)]
    rows = [("thousand", "the dose was 3,206 ug", "dose", "mass", 3206.0, None, None), ("decimal", "the dose was 3,206 ug", "dose", "mass", 3.206, None, None),
            ("alone", "in the table", "dose", "mass", 3.0, None, None), ("no measure", "3 g", None, "mass", 3.0, "g", None)]
    out = {r["claim_id"]: r["canonical_value"] for r in units.canonical_quantities(spark.createDataFrame(usual + rows, schema), reg).collect()}
    assert out["thousand"] == "3.206e-06" and out["decimal"] == "3.206e-09" and "alone" not in out and "no measure" not in out
