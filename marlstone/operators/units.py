"""Quantities stated in different units, in text or in columns, to canonical units.

A column whose unit is not written may be in any unit of its dimension. Physical identities among
the columns, such as mass equals density times volume, are sums of logarithms; every combination
of units gives each identity a residual, the combination of the least residual is taken, and rows
where others fit as well are flagged (reconcile_units).

canonical_quantities reads claims by the same rule. Their columns are the quantity in the text (every way
to read a number beside a word that means a unit), the value column (its unit, or any of the dimension) and
the usual size of the measure; the identities are that all three are one quantity, the usual size only
roughly.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of registered units, compared in lower case.
SPELLINGS = {
    "m": "m|metre|metres|meter|meters",
    "cm": "cm|cms|centimetre|centimetres|centimeter|centimeters",
    "mm": "mm|mms|millimetre|millimetres|millimeter|millimeters",
    "in": "in|inch|inches|\"|″|”",
    "kg": "kg|kgs|kilo|kilos|kilogram|kilograms|kilogramme|kilogrammes",
    "g": "g|gm|gms|gram|grams|gramme|grammes",
    "mg": "mg|mgs|mgm|milligram|milligrams|milligramme|milligrammes",
    "ug": "ug|µg|μg|mcg|mcgs|microgram|micrograms|microgramme|microgrammes",
    "lb": "lb|lbs|pound|pounds",
    "s": "s|sec|secs|second|seconds",
    "min": "min|mins|minute|minutes|minute(s)",
    "h": "h|hr|hrs|hour|hours|hour(s)",
    "d": "d|day|days|day(s)",
    "wk": "wk|wks|week|weeks|week(s)",
    "l": "l|ℓ|litre|litres|liter|liters",
    "dl": "dl|decilitre|decilitres|deciliter|deciliters",
    "ml": "ml|mls|cc|cm3|cm³|millilitre|millilitres|milliliter|milliliters",
    "ul": "ul|µl|μl|mcl|microlitre|microlitres|microliter|microliters",
    "cells": "cells|cell",
    "degC": "°c|℃|º c|ºc|° c|c|degc|deg c|degree celsius|degrees celsius|degrees centigrade|degrees c|celsius|centigrade",
    "degF": "°f|℉|º f|ºf|° f|f|degf|deg f|degree fahrenheit|degrees fahrenheit|degrees f|fahrenheit",
    "K": "k|kelvin|kelvins|degrees kelvin",
    "Pa": "pa|pascal|pascals",
    "kPa": "kpa|kilopascal|kilopascals",
    "mmHg": "mmhg|mm hg|mm of hg|torr|millimetre of mercury|millimetres of mercury|millimeters of mercury",
    "cmH2O": "cmh2o|cm h2o|cmh₂o|cm h₂o|cm of water|centimetre of water|centimetres of water|centimeters of water",
    "psi": "psi|pound per square inch|pounds per square inch|lb/in2|lbf/in²",
    "mg/l": "mg/l|mg·l⁻¹|mg l⁻¹|mg.l-1|mg per l|mg per litre|mg per liter|milligrams per litre|milligrams per liter|milligram per litre",
    "mg/dl": "mg/dl|mg·dl⁻¹|mg dl⁻¹|mg per dl|mg per decilitre|milligrams per decilitre|milligrams per deciliter",
    "ug/ml": "ug/ml|µg/ml|μg/ml|mcg/ml|µg·ml⁻¹|μg·ml⁻¹|ug per ml|µg per ml|μg per ml|mcg per ml|micrograms per millilitre|micrograms per milliliter",
    "g/l": "g/l|g·l⁻¹|g l⁻¹|g per l|g per litre|gram per litre|grams per litre|grams per liter",
}
#: Multiples that may stand before a unit of a count.
MULTIPLES = {"million": 1e6, "mio": 1e6, "mln": 1e6, "m": 1e6, "thousand": 1e3, "billion": 1e9}
#: English number words.
WORDS = {w: i for i, w in enumerate(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())
} | {w: 10 * (i + 3) for i, w in enumerate("thirty forty fifty sixty seventy eighty ninety hundred".split())}

_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_SPACE = " \u00a0\u2009\u202f\u2007"
_NUMBER = (
    rf"(?P<sign>(?<![\w.,])(?:minus[{_SPACE}]+|[-−–]))?"
    rf"(?<![\w.,])(?P<num>\d{{1,3}}(?:[{_SPACE}]\d{{3}})+(?![\d])(?:[.,]\d+)?|\d{{1,3}}(?:,\d{{3}}){{2,}}(?:\.\d+)?|\d+(?:[.,]\d+)*|"
    + "|".join(sorted(WORDS, key=len, reverse=True))
    + rf")(?:(?P<exp>[eE][+-]?\d+)|[{_SPACE}]*[x×·*][{_SPACE}]*10(?:\^(?P<pow>[-+]?\d+)|(?P<sup>[⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹]+)))?"
)


@lru_cache(maxsize=8)
def _unit_pattern(units: tuple[str, ...]) -> tuple[re.Pattern, dict[str, str]]:
    """Pattern of a number followed by a spelling of one of the units; spelling to unit."""
    of = {s: u for u in units for s in [*SPELLINGS.get(u, "").split("|"), u.lower()] if s}
    names = "|".join(re.escape(s).replace(r"\ ", rf"[{_SPACE}]+") for s in sorted(of, key=len, reverse=True))
    # multiples such as "million" stand before things that are counted only
    multiples = "|".join(sorted(MULTIPLES, key=len, reverse=True)) if "cells" in units else "(?!)"
    # a unit ends where no letter, digit or part of a compound unit follows
    end = rf"(?![\w°·⁻]|/\w|[{_SPACE}]+(?:per[{_SPACE}]+(?:square|litre|liter|l|dl|decilit|ml|millilit|kg|m2|m²)|of[{_SPACE}]+(?:water|mercury)))"
    return re.compile(rf"{_NUMBER}[{_SPACE}]*-?[{_SPACE}]*(?:(?P<mult>{multiples})[{_SPACE}-]+)?(?P<unit>{names}){end}", re.IGNORECASE), of


def readings(num: str) -> list[float]:
    """The values that a written number may mean; the likelier first.

    A comma before exactly three last digits may part thousands or decimals, any other single
    comma is a decimal sign; blanks part thousands.
    """
    word = WORDS.get(num.lower())
    if word is not None:
        return [float(word)]
    num = re.sub(rf"[{_SPACE}]", "", num)
    if "," not in num and num.count(".") <= 1:
        return [float(num)]
    if num.count(",") == 1 and "." not in num:
        whole, part = num.split(",")
        decimal = float(f"{whole}.{part}")
        return [float(whole + part), decimal] if len(part) == 3 and whole not in ("0", "") and len(whole) <= 3 else [decimal]
    last = max(num.rfind(","), num.rfind("."))
    mark = num[last]
    if num.count(mark) > 1:
        return [float(num.replace(",", "").replace(".", ""))]
    whole = num[:last].replace(",", "").replace(".", "")
    return [float(f"{whole}.{num[last + 1:]}")]


def unit_of(text: str | None, units: tuple[str, ...]) -> tuple[str, float] | None:
    """Registered unit and multiple of a unit column's text; None where it means none."""
    if not isinstance(text, str) or not text.strip():
        return None
    _, of = _unit_pattern(units)
    t = re.sub(rf"[{_SPACE}]+", " ", text.strip()).lower()
    for form in (t, t.rstrip(".")):
        if form in of:
            return of[form], 1.0
        m = re.fullmatch(r"(?:[x×] ?)?10(?:\^(\d+)|([⁰¹²³⁴⁵⁶⁷⁸⁹]+)) (.+)", form)
        if m and m[3] in of:
            return of[m[3]], 10.0 ** int(m[1] or m[2].translate(_SUPER))
        first, _, rest = form.partition(" ")
        if rest in of and first in MULTIPLES:
            return of[rest], MULTIPLES[first]
    return None


#: Log residual up to which two ways to read a quantity are one quantity.
SAME = 0.01
#: Combinations of units that one reconciliation may try.
MOST_COMBINATIONS = 100_000


def _registry(registry: DataFrame) -> dict[str, dict[str, tuple[str, float, float]]]:
    """Dimension to unit to (canonical unit, scale, offset); at most 10,000 units."""
    rows = registry.select("unit", "dimension", "canonical_unit", "scale_to_canonical", "offset_to_canonical").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 units in the registry")
    units: dict[str, dict[str, tuple[str, float, float]]] = {}
    for r in rows:
        if None not in (r[0], r[1], r[3]):
            units.setdefault(r[1], {})[r[0]] = (r[2], r[3], r[4] or 0.0)
    return units


def reconcile_units(df: DataFrame, key: str, quantities: dict[str, tuple[str, str | None, str]], identities: list[dict[str, int]], registry: DataFrame, same: float = SAME) -> DataFrame:
    """Units of columns by physical identities: key, residual, is_unique and, for each quantity, its unit and canonical value.

    quantities: name to (value column, unit column or None, dimension). identities: exponents by name whose
    product is 1 in canonical units, such as {"mass": 1, "density": -1, "volume": -1}. A written unit that means one of the
    dimension's is kept; any other stands for all of them. Of all combinations the one of the least sum of absolute
    log10 residuals is taken (of equal ones the first in the order of the registry's names); is_unique is false where a combination
    that gives other values comes within ``same`` of it, as where a missing value leaves identities out. Values that are null,
    zero or not finite have no canonical value; an identity over one of them is left out of the row. Rows are
    kept as they are, repeated ones too; an empty table gives an empty one. Result columns are named ``<name>_unit`` and ``<name>_value``;
    other columns of df are ignored.
    """
    units = _registry(registry)
    names = list(quantities)
    unknown = {n for i in identities for n in i} - set(names)
    if unknown:
        raise ValueError(f"identities name unknown quantities: {', '.join(sorted(unknown))}")
    choices = [sorted(units.get(quantities[n][2], {})) for n in names]
    total = int(np.prod([len(c) for c in choices], dtype=np.int64))
    if not total or total > MOST_COMBINATIONS:
        raise ValueError(f"{total} combinations of units")
    index = np.array(list(itertools.product(*[range(len(c)) for c in choices])), dtype=np.int64)
    scale = [np.array([units[quantities[n][2]][u][1] for u in c]) for n, c in zip(names, choices, strict=True)]
    offset = [np.array([units[quantities[n][2]][u][2] for u in c]) for n, c in zip(names, choices, strict=True)]
    exponents = np.array([[i.get(n, 0) for n in names] for i in identities], dtype=float).reshape(len(identities), len(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, max(1, len(b)), max(1, 2_000_000 // total)):
                yield solve(b.iloc[at: at + max(1, 2_000_000 // total)])

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        n = len(b)
        logs, allowed, canonical = [], np.ones((n, total), dtype=bool), []
        for q in range(len(names)):
            v = b[f"v{q}"].to_numpy(dtype=float, na_value=np.nan)
            c = v[:, None] * scale[q] + offset[q]
            with np.errstate(divide="ignore", invalid="ignore"):
                x = np.log10(np.abs(c))
            logs.append(np.where(np.isfinite(x), x, np.nan))
            canonical.append(c)
            spelled = {u: unit_of(u, tuple(choices[q])) for u in set(b[f"u{q}"].dropna())}
            own = np.array([choices[q].index(spelled[u][0]) if isinstance(u, str) and spelled.get(u) and spelled[u][1] == 1.0 else -1 for u in b[f"u{q}"]], dtype=np.int64)
            allowed &= (own[:, None] < 0) | (own[:, None] == index[None, :, q])
        residual = np.zeros((n, total))
        for e in exponents:
            one = np.zeros((n, total))
            for q in np.nonzero(e)[0]:
                one += e[q] * logs[q][:, index[:, q]]
            residual += np.where(np.isnan(one), 0.0, np.abs(one))
        residual = np.where(allowed, residual, np.inf)
        best = residual.argmin(axis=1)
        rows = np.arange(n)
        least = residual[rows, best]
        near = residual <= least[:, None] + same
        differs = np.zeros((n, total), dtype=bool)
        out = {"k": b["k"], "residual": least}
        for q, name in enumerate(names):
            mine = canonical[q][rows, index[best, q]]
            with np.errstate(invalid="ignore"):
                differs |= np.abs(canonical[q][:, index[:, q]] - mine[:, None]) > 1e-9 * np.abs(mine[:, None])
            known = ~np.isnan(logs[q][rows, index[best, q]])
            out[f"{name}_unit"] = np.where(known, np.array(choices[q], dtype=object)[index[best, q]], None)
            out[f"{name}_value"] = pd.Series(np.where(known, mine, np.nan), index=b.index)
        out["is_unique"] = ~(near & differs).any(axis=1)
        return pd.DataFrame(out)[["k", "residual", "is_unique", *[f"{x}_{y}" for x in names for y in ("unit", "value")]]]

    given = [F.col(key).alias("k")]
    for q, name in enumerate(names):
        value, unit, _ = quantities[name]
        given += [F.col(value).cast("double").alias(f"v{q}"), (F.col(unit).cast("string") if unit else F.lit(None).cast("string")).alias(f"u{q}")]
    made = ", ".join(f"`{n}_unit` string, `{n}_value` double" for n in names)
    out = df.select(*given).mapInPandas(run, f"k {df.schema[key].dataType.simpleString()}, residual double, is_unique boolean, {made}")
    return out.withColumnRenamed("k", key)


def _candidates(text: str | None, value: float | None, unit: str | None, dimension: str | None, registry: dict) -> list[dict]:
    """Readings of the text, and of the value column in its unit or, where that is not known, in each unit of the dimension (source any)."""
    units = registry.get(dimension)
    if not units:
        return []
    names = tuple(sorted(units))
    out: list[dict] = []

    def add(stated: float, u: str, source: str) -> None:
        canonical, scale, offset = units[u]
        v = stated * scale + offset
        out.append({"source": source, "stated": stated, "unit": u, "canonical_unit": canonical, "canonical": v, "shown": f"{v + 0.0:.3e}"})

    if isinstance(text, str):
        pattern, of = _unit_pattern(names)
        for m in pattern.finditer(text):
            u = of.get(re.sub(rf"[{_SPACE}]+", " ", m["unit"]).lower())
            power = 10.0 ** int(m["exp"][1:]) if m["exp"] else 10.0 ** int(m["pow"]) if m["pow"] else 10.0 ** int(m["sup"].translate(_SUPER)) if m["sup"] else 1.0
            factor = power * (MULTIPLES[m["mult"].lower()] if m["mult"] else 1.0) * (-1.0 if m["sign"] else 1.0)
            for r in readings(m["num"]):
                add(r * factor, u, "text")
    if value is not None and value == value:
        found = unit_of(unit, names)
        if found:
            add(float(value) * found[1], found[0], "column")
        elif out and not (isinstance(unit, str) and unit.strip()):
            for u in names:
                add(float(value), u, "any")
    return out


_SCHEMA = "array<struct<source string, stated double, unit string, canonical_unit string, canonical double, shown string>>"


def _magnitude(c: Column) -> Column:
    return F.log10(F.abs(c) + F.lit(1e-12))


def canonical_quantities(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """The quantity of each claim in the canonical unit of its dimension.

    claims: claim_id, canonical_text, measure, dimension, value, unit, canonical_unit; other columns
    are ignored. registry: one spelling per unit, fixed in size, gathered up to 10,000 rows.
    Rows without a measure, or whose quantity has no registered unit, give no row; identical rows
    count once; empty tables give an empty one. The dimension is the claim's, else that of its
    canonical unit, else the one most claims of the measure have.

    Returns claim_id, canonical_unit, canonical_value (``%.3e``), value (double), source,
    residual (log10, null if nothing decides), is_unique (false if another reading fits as well).
    """
    units = _registry(registry)
    base = claims.select("claim_id", "canonical_text", "measure", "dimension", "value", "unit", "canonical_unit").where("measure is not null").distinct()
    of_unit = registry.where("canonical_unit is not null").groupBy("canonical_unit").agg(F.min("dimension").alias("_by_unit"))
    base = base.join(of_unit, "canonical_unit", "left").withColumn("_dim", F.coalesce("dimension", "_by_unit"))
    usual = base.where("_dim is not null").groupBy("measure", "_dim").agg(F.count(F.lit(1)).alias("n")).groupBy("measure").agg(
        F.max_by("_dim", F.struct("n", "_dim")).alias("_usual"))
    base = base.join(usual, "measure", "left").withColumn("_dim", F.coalesce("_dim", "_usual"))

    @F.pandas_udf(_SCHEMA)
    def read(text: pd.Series, value: pd.Series, unit: pd.Series, dim: pd.Series) -> pd.Series:
        return pd.Series([_candidates(t, v, u, d, units) for t, v, u, d in zip(text, value, unit, dim, strict=True)], dtype=object)

    found = base.select("claim_id", "measure", read.asNondeterministic()("canonical_text", "value", "unit", "_dim").alias("every"))
    # what states the quantity, and what the value column may say in a unit it does not name
    found = found.select("claim_id", "measure", F.filter("every", lambda x: x["source"] != "any").alias("c"), F.filter("every", lambda x: x["source"] == "any").alias("open")).where(F.size("c") > 0)
    clear = F.size(F.array_distinct(F.transform("c", lambda x: x["shown"]))) == 1
    sizes = found.where(clear).groupBy("measure").agg(F.percentile_approx(_magnitude(F.col("c")[0]["canonical"]), 0.5).alias("_size"))
    found = found.join(sizes, "measure", "left")
    stated = F.filter("c", lambda x: x["source"] == "column")
    anchor = F.when(F.size(stated) > 0, _magnitude(stated[0]["canonical"])).otherwise(F.col("_size"))
    # residual of a reading against the value column in the unit that fits it best; readings it bears out come first
    against = lambda x: F.array_min(F.transform("open", lambda y: F.abs(_magnitude(x["canonical"]) - _magnitude(y["canonical"]))))
    scored = found.withColumn("_anchor", anchor).withColumn("c", F.transform("c", lambda x, i: F.struct(
        (~F.coalesce(against(x) <= SAME, F.lit(False))).alias("loose"), F.coalesce(F.abs(_magnitude(x["canonical"]) - F.col("_anchor")), F.lit(0.0)).alias("residual"), i.alias("i"),
        x["source"].alias("source"), x["canonical"].alias("value"), x["canonical_unit"].alias("canonical_unit"), x["shown"].alias("shown"))))
    best = F.array_min("c")
    out = scored.withColumn("b", best).withColumn("near", F.size(F.array_distinct(F.transform(
        F.filter("c", lambda x: (x["loose"] == F.col("b.loose")) & (x["residual"] <= F.col("b.residual") + SAME)), lambda x: x["shown"]))))
    return out.select(
        "claim_id", F.col("b.canonical_unit").alias("canonical_unit"), F.col("b.shown").alias("canonical_value"), F.col("b.value").alias("value"),
        F.col("b.source").alias("source"), F.when(F.col("_anchor").isNotNull(), F.col("b.residual")).alias("residual"), (F.col("near") == 1).alias("is_unique"))
