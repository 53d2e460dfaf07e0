"""Plain Python versions of the general problems, written apart from the operators."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ABBR = {"CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "PST": -480, "PDT": -420, "GMT": 0, "BST": 60, "IST": 330,
        "AEST": 600, "AEDT": 660, "JST": 540, "UTC": 0}
FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y%m%d %H%M%S", "%d %b %Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S",
           "%B %d, %Y %I:%M %p", "%B %d, %Y %I:%M:%S %p", "%d.%m.%Y %H:%M", "%d.%m.%Y %H:%M:%S"]
DAY_FIRST = ["%d/%m/%Y %H:%M", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %I:%M %p", "%d/%m/%Y %I:%M:%S %p"]
MONTH_FIRST = ["%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %I:%M %p", "%m/%d/%Y %I:%M:%S %p"]


def norm(x):
    return None if x is None else x.strip(" \t\n\u00a0").lower()


def instant(text, zone, day_first):
    """UTC microseconds of a date text, or None."""
    if text is None:
        return None
    t = text.strip(" \t\n\u00a0")
    if re.fullmatch(r"\d+", t):
        for unit in (1, 10**3, 10**6, 10**9):
            if 2023 <= (EPOCH + timedelta(seconds=min(int(t) // unit, 10**11))).year <= 2027:
                return int(t) * 10**6 // unit
        return None
    offset = None
    if m := re.search(r"\[(.*)\]$", t):
        zone, t = m[1], t[: m.start()]
    if m := re.search(r" ?([+-])(\d\d):?(\d\d)$", t):
        offset = (int(m[2]) * 60 + int(m[3])) * (1 if m[1] == "+" else -1)
        t = t[: m.start()]
    elif re.search(r"\d[Zz]$", t):
        offset, t = 0, t[:-1]
    elif (m := re.search(r" ([A-Z]{3,4})$", t)) and m[1] in ABBR:
        offset, t = ABBR[m[1]], t[: m.start()]
    elif m := re.search(r" ([A-Z]\w+/\w+)$", t):
        zone, t = m[1], t[: m.start()]
    micros = 0
    if m := re.search(r"(:\d\d)[.,](\d+)$", t):
        micros, t = int((m[2] + "000000")[:6]), t[: m.start()] + m[1]
    t = re.sub(r"(\d)[Tt](\d)", r"\1 \2", t)
    for f in FORMATS + (DAY_FIRST if day_first else MONTH_FIRST if day_first is False else []):
        try:
            local = datetime.strptime(t, f)
        except ValueError:
            continue
        if offset is not None:
            utc = local.replace(tzinfo=timezone.utc) - timedelta(minutes=offset)
        else:
            utc = local.replace(tzinfo=ZoneInfo(zone or "UTC"), fold=0).astimezone(timezone.utc)
        return (utc - EPOCH) // timedelta(microseconds=1) + micros
    return None


def habits(writers):
    return {w["writer"]: (w["zone_id"], w["day_first"]) for w in writers}


def claim_instants(claims, writers):
    h = habits(writers)
    return [instant(c["created_at"], *h.get((c["generated_by_run"] or "").split("/")[0], (None, None))) for c in claims]


def counter_instants(counters, writers):
    h = habits(writers)
    return [instant(c["created_at"], *h.get((c["provenance"] or {}).get("generator"), (None, None))) for c in counters]


def p7(t):
    out = {("claims", str(c["ledger_seq"]), us) for c, us in zip(t["claims"], claim_instants(t["claims"], t["ledger_writers"])) if us is not None}
    return out | {("counter_claims", norm(c["id"]), us) for c, us in zip(t["counter_claims"], counter_instants(t["counter_claims"], t["ledger_writers"])) if us is not None}


def p3(t):
    at = defaultdict(dict)
    for c, us in zip(t["claims"], claim_instants(t["claims"], t["ledger_writers"])):
        if us is None or c["status"] is None:
            continue
        d = at[norm(c["claim_id"])]
        d[us] = max(d.get(us, (-1, "")), (c["ledger_seq"], norm(c["status"])))
    out = set()
    for k, d in at.items():
        last = None
        for us in sorted(d):
            if d[us][1] != last:
                last = d[us][1]
                out.add((k, last, us))
    return out


def p4(t):
    rows = t["claim_snapshots"]
    last = {}
    for r in rows:
        last[r["snapshot_id"]] = max(last.get(r["snapshot_id"], r["delivered_at"]), r["delivered_at"])
    state, taken = defaultdict(dict), {}
    for r in rows:
        if r["delivered_at"] == last[r["snapshot_id"]]:
            taken[r["snapshot_id"]] = r["taken_at"]
            p = r["p_posterior"]
            state[r["snapshot_id"]][norm(r["claim_id"])] = (norm(r["status"]), None if p is None else round(p, 6))
    order = sorted(taken, key=taken.get)
    out = set()
    for a, b in zip(order, order[1:]):
        for k in state[a].keys() | state[b].keys():
            if k not in state[a]:
                out.add((b, k, "added"))
            elif k not in state[b]:
                out.add((b, k, "removed"))
            elif state[a][k] != state[b][k]:
                out.add((b, k, "changed"))
    return out


def p6(rows):
    newest = {}
    for r in rows:
        k = norm(r["node_id"])
        if k not in newest or r["revised_at"] > newest[k][0]:
            newest[k] = (r["revised_at"], norm(r["parent_id"]))
    parent = {k: p if p in newest else None for k, (_, p) in newest.items()}
    out = set()
    for k in parent:
        path, x = [k], k
        while parent[x] is not None and parent[x] not in path:
            x = parent[x]
            path.append(x)
        if parent[x] is None:
            out.add((k, x, len(path) - 1))
        else:
            out.add((k, min(path[path.index(parent[x]):]), -1))
    return out


def p1(t):
    instants = {"claims": defaultdict(list), "counter_claims": defaultdict(list), "source_manifests": defaultdict(list)}
    refs = defaultdict(list)
    withdrawn = set()
    for c, us in zip(t["claims"], claim_instants(t["claims"], t["ledger_writers"])):
        k = norm(c["claim_id"])
        instants["claims"][k].append(us)
        for x in c["counter_claim_ids"] or []:
            refs["claims", k, "counter_claim_ids", norm(x)].append(us)
        for x in c["source_spans"] or []:
            refs["claims", k, "source_spans.doc_id", norm(x["doc_id"])].append(us)
    for c, us in zip(t["counter_claims"], counter_instants(t["counter_claims"], t["ledger_writers"])):
        k = norm(c["id"])
        instants["counter_claims"][k].append(us)
        refs["counter_claims", k, "target_claim_id", norm(c["target_claim_id"])].append(us)
    for s in t["source_manifests"]:
        instants["source_manifests"][norm(s["doc_id"])].append(instant(s["ingested_at"], "UTC", None))
        if s["withdrawn_at"]:
            withdrawn.add(norm(s["doc_id"]))
    stones = defaultdict(list)
    for s in t["tombstones"]:
        stones[s["target_table"], norm(s["target_key"])].append((s["deleted_at"].replace(tzinfo=timezone.utc) - EPOCH) // timedelta(microseconds=1))
    known = lambda xs: [x for x in xs if x is not None]
    out = set()
    for (table, key, field, target), us in refs.items():
        if target is None:
            continue
        to = {"target_claim_id": "claims", "counter_claim_ids": "counter_claims"}.get(field, "source_manifests")
        there = instants[to].get(target)
        if there is None:
            reason = "missing"
        elif target in withdrawn and to == "source_manifests" or any(not any(x > d for x in known(there)) for d in stones.get((to, target), [])):
            reason = "deleted"
        elif known(there) and known(us) and min(known(there)) > min(known(us)):
            reason = "late"
        else:
            continue
        out.add((table, key, field, target, reason))
    return out


def p2(rows):
    out = set()

    def spans(x, doc):
        if isinstance(x, str) and x.lstrip()[:1] in "[{" and x:
            x = json.loads(x)
        if isinstance(x, list):
            for y in x:
                yield from spans(y, doc)
        elif isinstance(x, dict):
            doc = x.get("doc_id", doc)
            for k, y in x.items():
                if k == "locator_text" and isinstance(y, str):
                    yield f"{doc or ''}|{y}"
                elif isinstance(y, (dict, list)):
                    yield from spans(y, doc)

    def chapters(x):
        if isinstance(x, str):
            yield from (y for y in re.split(r"[;,|\s]+", x) if y)
        for y in x if isinstance(x, list) else []:
            yield y["chapter_id"] if isinstance(y, dict) else y

    def claims(x):
        if isinstance(x, dict) and "claim_id" in x:
            yield x
        elif isinstance(x, (dict, list)):
            for y in x.values() if isinstance(x, dict) else x:
                yield from claims(y)

    for r in rows:
        try:
            value = json.loads((r["payload"] or "").lstrip("\ufeff"))
        except ValueError:
            continue
        for c in claims(value):
            for i, k in enumerate(spans(c.get("source_spans"), None)):
                out.add((r["record_id"], c["claim_id"], "source_spans", i, k))
            for i, k in enumerate(chapters(c.get("supports_chapters"))):
                out.add((r["record_id"], c["claim_id"], "supports_chapters", i, k))
    return out


#: number and unit at the place where the sentence of a measure states them
UNIT_WORDS = [(re.compile(p, re.I), u) for p, u in [
    (r"mm ?hg|torr|millimetres of mercury", "mmHg"), (r"cm ?h[2₂]o|centimetres of water", "cmH2O"), (r"psi|pounds per square inch", "psi"),
    (r"kpa|kilopascals", "kPa"), (r"pa|pascals", "Pa"), (r"mg/l|mg·l⁻¹|milligrams per litre", "mg/l"), (r"mg/dl|mg per dl", "mg/dl"),
    (r"(µg|μg|mcg)/ml", "ug/ml"), (r"g/l|grams per litre", "g/l"), (r"mm\.?|millimet(er|re)s", "mm"), (r"cm\.?|centimet(er|res)", "cm"),
    (r"m|met(re|ers)", "m"), (r"in|inch|inches|\"", "in"), (r"kg|kilos|kilograms", "kg"), (r"mgs?|milligrams", "mg"), (r"ug|µg|μg|mcg|micrograms", "ug"),
    (r"g|gm|grams", "g"), (r"lbs?|pounds", "lb"), (r"s|sec|seconds", "s"), (r"mins?|minutes", "min"), (r"h|hrs?|hours", "h"), (r"d|days|day\(s\)", "d"),
    (r"wks?|weeks", "wk"), (r"dl|decilitres", "dl"), (r"ml|cc|millilitres", "ml"), (r"ul|µl|μl|microlitres", "ul"), (r"l|lit(re|er)s", "l"),
    (r"cells", "cells"), (r"°f|f|degrees fahrenheit", "degF"), (r"°c|℃|c|degrees celsius", "degC"), (r"k|kelvin", "K")]]
WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def p5(rows, registry):
    reg = {r["unit"]: r for r in registry}
    out = set()
    for r in rows:
        if r["measure"] is None:
            continue
        found = None
        text = re.sub("[\u00a0\u202f\u2009]", " ", r["canonical_text"] or "")
        text = re.sub(r"^\| (.*) \|$", r"\1", text)
        text = re.sub(r"^(At centre \d+, |In the \w+ trial, |Among \d+ patients, |By \d{4}, |\(\w+, \d{4}\) )", "", text)
        text = re.sub(r"(, as \w+ also found|; n = \d+|, with a response rate of [\d.]+%| \(p = [\d.]+\))?\.?$", "", text)
        m = re.search(r"(minus |[-−])?\b(\d[\d ]*(?:[.,]\d+)?(?:[eE]\+?\d+)?|%s)( ?[x×] ?10(?:\^\d+|[⁰-⁹¹²³]+))?(.*)" % "|".join(sorted(WORDS, key=len, reverse=True)), text, re.I)
        if m:
            n = m[2].strip().lower()
            if n in WORDS:
                v = float(WORDS.index(n))
            elif re.fullmatch(r"\d{1,3},\d{3}", n) and not n.startswith("0"):
                v = float(n.replace(",", ""))
            else:
                v = float(n.replace(" ", "").replace(",", "."))
            if m[3]:
                v *= 10 ** int(re.sub(r".*10\^?", "", m[3]).translate(str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")))
            rest = m[4].lstrip(" -")
            if re.match(r"(million|mln|m)[ -]cells", rest, re.I):
                v, rest = v * 1e6, rest[rest.index("cells"):]
            rest = re.sub(r" (on imaging|was probed|of suspension.*|of the study drug|was given on admission|per visit|was recorded|was injected.*|in one session|was required)$", "", rest)
            u = next((u for p, u in UNIT_WORDS if p.fullmatch(rest)), None)
            if u:
                found = (v * (-1 if m[1] else 1), u)
        if found is None and r["value"] is not None and r["unit"]:
            t, k = re.sub("[\u00a0\u202f\u2009]", " ", r["unit"]).strip(), 1.0
            if m := re.match(r"(x?10\^6|million) (cells)$", t):
                t, k = m[2], 1e6
            u = next((u for p, u in UNIT_WORDS if p.fullmatch(t)), None)
            if u:
                found = (r["value"] * k, u)
        if found:
            x = reg[found[1]]
            out.add((norm(r["claim_id"]), x["canonical_unit"], f"{found[0] * x['scale_to_canonical'] + x['offset_to_canonical']:.3e}"))
    return out
