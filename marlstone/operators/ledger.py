"""Append-only ledgers: current state, transitions, supersession, projection to relations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.keys import norm_key
from marlstone.operators.ordered import lag_in_buckets
from marlstone.plans.catalog import GraphCatalog
from marlstone.storage import Scratch

#: Statuses a claim and a proof obligation may pass to.
CLAIM_TRANSITIONS = {
    "proposed": ("verified", "disputed", "superseded"),
    "verified": ("disputed", "superseded"),
    "disputed": ("verified", "superseded", "refuted"),
    "superseded": (),
    "refuted": (),
}
OBLIGATION_TRANSITIONS = {"pending": ("discharged", "refuted", "waived"), "discharged": (), "refuted": (), "waived": ()}
#: Prior belief by status.
PRIOR_BY_STATUS = {"verified": 0.70, "proposed": 0.50, "disputed": 0.20, "refuted": 0.05, "superseded": 0.50}
#: Pairs of opposed words.
ANTONYMS = (("allowed", "forbidden"), ("mandatory", "optional"), ("required", "not required"), ("supported", "unsupported"),
            ("present", "absent"), ("succeed", "fail"), ("possible", "impossible"), ("safe", "unsafe"))
#: Joins the parts of a made key.
SEP = "\u001f"


def latest_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key by the order columns; of equal rows one. Rows with a null key are left out.

    An aggregate with a map-side part, so a key that holds a third of all rows shuffles as one
    row per task.
    """
    rest = [c for c in df.columns if c != key]
    top = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order], F.xxhash64(*rest)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(top.alias("_row")).select(key, "_row.*").select(*df.columns)


def prior_for_status(status: Column) -> Column:
    """Prior of a status, null for an unknown one."""
    out = F.lit(None).cast("double")
    for s, p in PRIOR_BY_STATUS.items():
        out = F.when(status == s, F.lit(p)).otherwise(out)
    return out


def transitions(df: DataFrame, key: str, status: str, order: str, width: int = 1_000_000) -> DataFrame:
    """key, from_status, to_status, n of every change of status along each key's order (a number).

    A key's order is read in buckets of ``width``, see lag_in_buckets.
    """
    rows = lag_in_buckets(df, key, order, [status], width)
    rows = rows.withColumn("from_status", F.col("before")[status]).where(F.col("from_status") != F.col(status))
    return rows.groupBy(key, "from_status", F.col(status).alias("to_status")).agg(F.count(F.lit(1)).alias("n"))


def check_transitions(df: DataFrame, frm: str, to: str, allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """df with is_allowed: whether the state machine lets ``frm`` pass to ``to``; unknown states do not."""
    allowed = CLAIM_TRANSITIONS if allowed is None else allowed
    pairs = [f"{a}{SEP}{b}" for a, bs in allowed.items() for b in bs]
    return df.withColumn("is_allowed", F.coalesce(F.concat_ws(SEP, frm, to).isin(pairs) & F.col(frm).isNotNull() & F.col(to).isNotNull(), F.lit(False)))


def next_ids(df: DataFrame, existing: DataFrame, key: str, prefix: str, width: int = 6) -> DataFrame:
    """df with a new id: prefix and the numbers after the highest existing one, in the order of all columns.

    Numbers are given by range: rows are counted per sorted partition, and each partition starts
    where the ones before it end, so no task orders the whole table.
    """
    top = existing.where(F.col(key).startswith(prefix)).agg(F.max(F.regexp_extract(key, rf"^{re.escape(prefix)}(\d+)$", 1).try_cast("long"))).first()[0] or 0
    scratch = Scratch(df.sparkSession, "ids")
    part = scratch.keep(df.repartitionByRange(*df.columns).sortWithinPartitions(*df.columns).withColumn("_m", F.monotonically_increasing_id()))
    part = part.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(sizes, "_p").select(
        F.format_string(f"{prefix}%0{width}d", F.col("_before") + F.col("_i") + 1 + top).alias("new_id"), *df.columns)


def supersession_alerts(claims: DataFrame) -> DataFrame:
    """claim_id, target, kind (missing-target, cycle, target-still-current) of bad supersedes links.

    claims: claim_id, status, supersedes; one row per claim. The first kind that holds counts. A
    claim whose chain runs into a circle is in a cycle; chains are followed by pointer doubling.
    """
    scratch = Scratch(claims.sparkSession, "supersession")
    base = scratch.keep(claims.select("claim_id", "status", F.col("supersedes").alias("target")))
    known = base.select(F.col("claim_id").alias("target"), F.col("status").alias("target_status"))
    links = base.where("target is not null and target <> ''").join(known.withColumn("_there", F.lit(1)), "target", "left")
    live = scratch.keep(links.where("_there = 1").select("claim_id", F.col("target").alias("at")))
    n = before = live.count()
    steps = 1
    while before and steps <= 2 * n:  # who can still take 2^k steps; more steps than claims means a circle
        hop = live.select(F.col("claim_id").alias("at"), F.col("at").alias("at2"))
        nxt = scratch.keep(live.join(hop, "at").select("claim_id", F.col("at2").alias("at")))
        scratch.drop(live)
        live, steps = nxt, steps * 2
        before = live.count()
    out = links.join(live.select("claim_id", F.lit(1).alias("_circle")), "claim_id", "left")
    kind = (
        F.when(F.col("_there").isNull(), "missing-target").when(F.col("_circle") == 1, "cycle")
        .when(~F.col("target_status").eqNullSafe(F.lit("superseded")), "target-still-current"))
    return out.select("claim_id", "target", kind.alias("kind")).where("kind is not null")


def query_claims(claims: DataFrame, states: list[str] | None = None, sources: list[str] | None = None,
                 tags: list[str] | None = None, topics: list[str] | None = None) -> DataFrame:
    """Current claims by filter. Refuted claims are hidden.

    states: statuses; sources: doc_id of the first span; tags: semantic class; topics: any of them as
    a part of the text, whatever the case. An absent filter lets all pass.
    """
    df = claims.where(F.col("status").isin("proposed", "verified", "disputed", "superseded"))
    if states:
        df = df.where(F.col("status").isin(states))
    if sources:
        df = df.where(F.try_element_at("source_spans", F.lit(1))["doc_id"].isin(sources))
    if tags:
        df = df.where(F.col("semantic_class").isin(tags))
    if topics:
        text = F.lower("canonical_text")
        df = df.where(F.exists(F.array(*[F.lit(t.lower()) for t in topics]), lambda t: F.contains(text, t)))
    return df


def chapter_slice(claims: DataFrame, chapter: str, accept_disputed: list[str] = (), force_refuted: list[str] = ()) -> DataFrame:
    """Current claims that support a chapter: superseded ones out, disputed and refuted ones only if named."""
    ok = (
        F.col("status").isin("proposed", "verified")
        | ((F.col("status") == "disputed") & F.col("claim_id").isin(list(accept_disputed)))
        | ((F.col("status") == "refuted") & F.col("claim_id").isin(list(force_refuted))))
    return claims.where(F.array_contains("supports_chapters", chapter) & ok)


def antonym_conflicts(claims: DataFrame, pairs: tuple[tuple[str, str], ...] = ANTONYMS) -> DataFrame:
    """pair, word, claim_a, claim_b, n_a, n_b: opposed verified claims, by classes.

    Two claims conflict if they share a word of four letters or more and one holds a word whose opposite the
    other holds (as a part of the text). A row stands for all conflicts over one pair of opposites and one shared word:
    n_a claims that hold the word and the first opposite, n_b that hold it and the second, the smallest ids of
    each. So a word that a third of the claims share gives one row per pair and not the square of its claims; both
    sides are summed before they meet. antonym_members tells the claims of each class. A side whose only claim is also
    the other's gives no row.
    """
    sides = antonym_members(claims, pairs).groupBy("pair", "side", "word").agg(
        F.min("claim_id").alias("claim"), F.max("claim_id").alias("last"), F.count_distinct("claim_id").alias("n"))
    of = lambda s, x: sides.where(F.col("side") == s).select("pair", "word", *[F.col(c).alias(f"{c}_{x}") for c in ("claim", "last", "n")])
    hit = of("first", "a").join(of("second", "b"), ["pair", "word"])
    one = (F.col("claim_a") == F.col("last_a")) & (F.col("claim_b") == F.col("last_b")) & (F.col("claim_a") == F.col("claim_b"))
    return hit.where(~one).select("pair", "word", "claim_a", "claim_b", "n_a", "n_b")


def antonym_members(claims: DataFrame, pairs: tuple[tuple[str, str], ...] = ANTONYMS) -> DataFrame:
    """pair, side (first, second), word, claim_id: verified claims by the half of a pair they hold and each word of four letters or more."""
    text = F.lower("canonical_text")
    arms = F.array_compact(F.array(*[
        F.when(F.contains(text, F.lit(w)), F.struct(F.lit("/".join(p)).alias("pair"), F.lit(s).alias("side")))
        for p in pairs for w, s in zip(p, ("first", "second"), strict=True)]))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z]{4,})"), 1))
    armed = claims.where("status = 'verified' and canonical_text is not null").select("claim_id", F.explode(arms).alias("arm"), words.alias("words"))
    return armed.select("arm.pair", "arm.side", F.explode("words").alias("word"), "claim_id").distinct()


#: Spelled units of normal forms, with dimension, canonical unit and factor.
NORMAL_UNITS = {
    "m": ("length", "m", 1.0),
    "meter": ("length", "m", 1.0),
    "meters": ("length", "m", 1.0),
    "metre": ("length", "m", 1.0),
    "metres": ("length", "m", 1.0),
    "cm": ("length", "m", 0.01),
    "centimeter": ("length", "m", 0.01),
    "centimeters": ("length", "m", 0.01),
    "km": ("length", "m", 1000.0),
    "kilometer": ("length", "m", 1000.0),
    "kilometers": ("length", "m", 1000.0),
    "mi": ("length", "m", 1609.344),
    "mile": ("length", "m", 1609.344),
    "miles": ("length", "m", 1609.344),
    "g": ("mass", "kg", 0.001),
    "gram": ("mass", "kg", 0.001),
    "grams": ("mass", "kg", 0.001),
    "kg": ("mass", "kg", 1.0),
    "kilogram": ("mass", "kg", 1.0),
    "kilograms": ("mass", "kg", 1.0),
    "s": ("time", "s", 1.0),
    "second": ("time", "s", 1.0),
    "seconds": ("time", "s", 1.0),
    "min": ("time", "s", 60.0),
    "minute": ("time", "s", 60.0),
    "minutes": ("time", "s", 60.0),
    "h": ("time", "s", 3600.0),
    "hour": ("time", "s", 3600.0),
    "hours": ("time", "s", 3600.0),
}
#: The sentence forms that normal forms are read from.
_SUBJECT = r"^\s*([a-z0-9][a-z0-9 -]*?)\s+"
QUANTITY_FORM = (
    r"(?i)" + _SUBJECT + r"(length|distance|height|depth|mass|weight|duration)\s+(?:is|was|equals|=)\s+([0-9]+(?:\.[0-9]+)?)\s*("
    + "|".join(sorted(NORMAL_UNITS, key=len, reverse=True)) + r")(?:\s+from\s+([0-9]{4})\s+to\s+([0-9]{4})\s+requires\s+(overlap|disjoint))?\s*\.?\s*$")
INTERVAL_FORM = (
    r"(?i)" + _SUBJECT + r"(active|valid|available|occupation|period)\s+from\s+([0-9]{4})\s+to\s+([0-9]{4})\s+requires\s+(overlap|disjoint)\s*\.?\s*$")


def normal_forms(claims: DataFrame) -> dict[str, DataFrame]:
    """Relations claim-quantity, claim-unit, claim-time-interval and claim-normal-form read from the texts.

    claims: claim_id, canonical_text. A text that states "<subject> length is 5 km" or "<subject>
    active from 1990 to 1999 requires overlap" gives rows; others, and intervals that end before
    they start, give none.
    """
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    part = lambda form, i: F.regexp_extract(F.coalesce("canonical_text", F.lit("")), form, i)
    units = F.create_map(*[x for u, (d, c, s) in NORMAL_UNITS.items() for x in (F.lit(u), F.struct(F.lit(d).alias("d"), F.lit(c).alias("c"), F.lit(s).alias("s")))])
    q = claims.where(F.col("canonical_text").rlike(QUANTITY_FORM)).select(
        "claim_id", key(part(QUANTITY_FORM, 1)).alias("subject"), key(part(QUANTITY_FORM, 2)).alias("predicate"), part(QUANTITY_FORM, 3).cast("double").alias("value"),
        key(part(QUANTITY_FORM, 4)).alias("unit"), F.expr(f"try_cast(regexp_extract(canonical_text, r'{QUANTITY_FORM}', 5) as bigint)").alias("start"),
        F.expr(f"try_cast(regexp_extract(canonical_text, r'{QUANTITY_FORM}', 6) as bigint)").alias("end"), key(part(QUANTITY_FORM, 7)).alias("required_relation"),
    ).withColumn("u", units[F.col("unit")])
    i = claims.where(F.col("canonical_text").rlike(INTERVAL_FORM)).select(
        "claim_id", key(part(INTERVAL_FORM, 1)).alias("subject"), key(part(INTERVAL_FORM, 2)).alias("predicate"), part(INTERVAL_FORM, 3).cast("long").alias("start"),
        part(INTERVAL_FORM, 4).cast("long").alias("end"), key(part(INTERVAL_FORM, 5)).alias("required_relation")).where(F.col("start") <= F.col("end"))
    made = lambda what: F.concat_ws(SEP, "claim_id", F.lit(what))
    canonical = F.col("value") * F.col("u.s")
    spans = ["claim_id", "subject", "predicate", "start", "end", "required_relation"]
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", canonical), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return {
        "claim-quantity": q.select(made("quantity").alias("id"), "claim_id", "value", "unit", canonical.alias("canonical_value"), F.col("u.c").alias("canonical_unit"), F.col("u.d").alias("dimension")),
        "claim-unit": q.select(made("unit").alias("id"), "claim_id", "unit", F.col("u.c").alias("canonical_unit"), F.col("u.d").alias("dimension"), F.col("u.s").alias("scale_to_canonical")),
        "claim-time-interval": q.where("start <= end").select(made("time").alias("id"), *spans).unionByName(i.select(made("time").alias("id"), *spans)),
        "claim-normal-form": q.select(
            made("normal").alias("id"), "claim_id", "subject", "predicate", F.concat_ws(" ", number, "u.c").alias("object"),
            made("quantity").alias("quantity_id"), F.when(F.col("start").isNotNull(), made("time")).alias("time_interval_id"),
        ).unionByName(i.select(made("normal").alias("id"), "claim_id", "subject", "predicate", F.concat_ws("-", "start", "end").alias("object"),
                               F.lit(None).cast("string").alias("quantity_id"), made("time").alias("time_interval_id"))),
    }


def project(catalog: GraphCatalog, claims: DataFrame, counter_claims: DataFrame | None = None, sources: DataFrame | None = None) -> GraphCatalog:
    """Set the claim relations of a catalogue from current claims, counter-claims and manifests.

    Superseded claims are left out with their spans, chapters and conflicts; null elements of the
    lists are left out. Keys are put in one spelling.
    """
    kept = claims.where(~F.col("status").eqNullSafe(F.lit("superseded")))
    catalog.put("claim", kept.withColumnRenamed("claim_id", "id"))
    spans = kept.select("claim_id", F.posexplode("source_spans").alias("pos", "s")).where("s is not null")
    catalog.put("source-span", spans.select(
        F.concat_ws(SEP, "claim_id", "pos").alias("id"), "claim_id", norm_key(F.col("s.doc_id")).alias("doc_id"), "s.node_id", "s.page_index", "s.locator_text",
        norm_key(F.col("s.doc_id")).alias("wiki_page_id")))

    def listed(column: str, name: str) -> DataFrame:
        rows = kept.select("claim_id", F.explode(F.array_distinct(F.transform(column, norm_key))).alias(name)).where(F.col(name).isNotNull())
        return rows.withColumn("id", F.concat_ws(SEP, "claim_id", name))

    chapters = listed("supports_chapters", "chapter")
    catalog.put("claim-chapter", chapters).put("chapter", chapters.select(F.col("chapter").alias("id")).distinct())
    catalog.put("claim-conflict", listed("conflicts_with", "other_id"))
    catalog.put("claim-implies", listed("derived_from", "parent").select(
        F.concat_ws(SEP, "parent", "claim_id").alias("id"), F.col("parent").alias("claim_id"), F.col("claim_id").alias("target_id")))
    if counter_claims is not None:
        catalog.put("counter-claim", counter_claims.select("id", F.col("id").alias("cc_id"), "target_claim_id", F.col("status").alias("cc_status"), "created_at"))
    if sources is not None:
        catalog.put("source", sources.select(F.col("doc_id").alias("id"), "ingested_at", F.col("doc_name").alias("title"), "trust"))
        catalog.put("wiki-page", sources.select(F.col("doc_id").alias("id"), F.col("doc_name").alias("title")))
    return catalog
