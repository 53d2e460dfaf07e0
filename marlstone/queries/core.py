"""Queries p1 to p7: the general problems over the claim tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.keys import norm_key, stable_double
from marlstone.operators import hierarchy, history, nested, references, snapshots, timestamps, units
from marlstone.queries.instants import CLAIMS_AT, COUNTERS_AT
from marlstone.sources.tables import table
from marlstone.storage import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def writer_of(run: Column) -> Column:
    """The writer in a run name such as ``writer/0042``."""
    return F.substring_index(run, "/", 1)


def _with_instants(spark: SparkSession, d: str, name: str, writer: Column) -> DataFrame:
    return timestamps.with_utc_micros(table(spark, d, name), "created_at", writer, table(spark, d, "ledger_writers"))


def claims_with_instants(spark: SparkSession, d: str) -> DataFrame:
    """The claim ledger with utc_us, the instant of created_at."""
    return _with_instants(spark, d, "claims", writer_of(F.col("generated_by_run")))


def counter_claims_with_instants(spark: SparkSession, d: str) -> DataFrame:
    return _with_instants(spark, d, "counter_claims", F.col("provenance.generator"))


# p1: references to records that do not exist


def _references_and_parents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One pass over each ledger gives both what it refers to and what it holds."""
    own = F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("target"))

    def refs_of(values: Column, field: str) -> Column:
        return F.transform(F.coalesce(values, F.array()), lambda x: F.struct(F.lit(field).alias("field"), norm_key(x).alias("target")))

    claims = claims_with_instants(spark, d).select(
        F.lit("claims").alias("ref_table"), norm_key(F.col("claim_id")).alias("ref_key"), "utc_us",
        F.explode(F.array_distinct(F.concat(
            F.array(own), refs_of(F.col("counter_claim_ids"), "counter_claim_ids"), refs_of(F.col("source_spans.doc_id"), "source_spans.doc_id")))).alias("r"))
    counters = counter_claims_with_instants(spark, d).select(
        F.lit("counter_claims").alias("ref_table"), norm_key(F.col("id")).alias("ref_key"), "utc_us",
        F.explode(F.array(own, F.struct(F.lit("target_claim_id").alias("field"), norm_key(F.col("target_claim_id")).alias("target")))).alias("r"))
    held = Scratch(spark, "references").keep(
        claims.unionByName(counters)
        .groupBy("ref_table", "ref_key", F.col("r.field").alias("ref_field"), F.col("r.target").alias("target_key"))
        .agg(F.min("utc_us").alias("first_us"), F.max("utc_us").alias("last_us"))
    )
    target = F.when(F.col("ref_field") == "target_claim_id", "claims").when(F.col("ref_field") == "counter_claim_ids", "counter_claims").otherwise("source_manifests")
    refs = held.where("ref_field <> '' and target_key is not null and ref_key is not null").select(
        "ref_table", "ref_key", "ref_field", target.alias("target_table"), "target_key", F.col("first_us").alias("ref_us"))
    stones = table(spark, d, "tombstones").groupBy(
        norm_key(F.col("target_table")).alias("target_table"), norm_key(F.col("target_key")).alias("target_key")
    ).agg(F.max(F.unix_micros("deleted_at")).alias("gone_us"))
    records = held.where("ref_field = '' and ref_key is not null").select(
        F.col("ref_table").alias("target_table"), F.col("ref_key").alias("target_key"), "first_us", "last_us"
    ).join(stones, ["target_table", "target_key"], "left").select(
        "target_table", "target_key", "first_us",
        (F.col("gone_us").isNotNull() & ~F.coalesce(F.col("last_us") > F.col("gone_us"), F.lit(False))).alias("gone"))
    manifests = table(spark, d, "source_manifests").select(
        norm_key(F.col("doc_id")).alias("target_key"), F.trim("withdrawn_at").alias("w"),
        timestamps.utc_micros(F.col("ingested_at"), F.lit("UTC"), F.lit(None).cast("boolean"), ["UTC"]).alias("us"))
    sources = manifests.where("target_key is not null").groupBy(F.lit("source_manifests").alias("target_table"), "target_key").agg(
        F.min("us").alias("first_us"), F.max(F.coalesce(F.col("w") != "", F.lit(False))).alias("gone"))
    return refs, records.unionByName(sources)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*_references_and_parents(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_key", "ref_field", "target_key", "reason")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


# p2: nested payloads to flat tables


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.claim_child_rows(table(spark, d, "raw_claims"))


def p2_claims(spark: SparkSession, d: str) -> DataFrame:
    return nested.claim_rows(table(spark, d, "raw_claims"))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes per schema path and kind, the catalogue of the tables a payload gives."""
    raw = table(spark, d, "raw_claims").select("record_id", "payload").distinct()
    return nested.shred(raw, "record_id", "payload", ("source_spans",)).groupBy("path", "kind").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("record_id").alias("n_records"))


def p2_spans(spark: SparkSession, d: str) -> DataFrame:
    """The table of the spans that stand in a list at the top of a payload, one of those grouped by schema path."""
    t = nested.flat_tables(table(spark, d, "raw_claims"), "record_id", "payload", ("source_spans",))["$.source_spans[]"]
    return t.select("record_id", "dewey", "owner_dewey", "doc_id", "locator_text", "page_index")


# p3: history of status


def _status_periods(spark: SparkSession, d: str) -> DataFrame:
    records = claims_with_instants(spark, d).select(
        norm_key(F.col("claim_id")).alias("claim_id"), norm_key(F.col("status")).alias("status"), "utc_us", "ledger_seq")
    return history.validity_periods(records.where("status is not null"), "claim_id", "utc_us", ["status"], tie="ledger_seq")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _status_periods(spark, d).select("claim_id", "status", F.col("valid_from").alias("valid_from_us"))


def p3_history(spark: SparkSession, d: str) -> DataFrame:
    return _status_periods(spark, d)


# p4: changes between snapshots


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(
        table(spark, d, "claim_snapshots"), "snapshot_id", "taken_at", norm_key(F.col("claim_id")),
        [norm_key(F.col("status")), stable_double(F.col("p_posterior"))], delivered="delivered_at",
    ).select("snapshot_id", F.col("key").alias("claim_id"), "change")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("snapshot_id", "change").agg(F.count(F.lit(1)).alias("n_claims"))


# p5: quantities


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    return units.canonical_quantities(table(spark, d, "claims_clean_crohns"), table(spark, d, "unit_registry"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _quantities(spark, d).select(norm_key(F.col("claim_id")).alias("claim_id"), "canonical_unit", "canonical_value").distinct()


def p5_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Quantities with their source, residual and whether another reading fits as well."""
    return _quantities(spark, d).select("claim_id", "canonical_unit", "canonical_value", "source", F.round("residual", 6).alias("residual"), "is_unique")


# p6: hierarchies


def _thesis_sets(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "thesis_nodes").select(
        norm_key(F.col("node_id")).alias("node_id"), norm_key(F.col("parent_id")).alias("parent_id"), "revised_at")
    return hierarchy.nested_sets(hierarchy.latest_links(nodes, "node_id", "parent_id", "revised_at"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _thesis_sets(spark, d).select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p6_nested_sets(spark: SparkSession, d: str) -> DataFrame:
    return _thesis_sets(spark, d)


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.node_paths(_thesis_sets(spark, d))


# p7: instants


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    claims = claims_with_instants(spark, d).select(
        F.lit("claims").alias("source_table"), F.col("ledger_seq").cast("string").alias("record_key"), "utc_us")
    counters = counter_claims_with_instants(spark, d).select(
        F.lit("counter_claims").alias("source_table"), norm_key(F.col("id")).alias("record_key"), "utc_us")
    return claims.unionByName(counters).where("utc_us is not null").distinct()


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_claims": p2_claims,
    "p2_nodes": p2_nodes,
    "p2_spans": p2_spans,
    "p3_found": p3_found,
    "p3_history": p3_history,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_quantities": p5_quantities,
    "p6_found": p6_found,
    "p6_nested_sets": p6_nested_sets,
    "p6_paths": p6_paths,
    "p7_found": p7_found,
}

_P4 = """d AS (SELECT snapshot_id, max(delivered_at) AS last_at FROM claim_snapshots GROUP BY 1),
s AS (SELECT DISTINCT c.snapshot_id, taken_at, lower(trim(claim_id)) AS claim_id, lower(trim(status)) AS status, round(p_posterior, 6) AS p FROM claim_snapshots c JOIN d ON c.snapshot_id = d.snapshot_id AND delivered_at = last_at),
n AS (SELECT snapshot_id, row_number() OVER (ORDER BY min(taken_at)) AS no FROM s GROUP BY 1), t AS (SELECT s.*, no FROM s JOIN n USING (snapshot_id)),
j AS (SELECT coalesce(b.no, a.no + 1) AS no, coalesce(b.claim_id, a.claim_id) AS claim_id, a.claim_id AS ca, b.claim_id AS cb, a.status AS sa, b.status AS sb, a.p AS pa, b.p AS pb FROM t a FULL JOIN t b ON b.no = a.no + 1 AND a.claim_id = b.claim_id),
ch AS (SELECT n.snapshot_id, claim_id, CASE WHEN ca IS NULL THEN 'added' WHEN cb IS NULL THEN 'removed' WHEN sa IS DISTINCT FROM sb OR pa IS DISTINCT FROM pb THEN 'changed' END AS change FROM j JOIN n USING (no) WHERE n.no > 1)"""
_P1 = f"""{CLAIMS_AT}, {COUNTERS_AT},
h AS (SELECT 'claims' AS ref_table, lower(trim(claim_id)) AS ref_key, us, 'counter_claim_ids' AS ref_field, 'counter_claims' AS tt, unnest(counter_claim_ids) AS x FROM ci_at
    UNION ALL SELECT 'claims', lower(trim(claim_id)), us, 'source_spans.doc_id', 'source_manifests', unnest(list_transform(source_spans, lambda y: y.doc_id)) FROM ci_at
    UNION ALL SELECT 'counter_claims', lower(trim(id)), us, 'target_claim_id', 'claims', target_claim_id FROM cj_at),
r AS (SELECT ref_table, ref_key, ref_field, tt, lower(trim(x)) AS target_key, min(us) AS us FROM h WHERE x IS NOT NULL AND ref_key IS NOT NULL GROUP BY ALL),
w AS (SELECT 'claims' AS tt, lower(trim(claim_id)) AS k, us FROM ci_at UNION ALL SELECT 'counter_claims', lower(trim(id)), us FROM cj_at),
g AS (SELECT lower(trim(target_table)) AS tt, lower(trim(target_key)) AS k, max(epoch_us(deleted_at)) AS gone FROM tombstones GROUP BY 1, 2),
t AS (SELECT w.tt, w.k, min(us) AS us, any_value(gone) IS NOT NULL AND NOT coalesce(max(us) > any_value(gone), false) AS gone FROM w LEFT JOIN g ON g.tt = w.tt AND g.k = w.k WHERE w.k IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT 'source_manifests', lower(trim(doc_id)), min(epoch_us(TRY_CAST(ingested_at AS TIMESTAMPTZ))), max(coalesce(trim(withdrawn_at), '') <> '') FROM source_manifests WHERE doc_id IS NOT NULL GROUP BY 2),
o AS (SELECT ref_table, ref_key, ref_field, target_key, r.us, CASE WHEN t.k IS NULL THEN 'missing' WHEN t.gone THEN 'deleted' WHEN t.us > r.us THEN 'late' END AS reason FROM r LEFT JOIN t ON t.tt = r.tt AND t.k = r.target_key)"""
_P3 = f"""{CLAIMS_AT}, r AS (SELECT lower(trim(claim_id)) AS claim_id, lower(trim(status)) AS status, us FROM ci_at WHERE status IS NOT NULL AND us IS NOT NULL AND claim_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY lower(trim(claim_id)), us ORDER BY ledger_seq DESC) = 1),
m AS (SELECT *, CASE WHEN status = lag(status) OVER (PARTITION BY claim_id ORDER BY us) THEN 0 ELSE 1 END AS new FROM r), i AS (SELECT *, sum(new) OVER (PARTITION BY claim_id ORDER BY us) AS island FROM m),
q AS (SELECT claim_id, status, CAST(min(us) AS BIGINT) AS valid_from, count(*) AS n_records FROM i GROUP BY claim_id, status, island)"""
_P2 = r"""raw AS (SELECT DISTINCT record_id, payload FROM raw_claims WHERE payload IS NOT NULL AND json_valid(ltrim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)))),
doc AS (SELECT record_id, row_number() OVER () AS no, CAST(ltrim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS JSON) AS j FROM raw),
n AS (SELECT record_id, no, t.key, t.type, t.value, t.atom, t.id, t.parent FROM doc, json_tree(doc.j) t),
cl AS (SELECT record_id, no, parent AS obj, json_extract_string(atom, '$') AS claim_id FROM n WHERE key = 'claim_id' AND type = 'VARCHAR'),
ow AS (SELECT cl.record_id, cl.no, cl.obj, claim_id, n.key AS child, n.id AS oid, n.type = 'VARCHAR' AS plain, json_extract_string(n.atom, '$') AS s, n.value AS v FROM cl JOIN n ON n.no = cl.no AND n.parent = cl.obj AND n.key IN ('source_spans', 'supports_chapters')),
ov AS (SELECT * EXCLUDE (v, plain), row_number() OVER () AS o, plain AND NOT (regexp_matches(s, '^\s*[\[{]') AND json_valid(s)) AS plain, CASE WHEN plain AND regexp_matches(s, '^\s*[\[{]') AND json_valid(s) THEN CAST(s AS JSON) ELSE v END AS v FROM ow),
x AS (SELECT ov.o, ov.record_id, claim_id, child, t.key, t.type, json_extract_string(t.atom, '$') AS text, t.id, t.parent, t.path, ov.plain FROM ov, json_tree(ov.v) t),
sp AS (SELECT l.o, l.record_id, l.claim_id, l.child, l.id, 0 AS sub, l.text, arg_max(d.text, length(d.path)) AS doc FROM x l LEFT JOIN x d ON d.o = l.o AND d.key = 'doc_id' AND d.type = 'VARCHAR' AND (l.path = d.path OR starts_with(l.path, d.path || '.') OR starts_with(l.path, d.path || '['))
    WHERE l.child = 'source_spans' AND l.key = 'locator_text' AND l.type = 'VARCHAR' GROUP BY ALL),
ch AS (SELECT o, record_id, claim_id, child, id, sub, k FROM (SELECT o, record_id, claim_id, child, id, unnest(list_filter(string_split_regex(text, '[;,|\s]+'), lambda y: y <> '')) AS k, generate_subscripts(list_filter(string_split_regex(text, '[;,|\s]+'), lambda y: y <> ''), 1) AS sub FROM x WHERE child = 'supports_chapters' AND plain)
    UNION ALL SELECT o, record_id, claim_id, child, id, 0, text FROM x WHERE child = 'supports_chapters' AND NOT plain AND type = 'VARCHAR' AND (key = 'chapter_id' OR path = '$' AND TRY_CAST(key AS INTEGER) IS NOT NULL)),
al AS (SELECT o, record_id, claim_id, child, id, sub, coalesce(doc, '') || '|' || text AS k FROM sp UNION ALL SELECT * FROM ch)"""
SQL: dict[str, str] = {
    "p1_found": f"WITH {_P1} SELECT ref_table, ref_key, ref_field, target_key, reason FROM o WHERE reason IS NOT NULL",
    "p1_report": f"WITH {_P1} SELECT ref_table, ref_field, strftime(make_timestamp(CAST(us AS BIGINT)), '%Y-%m') AS month, reason, count(*) AS n_references FROM o WHERE reason IS NOT NULL GROUP BY ALL",
    "p2_found": f"WITH {_P2} SELECT DISTINCT record_id, claim_id, child, CAST(row_number() OVER (PARTITION BY o ORDER BY id, sub) - 1 AS INTEGER) AS pos, k AS child_key FROM al",
    "p2_nodes": f"""WITH {_P2}, q AS (SELECT record_id, no, id, key, type, regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, atom, key IN ('source_spans') AND type = 'VARCHAR' AND regexp_matches(json_extract_string(atom, '$'), '^\\s*[\\[{{]') AND json_valid(json_extract_string(atom, '$')) AS inner_json FROM doc, json_tree(doc.j)),
        e AS (SELECT record_id, no, path AS base, CAST(json_extract_string(atom, '$') AS JSON) AS j FROM q WHERE inner_json), a AS (SELECT record_id, path, type FROM q WHERE NOT inner_json
            UNION ALL SELECT e.record_id, e.base || substr(regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g'), 2), t.type FROM e, json_tree(e.j) t)
        SELECT replace(path, '"', '') AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'VARCHAR' THEN 'text' ELSE 'number' END AS kind, count(*) AS n_nodes, count(DISTINCT record_id) AS n_records FROM a GROUP BY 1, 2""",
    "p3_found": f"WITH {_P3} SELECT claim_id, status, valid_from AS valid_from_us FROM q",
    "p3_history": f"WITH {_P3} SELECT claim_id, status, valid_from, lead(valid_from) OVER (PARTITION BY claim_id ORDER BY valid_from) AS valid_to, n_records FROM q",
    "p7_found": f"""WITH {CLAIMS_AT}, {COUNTERS_AT} SELECT 'claims' AS source_table, CAST(ledger_seq AS VARCHAR) AS record_key, CAST(us AS BIGINT) AS utc_us FROM ci_at WHERE us IS NOT NULL
        UNION SELECT 'counter_claims', lower(trim(id)), CAST(us AS BIGINT) FROM cj_at WHERE us IS NOT NULL""",
    "p4_found": f"WITH {_P4} SELECT * FROM ch WHERE change IS NOT NULL",
    "p4_counts": f"WITH {_P4} SELECT snapshot_id, change, count(*) AS n_claims FROM ch WHERE change IS NOT NULL GROUP BY 1, 2",
    "p6_paths": """WITH RECURSIVE n AS (SELECT lower(trim(node_id)) AS node, lower(trim(parent_id)) AS parent FROM thesis_nodes WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(node_id)) ORDER BY revised_at DESC) = 1),
        t AS (SELECT node, node AS path FROM n WHERE parent IS NULL OR parent NOT IN (SELECT node FROM n) UNION ALL SELECT n.node, t.path || '/' || n.node FROM n JOIN t ON n.parent = t.node) SELECT node, path FROM t""",
    "p6_found": """WITH RECURSIVE n AS (SELECT lower(trim(node_id)) AS node, lower(trim(parent_id)) AS parent FROM thesis_nodes WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(node_id)) ORDER BY revised_at DESC) = 1),
        l AS (SELECT node, CASE WHEN parent IN (SELECT node FROM n) THEN parent END AS parent FROM n),
        t AS (SELECT node, node AS root, 0 AS depth FROM l WHERE parent IS NULL UNION ALL SELECT l.node, t.root, t.depth + 1 FROM l JOIN t ON l.parent = t.node),
        c AS (SELECT node, parent FROM l WHERE node NOT IN (SELECT node FROM t)), w AS (SELECT node, parent AS pt FROM c UNION SELECT w.node, c.parent FROM w JOIN c ON c.node = w.pt),
        o AS (SELECT node FROM w WHERE node = pt), m AS (SELECT node, min(pt) AS root FROM w WHERE pt IN (SELECT node FROM o) GROUP BY node)
        SELECT node AS node_id, root AS root_id, CAST(depth AS INTEGER) AS depth FROM t UNION ALL SELECT node, root, -1 FROM m""",
}
