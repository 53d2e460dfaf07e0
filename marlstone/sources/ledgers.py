"""Ledgers as files: JSON lines with damaged rows set aside, append-only sinks, snapshots, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marlstone.functions.keys import norm_key

#: The shapes of the ledgers.
CLAIM = """claim_id string, canonical_text string, status string, claim_type string, semantic_class string, confidence double, p_prior double, p_posterior double,
load_bearing boolean, axiom boolean, pin_low_confidence boolean, counter_claim_ids array<string>,
source_spans array<struct<doc_id: string, node_id: string, page_index: int, locator_text: string>>, derived_from array<string>, supports_chapters array<string>,
conflicts_with array<string>, supersedes string, created_at string, last_verified_at string, generated_by_run string, review_notes string"""
COUNTER_CLAIM = "id string, target_claim_id string, text string, disagreement_vector string, status string, provenance struct<generator: string, prompt_sha256: string>, created_at string, addressed_in_chapter string"
EVENT = "timestamp string, claim_id string, `from` string, `to` string, cause_ticket_id string, cause_class string, operator string"
MANIFEST = "doc_id string, doc_name string, source_kind string, sha256 string, byte_size long, ingested_at string, ingested_by_run string, page_count int, node_count int, tree_root string, trust double"


def read_jsonl(spark: SparkSession, path: str, schema: str, damaged: bool = False) -> DataFrame:
    """Rows of JSON lines with _seq, their order within and over the files; blank and damaged lines left out.

    With ``damaged`` the left-out lines are given instead (line). The order is the file's path, then the
    place in it.
    """
    want = spark.createDataFrame([], schema).schema
    full = StructType([*want.fields, StructField("_corrupt_record", StringType())])
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).alias("_seq")).where(F.trim("line") != "")
    rows = lines.withColumn("r", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    if damaged:
        return rows.where("r._corrupt_record is not null").select("line")
    return rows.where("r._corrupt_record is null").select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in want.fields], "_seq")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows to a folder of JSON lines; the commit is atomic per file."""
    df.write.mode("append").json(path)


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per JSON manifest file of a folder; a missing trust is 1.0, files without a doc_id are left out."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.where("doc_id is not null").withColumn("trust", F.coalesce("trust", F.lit(1.0)))


def write_snapshot(df: DataFrame, folder: str, stamp: str) -> str:
    """Copy a table to folder/stamp and give the path; an existing stamp is an error."""
    path = f"{folder.rstrip('/')}/{stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path


def validate_claims(claims: DataFrame) -> DataFrame:
    """claim_id, problem: claims without a required field, with an unknown status or type, or a confidence outside [0, 1]."""
    need = ["canonical_text", "status", "claim_type", "confidence", "created_at"]
    problems = F.array_compact(F.array(
        *[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in need],
        F.when(~norm_key(F.col("status")).isin("proposed", "verified", "disputed", "superseded", "refuted"), F.lit("unknown status")),
        F.when(~F.col("claim_type").isin("fact", "definition", "design_decision", "method", "result", "open_question"), F.lit("unknown claim_type")),
        F.when(~F.col("confidence").between(0, 1), F.lit("confidence outside [0, 1]"))))
    return claims.select("claim_id", F.explode(problems).alias("problem"))


def event_trace(claims: DataFrame, counters: DataFrame, events: DataFrame) -> DataFrame:
    """at_us, kind, id, payload (JSON) of claims, counter-claims and status changes, to be ordered by (at_us, kind, id).

    claims: claim_id, status, utc_us. counters: id, target_claim_id, status, utc_us. events: claim_id, from, to, utc_us.
    Rows without an instant are left out.
    """
    one = lambda df, kind, key, *cols: df.where("utc_us is not null").select(F.col("utc_us").alias("at_us"), F.lit(kind).alias("kind"), F.col(key).alias("id"), F.to_json(F.struct(*cols)).alias("payload"))
    return one(claims, "claim", "claim_id", "status").unionByName(one(counters, "counter-claim", "id", "target_claim_id", "status")).unionByName(one(events, "transition", "claim_id", F.col("from"), F.col("to")))


def trace_to_ledger(trace: DataFrame) -> DataFrame:
    """claim_id, status, utc_us rows of a trace's claims and transitions, the way a ledger would hold them."""
    c = trace.where("kind = 'claim'").select(F.col("id").alias("claim_id"), F.get_json_object("payload", "$.status").alias("status"), F.col("at_us").alias("utc_us"))
    t = trace.where("kind = 'transition'").select(F.col("id").alias("claim_id"), F.get_json_object("payload", "$.to").alias("status"), F.col("at_us").alias("utc_us"))
    return c.unionByName(t)


def not_ingested(found: DataFrame, manifests: DataFrame) -> DataFrame:
    """Files of found (sha256, ...) whose hash no manifest has."""
    return found.join(manifests.select("sha256").where("sha256 is not null").distinct(), "sha256", "left_anti")


def verify_locators(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """claim_id, doc_id, found, is_thin: whether each locator text stands in its source, blanks collapsed and case ignored; thin sources have fewer than 250 characters."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    j = spans.where("locator_text is not null").join(sources.select("doc_id", plain(F.col("text")).alias("body")), "doc_id", "left")
    return j.select("claim_id", "doc_id", F.coalesce(F.contains("body", plain(F.col("locator_text"))), F.lit(False)).alias("found"), (F.coalesce(F.length("body"), F.lit(0)) < 250).alias("is_thin"))
