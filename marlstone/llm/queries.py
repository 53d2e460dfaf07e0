"""Queries p8 to p10 over the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import abuse, packing, tokens
from marlstone.sources.tables import table
from marlstone.storage import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, tokens, tokens that split a character, and documents that decode to other text (none should)."""
    back = tokens.roundtrip(table(spark, d, "documents"), keep=("source",))
    return back.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.sum("n_split").alias("n_split"), F.sum((~F.col("same")).cast("int")).alias("n_changed"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    kinds = [(r[0], r[1]) for r in table(spark, d, "containers").select("container_kind", "capacity_tokens").distinct().limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    # encoding is the dear part: counted once, written, and packed from there
    counts = Scratch(spark, "token-counts").keep(tokens.token_counts(table(spark, d, "documents")))
    return packing.pack(counts, kinds)


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    """The scored documents and the cut that the fit chose."""
    documents = table(spark, d, "documents")
    model = abuse.fit_documents(documents, table(spark, d, "content_labels"))
    return abuse.score_documents(documents, model, ("source",)), model.cut


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    scored, cut = _scored(spark, d)
    return scored.where(F.col("score") >= cut).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0].select("doc_id", F.round("score", 6).alias("score"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(*_scored(spark, d))


QUERIES: dict[str, Query] = {
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}
