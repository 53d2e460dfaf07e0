"""Histories of changing attributes: one row per period of unchanged values.

Gaps and islands over all records. A key may hold a third of all rows, so the order of
one key is cut into time buckets: changes are marked and islands numbered within each
(key, bucket), then the edges of neighbouring buckets are compared on one summary row per
bucket. No task sorts more than the rows of one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.keys import row_hash
from marlstone.storage import Scratch

#: Default width of a time bucket: a week, in microseconds.
WEEK_US = 7 * 86_400 * 1_000_000


def validity_periods(
    df: DataFrame,
    key: str,
    instant: str,
    attributes: list[str],
    tie: str | None = None,
    bucket_us: int = WEEK_US,
) -> DataFrame:
    """Periods of unchanged attributes per key.

    df: any records; ``instant`` is a long in microseconds, ``tie`` decides between records
    of one key at one instant (the highest counts). Rows whose key or instant is null are left
    out; null attributes are values of their own. Repeated rows change nothing; an empty table
    gives an empty one. Further columns of df are ignored.

    Returns key, attributes, valid_from, valid_to (null: still valid), n_records (instants seen
    in the period). Columns starting with ``_mh_`` are reserved.
    """
    order = F.col(tie) if tie else F.xxhash64(*attributes)
    rows = (
        df.where(F.col(key).isNotNull() & F.col(instant).isNotNull())
        .select(
            F.col(key).alias("_mh_key"),
            F.col(instant).cast("long").alias("_mh_us"),
            F.struct(order.alias("tie"), F.struct(*attributes).alias("a")).alias("_mh_rec"),
        )
        .withColumn("_mh_bucket", F.floor(F.col("_mh_us") / F.lit(bucket_us)))
        # one shuffle serves the choice among ties, the order and the islands of a bucket
        .repartition(F.col("_mh_key"), F.col("_mh_bucket"))
        .groupBy("_mh_key", "_mh_bucket", "_mh_us")
        .agg(F.max("_mh_rec")["a"].alias("_mh_a"))
        .withColumn("_mh_hash", row_hash(*[F.col("_mh_a")[a] for a in attributes]))
    )
    in_bucket = Window.partitionBy("_mh_key", "_mh_bucket").orderBy("_mh_us")
    before_hash, before = F.lag("_mh_hash").over(in_bucket), F.lag("_mh_a").over(in_bucket)
    same = (before_hash == F.col("_mh_hash")) & before.eqNullSafe(F.col("_mh_a"))
    # written once: both the edges and the result read the islands, and the records are parsed once
    islands = Scratch(df.sparkSession, "history").keep(
        rows.withColumn("_mh_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
        .withColumn("_mh_island", F.sum("_mh_new").over(in_bucket))
        .groupBy("_mh_key", "_mh_bucket", "_mh_island")
        .agg(F.min("_mh_us").alias("_mh_start"), F.first("_mh_a").alias("_mh_a"), F.count(F.lit(1)).alias("_mh_n"))
    )
    edges = islands.groupBy("_mh_key", "_mh_bucket").agg(
        F.min_by("_mh_a", "_mh_island").alias("_mh_first"),
        F.max_by("_mh_a", "_mh_island").alias("_mh_last"),
        F.min("_mh_start").alias("_mh_s1"),
        F.min(F.when(F.col("_mh_island") == 2, F.col("_mh_start"))).alias("_mh_s2"),
        F.min(F.when(F.col("_mh_island") == 1, F.col("_mh_n"))).alias("_mh_n1"),
        F.max("_mh_island").alias("_mh_islands"),
    )
    by_bucket = Window.partitionBy("_mh_key").orderBy("_mh_bucket")
    later = Window.partitionBy("_mh_key").orderBy(F.col("_mh_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        edges.withColumn("_mh_joins", F.coalesce(F.lag("_mh_last").over(by_bucket) == F.col("_mh_first"), F.lit(False)))
        # the start of the first period that begins in this bucket, if any does
        .withColumn("_mh_opens", F.when(F.col("_mh_joins"), F.col("_mh_s2")).otherwise(F.col("_mh_s1")))
        .withColumn("_mh_next", F.last("_mh_opens", ignorenulls=True).over(later))
    )
    # records of joined first islands belong to the last period that began before
    runs = Window.partitionBy("_mh_key").orderBy("_mh_bucket")
    edges = edges.withColumn("_mh_run", F.sum(F.when(F.col("_mh_opens").isNotNull(), 1).otherwise(0)).over(runs))
    carried = edges.withColumn(
        "_mh_to", F.when(F.col("_mh_joins"), F.col("_mh_run") - F.when(F.col("_mh_opens").isNotNull(), 1).otherwise(0))
    ).where("_mh_joins").groupBy("_mh_key", F.col("_mh_to").alias("_mh_run")).agg(F.sum("_mh_n1").alias("_mh_more"))
    edges = edges.join(carried, ["_mh_key", "_mh_run"], "left").select(
        "_mh_key", "_mh_bucket", "_mh_joins", "_mh_islands", "_mh_next",
        # only the last period that opens in the bucket takes them
        F.when(F.col("_mh_opens").isNotNull(), F.col("_mh_more")).alias("_mh_more"),
    )
    starts = Window.partitionBy("_mh_key", "_mh_bucket").orderBy("_mh_island")
    out = (
        islands.withColumn("_mh_to", F.lead("_mh_start").over(starts))
        .join(edges, ["_mh_key", "_mh_bucket"])
        .where(~(F.col("_mh_joins") & (F.col("_mh_island") == 1)))
    )
    last = F.col("_mh_island") == F.col("_mh_islands")
    return out.select(
        F.col("_mh_key").alias(key),
        *[F.col("_mh_a")[a].alias(a) for a in attributes],
        F.col("_mh_start").alias("valid_from"),
        F.when(last, F.col("_mh_next")).otherwise(F.col("_mh_to")).alias("valid_to"),
        (F.col("_mh_n") + F.when(last, F.coalesce(F.col("_mh_more"), F.lit(0))).otherwise(0)).alias("n_records"),
    )
