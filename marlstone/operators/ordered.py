"""Ordered operators that stay even when one key holds a third of all rows.

A key's order is cut into buckets of bounded width. Rows look back within their bucket, and a
summary row per bucket, joined back, stands for all that came before it. The shuffle is by
(key, bucket); only summaries are ordered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width)).cast("long")


def lag_in_buckets(df: DataFrame, key: str, order: str, values: list[str], width: int, name: str = "before") -> DataFrame:
    """df with ``name``, a struct of ``values`` in the row before by (key, order); null for a key's first row.

    order is numeric; rows of equal order follow the hash of their values. Rows with a null key or order
    have null. Columns starting with ``_mo_`` are reserved.
    """
    rows = df.withColumn("_mo_b", bucket_of(F.col(order), width)).withColumn("_mo_h", F.xxhash64(*values))
    w = Window.partitionBy(key, "_mo_b").orderBy(order, "_mo_h")
    rows = rows.withColumn("_mo_in", F.lag(F.struct(*values)).over(w))
    last = rows.where(F.col(key).isNotNull() & F.col("_mo_b").isNotNull()).groupBy(F.col(key).alias("_mo_k"), F.col("_mo_b").alias("_mo_bb")).agg(F.max_by(F.struct(*values), F.struct(order, "_mo_h")).alias("_mo_last"))
    prev = last.select("_mo_k", "_mo_bb", F.lag("_mo_last").over(Window.partitionBy("_mo_k").orderBy("_mo_bb")).alias("_mo_prev"))
    out = rows.join(prev, (F.col(key) == F.col("_mo_k")) & (F.col("_mo_b") == F.col("_mo_bb")), "left")
    return out.withColumn(name, F.coalesce("_mo_in", "_mo_prev")).drop("_mo_b", "_mo_h", "_mo_in", "_mo_k", "_mo_bb", "_mo_prev")


def gap_clusters(df: DataFrame, group: str, start: str, end: str, gap: int, width: int) -> DataFrame:
    """group, first, last, n of rows that lie at most ``gap`` apart: sessions of events, clusters of findings.

    A cluster reaches as far as its furthest end so far, which may lie in a later bucket. Rows with a null
    group, start or end are left out; an empty table gives an empty one.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(end).alias("_e"), bucket_of(F.col(start), width).alias("_b"))
    ends = rows.groupBy("_g", "_b").agg(F.max("_e").alias("_top"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_g").alias("_g2"), F.col("_b").alias("_b2"), F.max("_top").over(before).alias("_carry"))
    w = Window.partitionBy("_g", "_b").orderBy("_s", "_e")
    far = F.greatest(F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    opened = rows.join(ends, (F.col("_g") == F.col("_g2")) & (F.col("_b") == F.col("_b2"))).withColumn("_new", F.when(far.isNull() | (F.col("_s") - far > gap), 1).otherwise(0))
    opened = opened.select("_g", "_b", "_s", "_e", "_new", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"))
    # clusters within a bucket, then numbered on over the buckets before
    local = opened.groupBy("_g", "_b", "_c").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_n"), F.sum("_new").alias("_new"))
    sizes = local.groupBy(F.col("_g").alias("_g3"), F.col("_b").alias("_b3")).agg(F.sum("_new").alias("_k"))
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_k").over(Window.partitionBy("_g3").orderBy("_b3").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = local.join(sizes, (F.col("_g") == F.col("_g3")) & (F.col("_b") == F.col("_b3"))).withColumn("_id", F.col("_base") + F.col("_c"))
    return numbered.groupBy("_g", "_id").agg(F.min("_s").alias("first"), F.max("_e").alias("last"), F.sum("_n").alias("n")).select(F.col("_g").alias(group), "first", "last", "n")
