"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.keys import row_hash


def latest_deliveries(df: DataFrame, snapshot: str, delivered: str) -> DataFrame:
    """Rows of the latest delivery of each snapshot.

    The deliveries are pre-aggregated to one row per snapshot, which is joined back; a null
    delivery time counts as the earliest.
    """
    at = F.coalesce(F.col(delivered), F.lit("0001-01-01").cast("timestamp"))
    last = df.groupBy(F.col(snapshot).alias("_ms_snap")).agg(F.max(at).alias("_ms_at"))
    return df.join(last, F.col(snapshot).eqNullSafe(F.col("_ms_snap")) & (at == F.col("_ms_at"))).drop("_ms_snap", "_ms_at")


def snapshot_changes(
    df: DataFrame,
    snapshot: str,
    taken: str,
    key: Column,
    compared: list[Column],
    delivered: str | None = None,
) -> DataFrame:
    """Added, removed and changed keys of every snapshot but the first.

    Of a snapshot delivered more than once the latest delivery counts; snapshots are ordered by
    the earliest ``taken`` seen in that delivery. ``compared`` are canonical forms (rounded,
    one spelling); null is a value of its own. Rows of one key that differ only in spelling are
    one row; if a snapshot holds really different rows of one key, the one with the smallest
    canonical hash counts. Rows with a null snapshot or key are left out.

    Full outer join on the key between each snapshot and the one before, by canonical hash:
    a missing side is an addition or a removal, unequal hashes are a change.
    Returns snapshot, key column ``key``, change. One row per snapshot is numbered in one task;
    nothing else is gathered.
    """
    if delivered:
        df = latest_deliveries(df, snapshot, delivered)
    rows = (
        df.select(
            F.col(snapshot).alias("_ms_snap"), F.col(taken).alias("_ms_taken"),
            key.alias("_ms_key"), row_hash(*compared).alias("_ms_hash"),
        )
        .where(F.col("_ms_snap").isNotNull() & F.col("_ms_key").isNotNull())
    )
    # one row per snapshot: its number in time order and the name of the next one
    names = rows.groupBy("_ms_snap").agg(F.min("_ms_taken").alias("_ms_taken"))
    order = Window.orderBy("_ms_taken", "_ms_snap")
    names = names.select(
        "_ms_snap", F.row_number().over(order).alias("_ms_no"), F.lead("_ms_snap").over(order).alias("_ms_later"))
    state = rows.groupBy("_ms_snap", "_ms_key").agg(F.min("_ms_hash").alias("_ms_hash")).join(names, "_ms_snap")
    now = state.where("_ms_no > 1").select(F.col("_ms_snap").alias("s"), F.col("_ms_key").alias("k"), F.col("_ms_hash").alias("h"))
    then = state.where("_ms_later is not null").select(
        F.col("_ms_later").alias("s0"), F.col("_ms_key").alias("k0"), F.col("_ms_hash").alias("h0"))
    both = now.join(then, (F.col("s") == F.col("s0")) & (F.col("k") == F.col("k0")), "full_outer")
    change = (
        F.when(F.col("k0").isNull(), F.lit("added"))
        .when(F.col("k").isNull(), F.lit("removed"))
        .when(F.col("h") != F.col("h0"), F.lit("changed"))
    )
    return both.select(
        F.coalesce("s", "s0").alias(snapshot), F.coalesce("k", "k0").alias("key"), change.alias("change")
    ).where(F.col("change").isNotNull())
