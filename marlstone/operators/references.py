"""References to records that do not exist.

Keys are placed on the line of 64-bit hashes, which is cut into ranges of equal length.
The parents of a range are held as sorted arrays; the references of that range come in
batches and are probed by binary search. A range whose references exceed the batch size is
split by the referring key, and its parents are copied to each part, so that a target that
a third of all rows point to is spread over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parents that one range holds on average, and references that one task probes at a time.
PARENTS_PER_RANGE = 50_000
REFERENCES_PER_BATCH = 100_000

_OUT = "ref_table string, ref_key string, ref_field string, target_table string, target_key string, ref_us long, reason string"


def _probe(parents: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
    """Troubled rows of refs against the sorted parents of their range."""
    if refs.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in _OUT.split(", ")])
    order = np.argsort(parents["hash"].to_numpy(), kind="stable")
    hashes = parents["hash"].to_numpy()[order]
    tables = parents["target_table"].to_numpy(dtype=object)[order]
    keys = parents["target_key"].to_numpy(dtype=object)[order]
    probe = refs["hash"].to_numpy()
    want_table, want_key = refs["target_table"].to_numpy(dtype=object), refs["target_key"].to_numpy(dtype=object)
    at = np.searchsorted(hashes, probe, side="left")
    last = np.searchsorted(hashes, probe, side="right")
    hit = np.full(len(probe), -1, dtype=np.int64)
    step = 0
    while True:  # more than one step only where different keys share a hash
        there = at + step < last
        if not there.any():
            break
        rows = np.nonzero(there & (hit < 0))[0]
        pos = at[rows] + step
        same = (tables[pos] == want_table[rows]) & (keys[pos] == want_key[rows])
        hit[rows[same]] = pos[same]
        step += 1
    gone = parents["gone"].to_numpy(dtype=bool)[order]
    first = parents["first_us"].to_numpy(dtype="float64", na_value=np.nan)[order] if len(parents) else np.array([])
    exact = parents["first_us"].astype("Int64").to_numpy(dtype="int64", na_value=0)[order] if len(parents) else np.array([], dtype="int64")
    known = ~np.isnan(first)
    ref_us = refs["ref_us"].astype("Int64")
    ref_known, ref_at = ref_us.notna().to_numpy(), ref_us.to_numpy(dtype="int64", na_value=0)
    found = hit >= 0
    reason = np.full(len(probe), None, dtype=object)
    reason[~found] = "missing"
    i = np.nonzero(found)[0]
    j = hit[i]
    reason[i] = np.where(gone[j], "deleted", np.where(known[j] & ref_known[i] & (exact[j] > ref_at[i]), "late", None))
    out = refs[["ref_table", "ref_key", "ref_field", "target_table", "target_key", "ref_us"]].copy()
    out["reason"] = reason
    return out[out["reason"].notna()]


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References in trouble, with the first reason that holds: missing, deleted or late.

    references: ref_table, ref_key, ref_field, target_table, target_key, ref_us (the earliest
    instant of the records that hold the reference, or null); one row per distinct reference.
    parents: target_table, target_key, first_us (earliest instant or null), gone (deleted and not
    recorded again); one row per key. Null target keys are no references. A null instant on either
    side is left out of the time comparison. No parents at all make every reference missing.

    Returns the references' columns and reason.
    """
    n = parents.count()
    bits = max(0, math.ceil(math.log2(max(1, n / PARENTS_PER_RANGE))))
    hashed = F.xxhash64("target_table", "target_key")
    range_of = F.shiftrightunsigned(F.col("hash"), 64 - bits) if bits else F.lit(0).cast("long")
    refs = references.where(F.col("target_key").isNotNull()).withColumn("hash", hashed).withColumn("rng", range_of)
    owners = parents.where(F.col("target_key").isNotNull()).withColumn("hash", hashed).withColumn("rng", range_of)
    # how many parts each range takes: one row per range, aggregated before the shuffle
    parts = refs.groupBy("rng").agg(F.ceil(F.count(F.lit(1)) / F.lit(REFERENCES_PER_BATCH)).cast("int").alias("parts"))
    refs = refs.join(parts, "rng").withColumn("part", F.pmod(F.xxhash64("ref_table", "ref_key", "ref_field"), F.col("parts")).cast("int"))
    owners = owners.join(parts, "rng").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = owners.select("rng", "part", "hash", "target_table", "target_key", "first_us", "gone")
    right = refs.select("rng", "part", "hash", "ref_table", "ref_key", "ref_field", "target_table", "target_key", "ref_us")
    return left.groupBy("rng", "part").cogroup(right.groupBy("rng", "part")).applyInPandas(_probe, _OUT)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per referring table, field, month of the reference (UTC, null if unreadable) and reason."""
    month = F.date_format(F.timestamp_micros("ref_us"), "yyyy-MM")
    return orphans.groupBy("ref_table", "ref_field", month.alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_references"))
