"""Nearest neighbours and coherence over dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one block holds.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where one has no length."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def top_k(queries: DataFrame, items: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """query, item, score, rank: the k items of largest cosine to each query, ties by item; exact.

    A stated query set meets all items in blocks: queries are cut into blocks of BLOCK vectors, each task
    scores its items against a block by matrix product and keeps k per query, and the survivors (k per
    query and task) are ranked. Null, empty and zero vectors match nothing.
    """
    names = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    n = names.count()
    spark = items.sparkSession
    kind = items.schema[key].dataType.simpleString()
    out = f"query {kind}, item {kind}, score double"
    best = spark.createDataFrame([], out)
    for b in range(max(1, -(-n // BLOCK)) if n else 0):
        block = names.where(F.pmod(F.xxhash64("q"), F.lit(-(-n // BLOCK))) == b).toPandas()
        if block.empty:
            continue
        m = np.stack([np.asarray(v, dtype=np.float64) for v in block["v"]])
        length = np.linalg.norm(m, axis=1)
        shared = spark.sparkContext.broadcast((block["q"].to_numpy(), m / np.where(length > 0, length, 1)[:, None], length > 0))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, unit, live = shared.value
            for pdf in batches:
                pdf = pdf[pdf["v"].map(lambda v: v is not None and len(v) == unit.shape[1])]
                if pdf.empty:
                    continue
                x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
                norm = np.linalg.norm(x, axis=1)
                s = np.round(unit @ (x / np.where(norm > 0, norm, 1)[:, None]).T, 12)
                s[:, norm == 0] = -np.inf
                s[~live] = -np.inf
                item = pdf["i"].to_numpy()
                if exclude_self:
                    s[ids[:, None] == item[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(item, s.shape), -s), axis=1)[:, :k]
                rows, cols = np.repeat(np.arange(len(ids)), order.shape[1]), order.ravel()
                keep = np.isfinite(s[rows, cols])
                yield pd.DataFrame({"query": ids[rows[keep]], "item": item[cols[keep]], "score": s[rows[keep], cols[keep]]})

        found = items.select(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(score, out)
        best = best.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "item")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rescaled(c: Column) -> Column:
    """A cosine brought to [0, 1]."""
    return (c + 1) / 2


def coherence(vectors: DataFrame, group: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """group, n, coherence: mean cosine over all pairs of a group's vectors; 1.0 below two.

    From the sum of the unit vectors, dimension by dimension, so no pair is formed.
    """
    v = vectors.where(F.col(vector).isNotNull()).select(group, key, F.col(vector).cast("array<double>").alias("v"))
    unit = v.withColumn("l", F.sqrt(dot(F.col("v"), F.col("v")))).where("l > 0").select(group, F.posexplode(F.transform("v", lambda x: x / F.col("l"))).alias("d", "x"))
    s = unit.groupBy(group, "d").agg(F.sum("x").alias("s")).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    n = v.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return n.join(s, group, "left").select(group, "n", F.when(F.col("n") < 2, 1.0).otherwise((F.coalesce("sq", F.lit(0.0)) - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))
