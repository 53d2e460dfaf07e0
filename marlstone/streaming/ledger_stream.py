"""Ledgers as streams. An extension: the batch operators are the contract, these keep their results current.

All sinks write through foreachBatch to a table, exactly once by batch id: a repeated batch
overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marlstone.operators.ledger import CLAIM_TRANSITIONS, SEP, latest_per


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def keep_latest(stream: DataFrame, key: str, order: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the last row per key of a stream in target/current, a versioned table.

    Each batch is reduced to a row per key, merged with the version before and written as the next one;
    ``read_latest`` gives the newest. Late rows with a lower order change nothing.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = latest_per(batch, key, order)
        if batch_id:
            new = latest_per(spark.read.schema(batch.schema).parquet(f"{target}/ml_version={batch_id - 1}").unionByName(new), key, order)
        new.write.mode("overwrite").parquet(f"{target}/ml_version={batch_id}")

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest version that keep_latest has written."""
    found = spark.read.option("basePath", target).parquet(f"{target}/ml_version=*")
    newest = found.agg(F.max("ml_version")).first()[0]
    return found.where(F.col("ml_version") == newest).drop("ml_version")


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, by, n per tumbling window; rows later than the watermark are left out."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """by, first, last_end, n of sessions: rows of one key at most a gap apart."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.session_window("_t", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("first"), F.col("w.end").alias("last_end"), "n")


def distinct_rows(stream: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Rows of a stream once, repeats within the watermark left out."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def bad_transitions(batch: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """Rows of a batch whose change of status the state machine does not allow, for use in foreachBatch."""
    pairs = [f"{a}{SEP}{b}" for a, bs in CLAIM_TRANSITIONS.items() for b in bs]
    w = Window.partitionBy(key).orderBy(order)
    rows = batch.withColumn("from_status", F.lag(status).over(w)).where(F.col("from_status") != F.col(status))
    return rows.where(~F.concat_ws(SEP, "from_status", status).isin(pairs)).select(key, "from_status", F.col(status).alias("to_status"), order)
