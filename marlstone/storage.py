"""Intermediate tables in the folder all executors share.

Iterative and multi-pass operators cut their lineage with written tables, never
with local checkpoints, so that a lost executor costs a re-read and not a failure.
The folder is the cluster's ``spark.checkpoint.dir``; a private temporary folder
stands in only where that setting is absent and the master is local.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_LIVE: dict[str, list[tuple[SparkSession, str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return _FALLBACK[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder goes with the cluster's clean-up
        pass


class Scratch:
    """Written intermediate tables of one operator run.

    ``keep(df)`` writes and returns the table read back; ``drop(df)`` removes one that
    no later plan reads. What is left is removed when the Python process ends, since the
    returned plan is lazy and still reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0
        if not _LIVE:
            atexit.register(_clean)
        _LIVE.setdefault(spark.sparkContext.applicationId, []).append((spark, self.root))

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)


def _clean() -> None:
    for items in _LIVE.values():
        for spark, root in items:
            _delete(spark, root)
    for path in _FALLBACK.values():
        import shutil

        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
