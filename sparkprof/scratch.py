"""Intermediate tables that must be computed exactly once.

The folder is the one the cluster names in ``spark.checkpoint.dir`` (shared
storage), so what is written survives lost executors.  Only a session that runs
in a single JVM without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
# The paths handed out in each open scope.
_scopes: list[list[str]] = []


def scratch_folder(spark: SparkSession) -> str:
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="sparkprof-")
    return _local_folder


def new_path(spark: SparkSession, kind: str) -> str:
    """A path nobody else writes to."""
    path = f"{scratch_folder(spark).rstrip('/')}/sparkprof/{kind}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes what is written within it, for results that are complete when it ends."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for written in _scopes.pop():
            path = jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(conf).delete(path, True)


def write_once(df: DataFrame, kind: str) -> DataFrame:
    """Writes the rows as a table and returns a scan of it: the lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def use_checkpoints(spark: SparkSession) -> None:
    """Lets iterative estimators cut their lineage in the same folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_folder(spark))
