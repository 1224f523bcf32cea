"""Arrow batches of bounded bytes, for tasks whose rows may be long."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def bounded(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """What runs within it hands Python batches of about ``size`` bytes, a row at least."""
    before = spark.conf.get(_BYTES)
    spark.conf.set(_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(_BYTES, before)
