"""Small tables that are already in the driver's memory."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sparkprof.functions.missing import normalize_nulls
from sparkprof.sources.json_records import NAME_DIGITS, NAME_PREFIX


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """A table from a pandas frame; holes of any type are NULL."""
    return normalize_nulls(spark.createDataFrame(frame))


def from_document(
    spark: SparkSession, document: dict, name: str | None = None
) -> tuple[str, DataFrame]:
    """(name, table) of one JSON record document; its columns are all keys that occur."""
    records = document.get("data")
    if not isinstance(records, list) or not records:
        raise ValueError("'data' must be a list with at least one record")
    fallback = f"{NAME_PREFIX}{uuid.uuid4().hex[:NAME_DIGITS]}"
    return name or document.get("name") or fallback, from_pandas(spark, pd.DataFrame(records))
