"""Which files are accepted for loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
EXTENSIONS = ("csv", "xlsx", "xls")
MAX_BYTES = 100 * 1024 * 1024


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) of the files below a path; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return reader.load(path).select("path", "length")


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, in lower case."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def admit(
    files: DataFrame,
    path: str = "path",
    length: str = "length",
    extensions: tuple[str, ...] = EXTENSIONS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Adds ``accepted`` and, for a refused file, the ``reason``."""
    known = F.coalesce(extension(F.col(path)).isin(*extensions), F.lit(False))
    fits = F.coalesce(F.col(length) <= max_bytes, F.lit(False))
    reason = F.when(~known, F.lit("extension")).when(~fits, F.lit("size"))
    return files.withColumns({"accepted": known & fits, "reason": reason})
