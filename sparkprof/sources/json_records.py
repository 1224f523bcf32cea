"""JSON record documents: ``{"name": ..., "data": [{column: value, ...}, ...]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprof.columns import qcol
from sparkprof.functions.missing import normalize_nulls, sanitized

# Fixed values.
NAME_PREFIX = "dataset_"
NAME_DIGITS = 8
# Moments are written to the microsecond.
MOMENTS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def read_documents(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """(path, name, data) with one row per document; one file is one document.

    ``schema`` describes a record.  Without it the record type is inferred as
    the union of the keys of all documents.
    """
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        record = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        document = T.StructType().add("name", "string").add("data", T.ArrayType(record))
        reader = reader.schema(document)
    documents = reader.json(path)
    if "data" not in documents.columns:
        raise ValueError("no document holds a list of records under 'data'")
    source = F.col("_metadata.file_path")
    fallback = F.concat(F.lit(NAME_PREFIX), F.substring(F.md5(source), 1, NAME_DIGITS))
    name = F.col("name").cast("string") if "name" in documents.columns else F.lit(None).cast("string")
    return documents.select(
        source.alias("path"), F.coalesce(name, fallback).alias("name"), "data"
    )


def read_json_records(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    name: str | None = None,
) -> DataFrame:
    """All records of all documents as one table, after the document's name.

    A document without records contributes none (``empty_documents`` lists
    them); NaN becomes NULL.
    """
    documents = read_documents(spark, path, schema)
    named = F.lit(name) if name else F.col("name")
    records = documents.select(named.alias("_dataset"), F.inline("data"))
    return normalize_nulls(records.withColumnRenamed("_dataset", "dataset_name"))


def empty_documents(documents: DataFrame) -> DataFrame:
    """The documents that are refused: ``data`` is missing or holds no record."""
    return documents.filter(F.coalesce(F.size("data"), F.lit(0)) <= 0).select("path", "name")


def read_json_lines(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """A table from files with one record per line, which Spark can split."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return normalize_nulls(reader.json(path))


def json_records(df: DataFrame, limit: int | None = None, name: str = "record") -> DataFrame:
    """Each row as a JSON object; NULL, NaN and infinities become null."""
    rows = df if limit is None else df.limit(limit)
    return rows.select(json_record(rows).alias(name))


def json_record(df: DataFrame) -> Column:
    """The whole row as a JSON object."""
    fields = [sanitized(qcol(f.name), f.dataType).alias(f.name) for f in df.schema]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false", **MOMENTS})


def write_json_records(df: DataFrame, path: str, limit: int | None = None) -> None:
    """Writes one JSON object per line."""
    json_records(df, limit).write.text(path)
