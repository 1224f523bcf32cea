"""NaN, infinity and NULL handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprof.columns import is_floating, qcol

_INFINITIES = (float("inf"), float("-inf"))


def is_missing(column: Column, dtype: T.DataType) -> Column:
    """NULL, or NaN where the type can hold one."""
    return column.isNull() | F.isnan(column) if is_floating(dtype) else column.isNull()


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def finite_or_null(column: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~(F.isnan(column) | column.isin(*_INFINITIES)), column)


def sanitized(column: Column, dtype: T.DataType) -> Column:
    """``finite_or_null`` at every depth of arrays, maps and structs."""
    if not _holds_floating(dtype):
        return column
    if is_floating(dtype):
        return finite_or_null(column)
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda item: sanitized(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(column, lambda _, item: sanitized(item, dtype.valueType))
    fields = [sanitized(column.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
    return F.when(column.isNotNull(), F.struct(*fields))


def _holds_floating(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_floating(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_floating(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_holds_floating(f.dataType) for f in dtype.fields)
    return is_floating(dtype)


def sanitize(df: DataFrame) -> DataFrame:
    """Every NaN or infinity in the table becomes NULL."""
    return df.select([sanitized(qcol(f.name), f.dataType).alias(f.name) for f in df.schema])


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in the top-level floating columns; infinities stay."""
    return df.select(
        [
            (nan_to_null(qcol(f.name)) if is_floating(f.dataType) else qcol(f.name)).alias(f.name)
            for f in df.schema
        ]
    )


def without_null_entries(entries: Column) -> Column:
    """A map without the keys whose value is NULL."""
    return F.map_filter(entries, lambda _, value: value.isNotNull())
