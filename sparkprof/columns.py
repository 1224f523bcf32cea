"""Column names and logical types, read from a schema (no job is run)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)
_DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def quoted(name: str) -> str:
    """A column name as a SQL identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text as a SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def qcol(name: str) -> Column:
    return F.col(quoted(name))


def logical_type(dtype: T.DataType) -> str:
    """string, integer, numeric, boolean, datetime, nested or unknown."""
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, _INTEGER):
        return "integer"
    if isinstance(dtype, _FRACTIONAL):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, _DATETIME):
        return "datetime"
    if isinstance(dtype, _NESTED):
        return "nested"
    return "unknown"


def is_floating(dtype: T.DataType) -> bool:
    """True for the types that can hold NaN and infinities."""
    return isinstance(dtype, _FLOATING)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that get descriptive statistics and histograms."""
    return [f.name for f in df.schema if logical_type(f.dataType) in ("integer", "numeric")]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if logical_type(f.dataType) == "string"]


def candidate_features(df: DataFrame, target: str) -> list[str]:
    """Every column but the target, in schema order."""
    return [name for name in df.columns if name != target]


def split_by_kind(df: DataFrame, names: Iterable[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) among the named columns, each in the given order."""
    strings = set(string_columns(df))
    names = list(names)
    return [n for n in names if n not in strings], [n for n in names if n in strings]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    present = set(df.columns)
    missing = [n for n in names if n not in present]
    if missing:
        raise KeyError(f"columns not in the table: {', '.join(missing)}")


def require_numeric(df: DataFrame, name: str) -> None:
    require_columns(df, [name])
    if name not in numeric_columns(df):
        raise ValueError(f"column {name!r} is not numeric")


def in_groups(names: list[str], size: int) -> list[list[str]]:
    """Cuts a long column list so that one aggregate never gets too wide."""
    return [names[i : i + size] for i in range(0, len(names), size)]
