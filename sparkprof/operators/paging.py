"""Previews and pages of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprof.columns import qcol, require_columns
from sparkprof.functions.text import display_cell
from sparkprof.operators.ordering import numbered
from sparkprof.scratch import temporary

# Fixed values.
MAX_ROWS = 10_000
DEFAULT_ROWS = 100
DISPLAY_ROWS = 10


def preview(df: DataFrame, limit: int = DEFAULT_ROWS, order: list[str] | None = None) -> DataFrame:
    """The first rows, in the given order if there is one."""
    check_page(limit, 0)
    if order is None:
        return df.limit(limit)
    require_columns(df, order)
    return df.orderBy(*[qcol(n) for n in order]).limit(limit)


def page(df: DataFrame, key: str, limit: int = DEFAULT_ROWS, offset: int = 0) -> DataFrame:
    """Rows ``[offset, offset + limit)`` in the order of a key, NULL first.

    Rows of equal keys follow the order of the other columns that can be ordered.
    The first page is a top-k.  Any other numbers the keys alone, across the cluster,
    and reads only the rows between its first and its last key; what that range holds
    before the page is skipped there.  Where many pages are asked for, ``page_index`` sorts
    once for all.  To walk through a table use ``page_after``, which
    does not have to count the rows it skips.
    """
    check_page(limit, offset)
    require_columns(df, [key])
    order = row_order(df, key)
    if offset == 0:
        return df.orderBy(*order).limit(limit)
    with temporary(df.sparkSession):
        keys = numbered(df.select(qcol(key).alias("key")), [F.col("key")], "position")
        page_ = F.col("position").between(offset, offset + limit - 1)
        ends = F.struct("position", "key")
        # Two rows of a key and its position; an empty page has none.
        ends = keys.filter(page_).agg(F.min(ends).alias("first"), F.max(ends).alias("last")).first()
        before = _first_place(keys, ends["first"])
    if ends["first"] is None:
        return df.limit(0)
    first, last = (F.lit(ends[e]["key"]).cast(df.schema[key].dataType) for e in ("first", "last"))
    near = _from(qcol(key), first, ends["first"]["key"]) & _upto(qcol(key), last, ends["last"]["key"])
    return df.filter(near).orderBy(*order).offset(ends["first"]["position"] - before).limit(limit)


def row_order(df: DataFrame, key: str) -> list[Column]:
    """A key and the other columns that can be ordered."""
    return [qcol(key), *[qcol(f.name) for f in df.schema if f.name != key and _ordered(f.dataType)]]


def _first_place(keys: DataFrame, at) -> int | None:
    """The position of the first row with the key of a row."""
    if at is None:
        return None
    same = F.col("key").eqNullSafe(F.lit(at["key"]).cast(keys.schema["key"].dataType))
    return keys.filter(same).agg(F.min("position")).first()[0]


def _from(key: Column, first: Column, value) -> Column:
    return F.lit(True) if value is None else key >= first


def _upto(key: Column, last: Column, value) -> Column:
    return key.isNull() if value is None else key.isNull() | (key <= last)


def _ordered(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def page_after(df: DataFrame, key: str, after, limit: int = DEFAULT_ROWS) -> DataFrame:
    """The rows that follow a key: a pushed-down filter and a top-k."""
    check_page(limit, 0)
    require_columns(df, [key])
    return df.filter(qcol(key) > F.lit(after)).orderBy(qcol(key)).limit(limit)


def with_total(rows: DataFrame, table: DataFrame, name: str = "total_rows") -> DataFrame:
    """Adds the row count of the table the rows come from."""
    total: Column = table.agg(F.count(F.lit(1))).scalar()
    return rows.withColumn(name, total)


def display_rows(df: DataFrame, limit: int = DISPLAY_ROWS, order: list[str] | None = None) -> DataFrame:
    """The first rows as display text."""
    return display(preview(df, limit, order))


def display(df: DataFrame) -> DataFrame:
    """Every cell as display text."""
    return df.select([display_cell(qcol(f.name), f.dataType).alias(f.name) for f in df.schema])


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"limit must be between 1 and {MAX_ROWS}")
    if offset < 0:
        raise ValueError("offset must not be negative")
