"""Text made for people: labels, cells, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprof.columns import is_floating, logical_type
from sparkprof.functions.rounding import fixed

# Fixed values.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
BYTE_STEP = 1024.0
ELLIPSIS = "..."
NO_VALUE = "-"
NOT_AVAILABLE = "N/A"
UNKNOWN = "Unknown"
YES, NO = "Sí", "No"
CELL_DECIMALS = 4


def two_decimals(value: Column) -> Column:
    return fixed(value, 2)


def range_label(low: Column, high: Column) -> Column:
    return F.concat_ws("-", two_decimals(low), two_decimals(high))


def format_bytes(size: Column) -> Column:
    """``1.50 MB``: the largest unit that keeps the number under 1024, up to PB."""
    size = size.cast("double")
    text = None
    for power, unit in enumerate(BYTE_UNITS):
        scaled = F.concat_ws(" ", two_decimals(size / BYTE_STEP**power), F.lit(unit))
        fits = size < BYTE_STEP ** (power + 1)
        if text is None:
            text = F.when(fits, scaled)
        elif unit == BYTE_UNITS[-1]:
            text = text.otherwise(scaled)
        else:
            text = text.when(fits, scaled)
    return F.when(size.isNotNull(), text)


def truncated(text: Column, length: int = 100) -> Column:
    """At most ``length`` characters, the last three being dots where cut."""
    kept = F.substring(text, 1, length - len(ELLIPSIS))
    return F.when(F.length(text) <= length, text).otherwise(F.concat(kept, F.lit(ELLIPSIS)))


def display_cell(value: Column, dtype: T.DataType) -> Column:
    """A table cell: whole numbers as they are, others to 4 decimals."""
    if isinstance(dtype, T.BooleanType):
        shown = F.when(value, F.lit(YES)).otherwise(F.lit(NO))
        return F.when(value.isNull(), F.lit(NO_VALUE)).otherwise(shown)
    if logical_type(dtype) == "numeric":
        number = value.cast("double")
        # Zero has no sign.
        whole = F.when(number == 0, F.lit("0")).otherwise(F.format_string("%.0f", number))
        shown = F.when(number == F.rint(number), whole).otherwise(
            fixed(number, CELL_DECIMALS, ties_to_even=False)
        )
        missing = number.isNull() | F.isnan(number) if is_floating(dtype) else number.isNull()
        return F.when(missing, F.lit(NO_VALUE)).otherwise(shown)
    return F.coalesce(value.cast("string"), F.lit(NO_VALUE))


def display_stat(value: Column) -> Column:
    """A statistic to 4 decimals; text counts by its leading number."""
    lead = F.regexp_extract(
        value.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1
    )
    number = lead.try_cast("double")
    return F.when(number.isNull(), F.lit(NO_VALUE)).otherwise(
        fixed(number, CELL_DECIMALS, ties_to_even=False)
    )


def title_case(name: Column) -> Column:
    """``roc_auc`` to ``Roc Auc``: every run of letters starts with a capital."""
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(spaced, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def short_id(identifier: Column, length: int) -> Column:
    return F.concat(F.substring(identifier, 1, length), F.lit(ELLIPSIS))


def or_default(value: Column, default: str = NOT_AVAILABLE) -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def joined(items: Column) -> Column:
    return F.array_join(items, ", ")
