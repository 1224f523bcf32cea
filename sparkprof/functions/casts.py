"""Casts that give NULL instead of failing, and clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(text: Column) -> Column:
    """The text as a double.  A type suffix such as ``1.5d`` is not a number."""
    typed_literal = F.rlike(F.trim(text), F.lit(r"^[+-]?[0-9.].*[dDfF]$"))
    return F.when(~typed_literal, text.try_cast("double"))


def safe_long(text: Column) -> Column:
    """The text as a whole number; ``3.7`` is not one."""
    return F.when(F.rlike(F.trim(text), F.lit(r"^[+-]?[0-9]+$")), text.try_cast("bigint"))


def clamped(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(column, F.lit(high)))
