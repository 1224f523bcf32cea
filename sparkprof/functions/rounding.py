"""Decimal rounding by the exact value of a double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(value: Column, digits: int, ties_to_even: bool = True) -> Column:
    """The double with so many decimals as text, rounded by its exact binary value.

    ``format_string`` rounds the shortest decimal text instead, which differs
    where that text lies on a tie or is too short; only such values take the longer way.
    """
    usual = F.format_string(f"%.{digits}f", value)
    return F.when(_near_tie(value, digits), _exact(value, digits, ties_to_even)).otherwise(usual)


def rounded(value: Column, digits: int = 4) -> Column:
    """The nearest double with so many decimals, by the same rule."""
    exact = _exact(value, digits, True).cast("double")
    return F.when(_near_tie(value, digits), exact).otherwise(F.round(value, digits))


def _near_tie(value: Column, digits: int) -> Column:
    """True where the scaled fraction cannot be told from a half."""
    scaled = F.abs(value) * float(10**digits)
    # From here on the bound holds for any fraction, and the floor may not fit a long.
    close = (scaled >= 1e15) | (F.abs(scaled - F.floor(scaled) - 0.5) <= scaled * 1e-15 + 1e-6)
    return close & (scaled < float("inf"))


def _exact(value: Column, digits: int, ties_to_even: bool) -> Column:
    """The fraction is cut in two after 26 bits; both parts can be scaled without
    an error, so what lies above or below a tie has the right sign.
    """
    scale, cut = float(10**digits), float(2**26)

    def parts(size):
        # Beyond 2^53 a double is whole.
        whole = F.when(size < float(2**53), F.floor(size).cast("double")).otherwise(size)
        return F.struct(whole.alias("whole"), (size - whole).alias("rest"))

    def scaled(p):
        leading = F.floor(p["rest"] * cut) / cut
        high, low = leading * scale, (p["rest"] - leading) * scale
        return F.struct(p["whole"].alias("whole"), high.alias("high"), low.alias("low"))

    def rounded(p):
        units = F.floor(p["high"] + p["low"])
        over = (p["high"] - units - 0.5) + p["low"]
        tie = units % 2 if ties_to_even else F.lit(1)
        up = F.when(over > 0, 1).when(over == 0, tie).otherwise(0)
        return F.struct(p["whole"].alias("whole"), (units + up).cast("bigint").alias("units"))

    def text(p):
        whole = p["whole"] + (p["units"] == int(scale)).cast("int")
        decimals = F.lpad((p["units"] % int(scale)).cast("string"), digits, "0")
        digits_before = F.when(whole < float(2**63), whole.cast("bigint").cast("string"))
        return F.concat(F.coalesce(digits_before, F.format_string("%.0f", whole)), F.lit("."), decimals)

    shown = F.abs(value)
    for step in (parts, scaled, rounded, text):
        shown = _let(shown, step)
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), shown)

