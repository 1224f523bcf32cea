"""Quantiles with a bounded amount of state: sketched in one scan, or exact."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprof.columns import in_groups, qcol, require_numeric
from sparkprof.functions.missing import nan_to_null

SKETCH_ERROR = 0.0005
LARGEST_SKETCH = 65_535
# Values of one interval that are brought together, once their number is known.
KEPT = 10_000
COLUMNS_PER_SCAN = 20
_CONTEXT = Context(prec=400)


def sketched_quantiles(value: str, probabilities: list[float], error: float) -> str:
    """SQL of an aggregate: quantiles of a double within ``error`` of their rank.

    A KLL sketch of fixed size per column; no values give NULL.
    """
    # Published bound: rank error 2.296 / k^0.9021 at 99% confidence.
    size = max(8, math.ceil((2.296 / error) ** (1 / 0.9021)))
    if size > LARGEST_SKETCH:
        raise ValueError(f"no sketch keeps a rank error of {error}; use exact quantiles")
    asked = ", ".join(f"{p!r}D" for p in probabilities)
    found = f"kll_sketch_get_quantile_double(kll_sketch_agg_double({value}, {size}), array({asked}))"
    return f"CASE WHEN count({value}) > 0 THEN {found} END"


@dataclass
class _Search:
    """The interval [low, high] thought to hold the value at ``rank`` (1-based)."""

    column: str
    probability: float
    rank: int
    low: float
    high: float
    value: float | None = None


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """The value at rank ceil(p * n) of each column: (column, probability, value, value_text).

    A first scan sketches an interval around each rank.  Each further scan
    counts the values below, inside and at the ends of the intervals; then the
    inside is brought together if it is small, and sketched again, which makes
    it a five-hundredth, if not.  The counts decide, so a poor sketch costs a
    scan and no more.  No table is sorted or shuffled, and the driver sees a
    fixed number of scalars: three scans up to some million values, seven for 10^12.
    ``value_text`` has the digits of the column's own type, found by a further search where
    a double cannot hold them.
    """
    for name in columns:
        require_numeric(df, name)
    searches = []
    for group in in_groups(columns, COLUMNS_PER_SCAN):
        searches += _search(df, group, probabilities)
    rows = [(s.column, float(s.probability), s.value, _digits(df, s)) for s in searches]
    return df.sparkSession.createDataFrame(
        rows, "column string, probability double, value double, value_text string"
    )


def _digits(df: DataFrame, found: _Search) -> str | None:
    """The value in the column's own type, whose digits a double may have lost."""
    kind = df.schema[found.column].dataType
    if found.value is None:
        return None
    if isinstance(kind, T.LongType) and abs(found.value) < 2**53:
        return str(int(found.value))
    if not isinstance(kind, (T.LongType, T.DecimalType)):
        return str(int(found.value)) if isinstance(kind, T.IntegralType) else repr(found.value)
    # What is left beside the double is a smaller number; its place is that among the
    # values that share the double.
    column = qcol(found.column)
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    digits = Decimal(found.value).quantize(Decimal(1).scaleb(-scale), context=_CONTEXT)
    rest = column.cast(f"decimal(38,{scale})") - F.lit(str(digits)).cast(f"decimal(38,{scale})")
    same = column.cast("double") == F.lit(found.value)
    # NaN needs no mask: these types have none.
    places = df.agg(
        F.count_if(column.cast("double") < F.lit(found.value)).alias("below"), F.count_if(same).alias("n")
    ).first()
    near = df.filter(same).select(rest.cast(f"decimal(38,{scale})").alias("rest"))
    if near.agg(F.max(F.abs("rest"))).first()[0] == 0:
        return str(digits)
    place = (found.rank - places["below"] - 0.5) / places["n"]
    inner = _search(near, ["rest"], (place,))[0]
    return str(digits + Decimal(_digits(near, inner)))


def _search(df: DataFrame, columns: list[str], probabilities) -> list[_Search]:
    alias = {name: f"v{i}" for i, name in enumerate(columns)}
    # NaN needs no mask where it is compared: it is above every number.
    numbers = df.select([qcol(n).cast("double").alias(v) for n, v in alias.items()])
    searches = _first_intervals(numbers, alias, probabilities)
    while remaining := [s for s in searches if s.value is None and s.rank > 0]:
        _narrow(numbers, alias, remaining)
    return searches


def _first_intervals(numbers, alias, probabilities) -> list[_Search]:
    asked = {p: _around(p) for p in probabilities}
    cuts = sorted({q for pair in asked.values() for q in pair})
    valued = numbers.select([nan_to_null(F.col(v)).alias(v) for v in alias.values()])
    row = valued.selectExpr(
        *[f"count({v}) AS n_{v}" for v in alias.values()],
        *[f"{sketched_quantiles(v, cuts, SKETCH_ERROR)} AS q_{v}" for v in alias.values()],
    ).first()
    found = []
    for name, v in alias.items():
        n, values = row[f"n_{v}"], row[f"q_{v}"]
        for p in probabilities:
            if n == 0:
                found.append(_Search(name, p, 0, math.nan, math.nan))
            else:
                low, high = (values[cuts.index(q)] for q in asked[p])
                found.append(_Search(name, p, max(1, math.ceil(p * n)), low, high))
    return found


def _around(probability: float) -> tuple[float, float]:
    """A little below and above, so that the sketch's error stays inside."""
    margin = 2 * SKETCH_ERROR
    return max(0.0, probability - margin), min(1.0, probability + margin)


def _narrow(numbers: DataFrame, alias: dict[str, str], searches: list[_Search]) -> None:
    """Counts around the intervals, settles the searches it can, narrows the others."""
    counts = []
    for i, s in enumerate(searches):
        v, low, high = alias[s.column], _sql(s.low), _sql(s.high)
        counts += [f"count_if({v} < {low}) AS below_{i}", f"count_if({v} <= {high}) AS upto_{i}"]
        if s.low < s.high:
            counts += [
                f"count_if({v} = {low}) AS low_{i}",
                f"count_if({v} = {high}) AS high_{i}",
            ]
    row = numbers.selectExpr(*counts).first()
    between = []  # (search, values strictly inside, rank among them)
    for i, s in enumerate(searches):
        below, upto = row[f"below_{i}"], row[f"upto_{i}"]
        if s.low < s.high:
            at_low, at_high = row[f"low_{i}"], row[f"high_{i}"]
        else:
            at_low = at_high = upto - below
        if s.rank <= below:
            s.low, s.high = -math.inf, _next(s.low, -math.inf)
        elif s.rank > upto:
            s.low, s.high = _next(s.high, math.inf), math.inf
        elif s.rank <= below + at_low:
            s.value = s.low
        elif s.rank > upto - at_high:
            s.value = s.high
        else:
            between.append((s, upto - below - at_low - at_high, s.rank - below - at_low))
    if between:
        _look_inside(numbers, alias, between)


def _look_inside(numbers: DataFrame, alias: dict[str, str], between) -> None:
    """The value itself where few are inside the interval, a smaller interval elsewhere."""
    found, inner = [], []
    for i, (s, inside, rank) in enumerate(between):
        v = alias[s.column]
        inner.append(f"({v} > {_sql(s.low)} AND {v} < {_sql(s.high)})")
        held = f"CASE WHEN {inner[i]} THEN {v} END"
        if inside <= KEPT:
            found.append(f"array(sort_array(collect_list({held}))[{rank - 1}]) AS f_{i}")
        else:
            cuts = list(_around((rank - 0.5) / inside))
            found.append(f"{sketched_quantiles(held, cuts, SKETCH_ERROR)} AS f_{i}")
    row = numbers.filter(" OR ".join(inner)).selectExpr(*found).first()
    for cut, (s, _, _) in zip(row, between):
        if len(cut) == 1:
            s.value = cut[0]
        else:
            s.low, s.high = cut


def _sql(value: float) -> str:
    return f"double('{value!r}')"


def _next(value: float, towards: float) -> float:
    return float(np.nextafter(value, towards))


def rank_error(df: DataFrame, column: str, estimates: list[tuple[float, float]]) -> DataFrame:
    """How far each (probability, value) is from its rank, as a share of the rows."""
    require_numeric(df, column)
    numbers = df.select(nan_to_null(qcol(column).cast("double")).alias("v"))
    n, entries = "count(v)", []
    for p, x in estimates:
        under = f"count_if(v < {_sql(x)}) - {n} * {p!r}D"
        over = f"{n} * {p!r}D - count_if(v <= {_sql(x)})"
        entries.append(
            f"struct({p!r}D AS probability, {_sql(x)} AS value, "
            f"greatest({under}, {over}, 0D) / {n} AS rank_error)"
        )
    return numbers.selectExpr(f"array({', '.join(entries)}) AS errors").selectExpr("inline(errors)")
