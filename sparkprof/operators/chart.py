"""Points of a line chart: as many as its pixels need, whatever the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprof.columns import qcol, require_numeric

# Fixed value.
MAX_POINTS = 10_000


def chart_points(df: DataFrame, x: str, y: str, columns: int = MAX_POINTS // 4) -> DataFrame:
    """(x, y) of a line, in its order, that draws the same at ``columns`` pixels of width.

    All rows if there are no more than ``MAX_POINTS``.  Otherwise the width is cut into
    columns of equal length, and of each the first, the last, the lowest and the highest
    point stay: between them a line covers the same pixels.  Of points of one x the lowest
    comes first; of equal ones in y the first in x stays.  Rows with a missing number are left
    out.  Two scans; what is shuffled are four points per task and column.
    """
    for name in (x, y):
        require_numeric(df, name)
    if not 1 <= columns <= MAX_POINTS // 4:
        raise ValueError(f"columns must be between 1 and {MAX_POINTS // 4}")
    points = df.select(qcol(x).cast("double").alias("x"), qcol(y).cast("double").alias("y"))
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    points = points.filter(real("x") & real("y"))
    ends = points.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if ends["n"] <= MAX_POINTS:
        return points.orderBy("x", "y")
    width = (ends["high"] - ends["low"]) / columns
    # A single x is a column of its own; the last point is in the last column.
    column = F.least(F.lit(columns - 1), F.floor((F.col("x") - ends["low"]) / width)) if width > 0 else F.lit(0)
    along, across = F.struct("x", "y"), F.struct("y", "x")
    kept = points.groupBy(column.alias("column")).agg(
        F.min(along).alias("first"), F.max(along).alias("last"), F.min(across).alias("lowest"),
        F.max(F.struct("y", (-F.col("x")).alias("back"))).alias("highest"),
    )
    corner = lambda p, x: F.struct(x.alias("x"), F.col(f"{p}.y").alias("y"))
    corners = F.array(
        *[corner(p, F.col(f"{p}.x")) for p in ("first", "last", "lowest")], corner("highest", -F.col("highest.back")),
    )
    return kept.select(F.inline(F.array_distinct(corners))).orderBy("x", "y")
