"""Equal-width histogram of one numeric column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprof.columns import qcol, require_numeric
from sparkprof.functions.missing import finite_or_null
from sparkprof.functions.rounding import rounded
from sparkprof.functions.text import two_decimals

MAX_BINS = 100
DECIMALS = 4


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, label, count, min, max) for every bin, empty ones included.

    A bin holds ``lo <= x < hi``, the last one its upper bound and the maximum
    too.  A constant column has bins of width 1; a column without finite values
    has no bins.  Two column-pruned scans (bounds, then counts), whatever the
    number of bins; the shuffle carries at most ``bins`` rows per task.
    """
    if not 1 <= bins <= MAX_BINS:
        raise ValueError(f"bins must be between 1 and {MAX_BINS}")
    require_numeric(df, column)
    values = df.select(finite_or_null(qcol(column).cast("double")).alias("x"))
    values = values.filter("x IS NOT NULL")
    low, high = F.col("low"), F.col("high")
    bounds = values.agg(F.min("x").alias("low"), F.max("x").alias("high")).select(
        "low", F.when(high != low, (high - low) / bins).otherwise(1.0).alias("width")
    )
    scalar = bounds.select(F.struct("low", "width")).scalar()
    low, width = scalar.getField("low"), scalar.getField("width")

    x, last = F.col("x"), bins - 1
    guess = F.least(F.floor((x - low) / width).cast("int"), F.lit(last))
    guess = F.greatest(guess, F.lit(0)).alias("guess")
    # The quotient may fall on the wrong side of a bound; the bounds decide.
    at = F.col("guess")
    settled = (
        F.when((at > 0) & (x < low + at * width), at - 1)
        .when((at < last) & (x >= low + (at + 1) * width), at + 1)
        .otherwise(at)
    )
    counts = (
        values.select("x", guess)
        .select(settled.alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edges = bounds.filter("low IS NOT NULL").select(
        "low", "width", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("bin")
    )
    lower = F.col("low") + F.col("bin") * F.col("width")
    upper = F.col("low") + (F.col("bin") + 1) * F.col("width")
    shown = F.transform(
        F.array(lower, upper),
        lambda v: F.struct(two_decimals(v).alias("text"), rounded(v, DECIMALS).alias("value")),
    )
    # At most MAX_BINS rows on either side.
    return (
        edges.join(F.broadcast(counts), "bin", "left")
        .withColumn("shown", shown)
        .select(
            "bin",
            F.concat_ws("-", "shown.text").alias("label"),
            F.coalesce("n", F.lit(0)).alias("count"),
            F.col("shown.value")[0].alias("min"),
            F.col("shown.value")[1].alias("max"),
        )
    )
