"""String indexing by frequency for any number of distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprof.columns import qcol, require_columns
from sparkprof.operators.ordering import numbered

# Values that at least one in so many rows has are matched in place; the others are
# joined by a shuffle, where none of them is hot.
HOT_SHARE = 50_000
# Longer values are matched by their digest, so what is sent to every task is bounded.
SHORT_TEXT = 64


def index_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n, index): the most frequent value is 0, ties are alphabetical.

    Counts are combined before the shuffle; the values are then sorted and
    numbered across the cluster and written once.
    """
    require_columns(df, [column])
    counts = (
        df.select(qcol(column).alias("value"))
        .filter("value IS NOT NULL")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return numbered(counts, [F.desc("n"), F.asc("value")], "index")


def apply_index(
    df: DataFrame,
    column: str,
    values: DataFrame,
    output: str | None = None,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Adds the index of each row's value as a double.

    Values the index does not know (and NULL) get the next free index.  The rows are read
    once: a first join matches the hot values without moving the data, a second one the
    rest by a shuffle, in which matched rows and NULLs are spread by their place.
    """
    output = output or f"{column}_indexed"
    require_columns(df, [column])
    lookup = values.select(_matched(F.col("value")).alias("_key"), F.col("index").alias("_index"), "n")
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    size = values.agg(F.count(F.lit(1))).scalar()
    frequent = F.col("n") * hot_share >= total
    # At most hot_share rows of some hundred bytes.
    hot = lookup.filter(frequent).select("_key", F.col("_index").alias("_hot"))
    cold = lookup.filter(~frequent).select(
        F.lit(True).alias("_left"), F.col("_key").alias("_rest"), F.col("_index").alias("_cold")
    )
    rows = df.withColumn("_key", _matched(qcol(column).cast("string"))).join(F.broadcast(hot), "_key", "left")
    left = F.col("_hot").isNull() & F.col("_key").isNotNull()
    spread = F.monotonically_increasing_id().cast("string")
    rows = rows.withColumn("_left", left)
    rows = rows.withColumn("_rest", F.when(F.col("_left"), F.col("_key")).otherwise(spread))
    index = F.coalesce("_hot", "_cold", size).cast("double").alias(output)
    kept = [qcol(n) for n in df.columns if n != output]
    return rows.join(cold, ["_left", "_rest"], "left").select(*kept, index)


def _matched(value: Column) -> Column:
    """What stands for a value in a join: itself or, if long, a longer mark with its digest."""
    digest = F.concat(F.lit("#"), F.sha2(value, 256))
    return F.when(F.length(value) > SHORT_TEXT, digest).otherwise(value)
