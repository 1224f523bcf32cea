"""Global positions and running totals without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprof.scratch import write_once

# monotonically_increasing_id() keeps the partition in the bits above this one.
_PARTITION_SHIFT = 33


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the 0-based place of each row in a global order.

    Rows are range-partitioned and sorted once and written with their place in
    their partition; the partition sizes (one row each) then give the offsets.
    """
    sorted_ = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    written = write_once(sorted_, "sorted")
    placed = written.withColumn("_part", F.shiftright("_place", _PARTITION_SHIFT))
    inside = F.col("_place") - F.shiftleft(F.col("_part"), _PARTITION_SHIFT)
    if _in_one_part(written):
        return placed.select(*df.columns, inside.alias(name))
    offsets = _offsets(placed, {"_before": F.count(F.lit(1))})
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + inside).alias(name)
    )


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """Adds, for each ``{new: column}``, the sum over all rows earlier in the order.

    Meant for grouped rows, whose order values are distinct.
    """
    ranged = df.orderBy(*order).withColumn("_part", F.spark_partition_id())
    placed = write_once(ranged, "sorted")
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = {new: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for new, c in totals.items()}
    if _in_one_part(placed):
        return placed.select(*df.columns, *[sum_.alias(new) for new, sum_ in inside.items()])
    offsets = _offsets(placed, {f"_{new}": F.sum(c) for new, c in totals.items()})
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, *[(sum_ + F.col(f"_{new}")).alias(new) for new, sum_ in inside.items()]
    )


def _in_one_part(written: DataFrame) -> bool:
    """True if all rows were sorted in one task, so that nothing comes before them.

    Every task that had rows wrote a file of its own.
    """
    return len(written.inputFiles()) <= 1


def _offsets(placed: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """What comes before each partition: one row per partition of the sort."""
    per_part = placed.groupBy("_part").agg(*[t.alias(n) for n, t in totals.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in totals]
    )
