"""Descriptive statistics of numeric and string columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprof.columns import (
    in_groups,
    is_floating,
    literal,
    numeric_columns,
    qcol,
    quoted,
    require_columns,
    require_numeric,
    string_columns,
)
from sparkprof.functions.rounding import rounded
from sparkprof.functions.text import display_stat, or_default
from sparkprof.operators.quantiles import exact_quantiles, sketched_quantiles
from sparkprof.scratch import write_once

QUARTILES = [0.25, 0.5, 0.75]
COLUMNS_PER_SCAN = 100
DECIMALS = 4
STATS_SCHEMA = (
    "column string, count bigint, nan_count bigint, mean double, std double, min double, "
    "q1 double, median double, q3 double, max double, min_text string, max_text string"
)
ROUNDED = ("mean", "std", "q1", "median", "q3")
SHORT_TEXT = 64
# Values of a table that are grouped at once; of larger ones, values that a task combines and groups.
VALUES_AT_ONCE = 2_000_000
VALUES_COMBINED = 500_000
VALUES_PER_TASK = 1_000_000
_KEY = ["column", "beginning", "digest"]


def numeric_stats(
    df: DataFrame, columns: list[str] | None = None, quantile_error: float = 0.001
) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, one row per column.

    All columns share one compiled aggregate and one of quantile sketches, each
    over a column-pruned scan.  NaN is left out like NULL and counted in
    ``nan_count``; a statistic that is not finite is NULL.  Quartiles are within
    ``quantile_error`` of their rank; with 0 they are searched exactly, which
    runs a few more scans at once.  ``min_text`` and ``max_text`` keep the digits
    a double would lose.
    """
    columns = numeric_columns(df) if columns is None else columns
    for name in columns:
        require_numeric(df, name)
    if not columns:
        return df.sparkSession.createDataFrame([], STATS_SCHEMA)
    parts = [
        _numeric_group(df, group, quantile_error) for group in in_groups(columns, COLUMNS_PER_SCAN)
    ]
    return reduce(DataFrame.unionAll, parts)


def _exact_cuts(df: DataFrame, columns: list[str]) -> str:
    """The exact quartiles as a literal in the layout of the sketched ones."""
    found = {(r["column"], r["probability"]): r["value"]
             for r in exact_quantiles(df, columns, tuple(QUARTILES)).collect()}
    number = lambda x: "NULL" if x is None else f"'{x!r}'"
    cuts = [", ".join(number(found[(c, p)]) for p in QUARTILES) for c in columns]
    return "struct(" + ", ".join(
        f"CAST(array({c}) AS ARRAY<DOUBLE>) AS cuts_{i}" for i, c in enumerate(cuts)
    ) + ")"


def _numeric_group(df: DataFrame, columns: list[str], quantile_error: float) -> DataFrame:
    # Written as SQL text: a wide table makes many expressions, and text is
    # handed to the engine at once.
    values, aggregates, sketches, entries = [], [], [], []
    for i, name in enumerate(columns):
        column = quoted(name)
        nan = f"isnan({column})" if is_floating(df.schema[name].dataType) else "false"
        values += [
            f"if({nan}, NULL, {column}) AS v{i}",
            f"double(if({nan}, NULL, {column})) AS d{i}",
            f"{nan} AS nan{i}",
        ]
        aggregates += [
            f"count(v{i}) AS count_{i}",
            f"count_if(nan{i}) AS nans_{i}",
            f"double(avg(v{i})) AS mean_{i}",
            f"stddev_samp(d{i}) AS std_{i}",
            f"min(v{i}) AS min_{i}",
            f"max(v{i}) AS max_{i}",
        ]
        if quantile_error:
            sketch = sketched_quantiles(f"d{i}", QUARTILES, quantile_error)
            sketches.append(f"{sketch} AS cuts_{i}")
        cut = [_finite(f"cuts.cuts_{i}[{k}]") for k in range(3)]
        entries.append(
            f"struct({literal(name)} AS column, count_{i} AS count, nans_{i} AS nan_count, "
            f"{_finite(f'mean_{i}')} AS mean, {_finite(f'std_{i}')} AS std, "
            f"{_finite(f'double(min_{i})')} AS min, "
            f"{cut[0]} AS q1, {cut[1]} AS median, {cut[2]} AS q3, "
            f"{_finite(f'double(max_{i})')} AS max, "
            f"string(min_{i}) AS min_text, string(max_{i}) AS max_text)"
        )
    numbers = df.selectExpr(*values)
    # Sketches would keep the other aggregates from being compiled, so they are
    # an aggregate of their own: a scalar of the plan.
    if quantile_error:
        cuts = numbers.selectExpr(*sketches).select(F.struct("*")).scalar()
    else:
        cuts = F.expr(_exact_cuts(df, columns))
    rows = numbers.selectExpr(*aggregates).withColumn("cuts", cuts)
    stats = rows.selectExpr(f"inline(array({', '.join(entries)}))")
    values = F.transform(F.array(*ROUNDED), lambda value: rounded(value, DECIMALS))
    return stats.withColumns({c: values[i] for i, c in enumerate(ROUNDED)})


def _finite(value: str) -> str:
    return f"if(abs({value}) < double('inf'), {value}, NULL)"


def long_form(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """(column, value) for every string column of every row, NULL included."""
    columns = string_columns(df) if columns is None else columns
    require_columns(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string")
    strings = df.select([qcol(n).cast("string").alias(f"c{i}") for i, n in enumerate(columns)])
    names = F.create_map(*[F.lit(x) for i, n in enumerate(columns) for x in (f"c{i}", n)])
    return strings.unpivot([], [f"c{i}" for i in range(len(columns))], "place", "value").select(
        names[F.col("place")].alias("column"), "value"
    )


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Frequency of every value of the string columns, NULL being a value.

    Rows are combined before the shuffle, so a value that fills the table
    arrives as one row per task.
    """
    return long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, distinct values (NULL counts as one) and the most frequent value.

    Ties go to the smaller value, NULL last; a column of an empty table has counts of 0.
    Values are grouped by their first characters and, if longer, a SHA-256 of the
    whole text, so that long texts are not shuffled.  The groups are written once; a
    second scan reads the long texts that may win and takes the smallest.  In tables of
    more than ``VALUES_AT_ONCE`` values no task holds more than a fixed number of values.
    """
    columns = string_columns(df) if columns is None else columns
    rows = long_form(df, columns)
    beginning = F.substring("value", 1, SHORT_TEXT).alias("beginning")
    digest = F.when(F.length("value") > SHORT_TEXT, F.sha2("value", 256)).alias("digest")
    keyed = rows.select("column", "value", beginning, digest)
    groups = write_once(_groups(keyed, df.count() * len(columns)), "groups")
    counts = groups.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("freq")
    )
    # One row per column on the right.
    tied = groups.join(F.broadcast(counts.select("column", F.col("freq").alias("n"))), ["column", "n"])
    first = _least(tied.select("column", F.col("beginning").alias("text"))).withColumnRenamed("text", "beginning")
    # A text that is its own beginning comes before all longer ones.
    winners = tied.join(first, ["column", "beginning"]).groupBy("column", "beginning").agg(
        F.bool_or(F.col("digest").isNull()).alias("short")
    )
    long = tied.join(winners.filter("not short"), ["column", "beginning"]).select("column", "digest")
    texts = keyed.filter("digest IS NOT NULL").join(long, ["column", "digest"])
    texts = _least(texts.select("column", F.col("value").alias("text")))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    best = named.join(counts, "column", "left").join(
        winners.filter("short").select("column", "beginning"), "column", "left"
    )
    return best.join(texts, "column", "left").select(
        "column", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("unique", F.lit(0)).alias("unique"),
        F.coalesce("text", "beginning").alias("top"), F.coalesce("freq", F.lit(0)).alias("freq"),
    )


def _groups(keyed: DataFrame, values: int) -> DataFrame:
    """``column, beginning, digest, n``; what a task holds does not grow with its share of a file."""
    if values <= VALUES_AT_ONCE:
        return keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    combined = keyed.select(*_KEY).mapInArrow(_combined, "column string, beginning string, digest string, n bigint")
    spread = combined.repartition(-(-values // VALUES_PER_TASK), *_KEY)
    return spread.groupBy(*_KEY).agg(F.sum("n").alias("n"))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of so many values at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= VALUES_COMBINED:
            yield from _counted(held)
            held, rows = [], 0
    if held:
        yield from _counted(held)


def _counted(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    counts = pa.Table.from_batches(batches).group_by(_KEY).aggregate([([], "count_all")])
    return counts.select([*_KEY, "count_all"]).rename_columns([*_KEY, "n"]).to_batches()


def _least(rows: DataFrame) -> DataFrame:
    """The smallest ``text`` of each ``column``; NULL only if it has no other.

    An aggregate of texts alone would sort all rows of a task.
    """
    few = rows.mapInArrow(_smallest, "column string, text string")
    return few.groupBy("column").agg(F.min("text").alias("text"))


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, str | None] = {}
    for batch in batches:
        for name in pc.unique(batch["column"]).to_pylist():
            text = pc.min(batch["text"].filter(pc.equal(batch["column"], name))).as_py()
            known = found.get(name)
            found[name] = known if text is None else text if known is None else min(known, text, key=str.encode)
    if found:
        names = pa.array(list(found), pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array(list(found.values()), pa.string())], ["column", "text"])


def stats_table(numeric: DataFrame) -> DataFrame:
    """Numeric statistics as display text, in reading order."""
    shown = ("mean", "std", "min", "q1", "median", "q3", "max")
    texts = F.transform(F.array(*[F.col(c).cast("double") for c in shown]), display_stat)
    return numeric.select("column", "count", *[texts[i].alias(c) for i, c in enumerate(shown)])


def categories_table(categorical: DataFrame) -> DataFrame:
    """String statistics with an empty or missing mode shown as not available."""
    top = or_default(F.nullif(F.col("top"), F.lit("")))
    return categorical.select("column", "count", "unique", top.alias("top"), "freq")
