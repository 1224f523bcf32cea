"""Stored profiles that grow with their table: one mergeable state per file and column.

A state holds counts, moments, extremes and sketches (quantiles, distinct values, frequent
values).  Files that are added to a table are scanned alone; the profile of the whole
table is the merger of the states of its files, a few kilobytes each.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprof.columns import in_groups, is_floating, literal, logical_type, qcol, quoted
from sparkprof.operators.describe import DECIMALS, QUARTILES
from sparkprof.operators.frequent import distinct_bounds, distinct_key, registers, summary_key
from sparkprof.functions.rounding import rounded
from sparkprof.scratch import temporary, write_once

# Sizes of the sketches of a state: a quantile's rank within 0.7 %, distinct values within 1.6 % (standard
# error), frequent values within 1 / 1000 of the rows.
QUANTILE_SIZE = 512
DISTINCT_ERROR = 0.01625
TRACKED = 3000
COLUMNS_PER_SCAN = 20
STATE_SCHEMA = (
    "file string, column string, position int, type string, spark_type string, nullable boolean, "
    "rows bigint, nulls bigint, nans bigint, n bigint, mean double, squares double, min double, max double, "
    "quantiles binary, distinct binary, "
    "frequent struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>"
)


def states(df: DataFrame, by_file: bool = True) -> DataFrame:
    """The state of every column of every file the rows come from (``STATE_SCHEMA``).

    With ``by_file`` off, or for rows that come from no file, there is one state per column
    (``file`` is empty then).  Up to 20 columns share a scan; what is shuffled are the
    states of the tasks.  A table without rows has no states of files.
    """
    parts = [_group_states(df, names, by_file) for names in in_groups(df.columns, COLUMNS_PER_SCAN)]
    return reduce(DataFrame.unionByName, parts)


def _group_states(df: DataFrame, names: list[str], by_file: bool) -> DataFrame:
    places = {name: place for place, name in enumerate(df.columns)}
    values, aggregates, entries = [], ["count(*) AS rows"], []
    for name in names:
        field, i = df.schema[name], places[name]
        kind = logical_type(field.dataType)
        nan = f"isnan({quoted(name)})" if is_floating(field.dataType) else "false"
        number = f"double({quoted(name)})" if kind in ("integer", "numeric") else "CAST(NULL AS DOUBLE)"
        text = summary_key(qcol(name)) if kind == "string" else F.lit(None).cast("string")
        values += [
            F.expr(f"CASE WHEN NOT {nan} THEN {number} END").alias(f"x{i}"), F.expr(nan).alias(f"nan{i}"),
            qcol(name).isNotNull().alias(f"there{i}"), distinct_key(df, name).alias(f"d{i}"), text.alias(f"t{i}"),
        ]
        aggregates += [
            f"count_if(NOT there{i}) AS nulls{i}", f"count_if(nan{i}) AS nans{i}", f"count(x{i}) AS n{i}",
            f"avg(x{i}) AS mean{i}", f"coalesce(var_pop(x{i}) * count(x{i}), 0D) AS squares{i}",
            f"min(x{i}) AS min{i}", f"max(x{i}) AS max{i}",
            f"hll_sketch_agg(d{i}, {registers(DISTINCT_ERROR)}) AS distinct{i}",
        ]
        number_too, text_too = kind in ("integer", "numeric"), kind == "string"
        if number_too:
            aggregates.append(f"kll_sketch_agg_double(x{i}, {QUANTILE_SIZE}) AS quantiles{i}")
        if text_too:
            aggregates.append(f"approx_top_k_accumulate(t{i}, {TRACKED}) AS frequent{i}")
        sketch = f"CASE WHEN n{i} > 0 THEN quantiles{i} END" if number_too else "CAST(NULL AS BINARY)"
        top = f"frequent{i}" if text_too else "NULL"
        frequent = STATE_SCHEMA.split("frequent ")[1].replace(": ", ":")
        entries.append(
            f"struct({literal(name)} AS column, {i} AS position, {literal(kind)} AS type, "
            f"{literal(field.dataType.simpleString())} AS spark_type, {str(field.nullable).lower()} AS nullable, rows, "
            f"nulls{i} AS nulls, nans{i} AS nans, n{i} AS n, mean{i} AS mean, squares{i} AS squares, min{i} AS min, "
            f"max{i} AS max, {sketch} AS quantiles, distinct{i} AS distinct, CAST({top} AS {frequent}) AS frequent)"
        )
    file = F.input_file_name() if by_file else F.lit("")
    found = df.select(*values, file.alias("file")).groupBy("file").agg(*[F.expr(a) for a in aggregates])
    return found.selectExpr("file", f"inline(array({', '.join(entries)}))")


def merged(stored: DataFrame) -> DataFrame:
    """One state per column from the states of several files (``file`` is empty).

    Moments are merged about the common mean, so no precision is lost to their size.
    """
    mean = F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n"))
    sums = stored.groupBy("column").agg(
        *[F.first(c).alias(c) for c in ("type", "spark_type")], F.min("position").alias("position"),
        F.bool_or("nullable").alias("nullable"), *[F.sum(c).alias(c) for c in ("rows", "nulls", "nans", "n")],
        mean.alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.expr("kll_merge_agg_double(quantiles)").alias("quantiles"),
        F.expr("hll_union_agg(distinct)").alias("distinct"),
    )
    # The spread within the files and that of their means about the common one.
    means = sums.select("column", F.col("mean").alias("centre"))
    spread = stored.filter("n > 0").join(means, "column").groupBy("column").agg(
        F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("centre"), F.lit(2))).alias("squares")
    )
    # Columns without texts have no summary to combine.
    frequent = stored.filter("frequent IS NOT NULL").groupBy("column").agg(
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent")
    )
    joined = sums.join(spread, "column", "left").join(frequent, "column", "left")
    names = [c.split()[0] for c in STATE_SCHEMA.split(", ")[:16]]
    return joined.withColumns({"file": F.lit(""), "squares": F.coalesce("squares", F.lit(0.0))}).select(
        *names[:14], F.when(F.col("n") > 0, F.col("quantiles")).alias("quantiles"), "distinct", "frequent"
    )


def described(whole: DataFrame) -> DataFrame:
    """The profile that merged states stand for, one row per column.

    Exact: rows, NULLs and NaN, mean, sample deviation, extremes.  Sketched: quartiles, the
    number of distinct values (NULL is one) with its bounds, and the most frequent text (a long
    one as its digest) with an upper bound of its frequency.
    """
    cut = F.when(F.col("quantiles").isNotNull(), F.expr(
        f"kll_sketch_get_quantile_double(quantiles, array({', '.join(f'{q}D' for q in QUARTILES)}))"
    ))
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    deviation = F.sqrt(F.col("squares") / F.when(F.col("n") > 1, F.col("n") - 1))
    out = whole.withColumns({
        "cut": cut, "estimate": F.expr("hll_sketch_estimate(distinct)"),
        "top": F.when(F.col("frequent").isNotNull(), F.expr("approx_top_k_estimate(frequent, 1)"))[0],
    })
    shown = {"mean": F.col("mean"), "std": deviation, "q1": F.col("cut")[0], "median": F.col("cut")[1], "q3": F.col("cut")[2]}
    return out.select(
        "position", "column", "type", "spark_type", "nullable", F.col("rows").alias("row_count"),
        (F.col("nulls") + F.col("nans")).alias("null_count"), F.col("nans").alias("nan_count"),
        (F.col("rows") - F.col("nulls")).alias("non_null_count"), F.col("n").alias("count"),
        finite(F.col("min")).alias("min"), finite(F.col("max")).alias("max"),
        *[rounded(finite(c), DECIMALS).alias(n) for n, c in shown.items()],
        *distinct_bounds(F.col("estimate"), F.col("nulls") > 0, DISTINCT_ERROR),
        F.substring("top.item", 2, 1 << 20).alias("top"), F.col("top.count").alias("freq_at_most"),
    )


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    """All states kept under a path; none if nothing was kept yet."""
    try:
        return spark.read.schema(STATE_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE_SCHEMA)


def refresh(table: DataFrame, path: str) -> list[str]:
    """Keeps the states of those files of a table that have none yet; returns these files.

    ``table`` is a plain scan of Parquet files.  Only new files are read.
    """
    spark = table.sparkSession
    known = {r["file"] for r in stored_states(spark, path).select("file").distinct().collect()}
    new = sorted(set(table.inputFiles()) - known)
    if new:
        with temporary(spark):
            # Files are named by their encoded addresses.
            scan = spark.read.schema(table.schema).parquet(*map(unquote, new))
            found = write_once(states(scan), "states")
            named = {r["file"] for r in found.select("file").distinct().collect()}
            if not named <= set(new):
                raise RuntimeError(f"rows name other files than the table: {sorted(named - set(new))[:3]}")
            # A file without rows is kept by its name alone, so that it is not read again.
            empty = spark.createDataFrame([(f,) for f in new if f not in named], "file string")
            found.unionByName(_without_rows(empty)).write.mode("append").parquet(path)
    return new


def _without_rows(files: DataFrame) -> DataFrame:
    fields = files.sparkSession.createDataFrame([], STATE_SCHEMA).schema.fields[1:]
    return files.select("file", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def table_profile(table: DataFrame, path: str) -> DataFrame:
    """The profile of a table from the states kept of its files; new files are scanned first.

    States of files that no longer belong to the table are left out.
    """
    refresh(table, path)
    files = table.sparkSession.createDataFrame([(f,) for f in sorted(set(table.inputFiles()))], "file string")
    kept = stored_states(table.sparkSession, path).filter("column IS NOT NULL").join(files, "file", "left_semi")
    return described(merged(kept))
