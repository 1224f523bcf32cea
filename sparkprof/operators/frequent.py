"""Most frequent and distinct values without a shuffle of all values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprof.columns import in_groups, qcol, require_columns, string_columns
from sparkprof.operators.describe import SHORT_TEXT, categorical_stats, long_form

# Values a summary follows per column and task, and those that are counted in the second scan.
TRACKED = 3000
CANDIDATES = 50
COLUMNS_PER_SCAN = 20
MODES_SCHEMA = "column string, count bigint, top string, freq bigint, summarised boolean"
# Sketches have 2^4 to 2^21 registers; estimates are within so many standard errors.
REGISTERS = (4, 21)
SIGMAS = 3


def modes(
    df: DataFrame, columns: list[str] | None = None, tracked: int = TRACKED, candidates: int = CANDIDATES
) -> DataFrame:
    """Rows and the most frequent value of string columns: ``column, count, top, freq, summarised``.

    A first scan keeps a frequent-items summary of ``tracked`` values per task, merged across
    tasks.  Its estimates are upper bounds, so no value beyond its first ``candidates`` is more
    frequent than the last of them, or than what a summary of this size may miss.  A second scan
    counts only these: the winner is exact where it is above that bound, or where the candidates
    are all values.  Columns for which this does
    not decide (values that hardly repeat) are counted in full, as ``categorical_stats`` does;
    ``summarised`` tells which.  The scans run at once; the driver sees candidates only.

    NULL is a value; ties go to the smaller text, NULL last.  Columns of an empty table
    have counts of 0.
    """
    columns = list(dict.fromkeys(string_columns(df) if columns is None else columns))
    require_columns(df, columns)
    proposed, total = {}, 0
    for group in in_groups(columns, COLUMNS_PER_SCAN):
        keys = df.select(*[summary_key(qcol(c)).alias(f"k{i}") for i, c in enumerate(group)])
        row = keys.selectExpr(
            "count(*)", *[f"approx_top_k(k{i}, {candidates}, {tracked})" for i in range(len(group))]
        ).first()
        total = row[0]
        proposed |= {c: [(x["item"], x["count"]) for x in found or []] for c, found in zip(group, row[1:])}
    counted = _counted(df, proposed)
    decided, ties = [], []
    for name in columns if total else ():
        counts = counted[name]
        most = max(counts.values(), default=0)
        items = proposed[name]
        last = items[-1][1] if len(items) == candidates else 0
        if most > max(last, missed(total, tracked)) or sum(counts.values()) == total:
            decided.append((name, total, None, most, True))
            ties += [(name, key) for key, n in counts.items() if n == most]
    texts = _smallest(df, ties)
    found = df.sparkSession.createDataFrame(
        [(c, n, texts.get(c), freq, by) for c, n, _, freq, by in decided], MODES_SCHEMA
    )
    rest = [c for c in columns if c not in {d[0] for d in decided}]
    if not rest:
        return found
    full = categorical_stats(df, rest).select("column", "count", "top", "freq", F.lit(False).alias("summarised"))
    return found.unionByName(full) if decided else full


def missed(rows: int, tracked: int) -> int:
    """How often a value may occur that a summary does not list.

    Published bound: a map of M places (a power of two, three quarters of them used) is off by
    up to 3.5 / M of the rows, and lists what is above that even if it is off.
    """
    places = 2 ** math.ceil(math.log2(math.ceil(tracked / 0.75)))
    return math.ceil(2 * 3.5 / places * rows)


def summary_key(value: Column) -> Column:
    """What stands for a text in a summary: itself, or the SHA-256 of a long one; NULL stays."""
    text = value.cast("string")
    return F.when(F.length(text) > SHORT_TEXT, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(
        F.concat(F.lit("="), text)
    )


def _counted(df: DataFrame, proposed: dict[str, list[tuple[str | None, int]]]) -> dict[str, dict]:
    """The exact count of every proposed key, from one scan."""
    found: dict[str, dict] = {c: {} for c in proposed}
    wanted = [(c, key) for c, items in proposed.items() for key, _ in items]
    if wanted:
        for row in _rows_of(df, wanted).groupBy("column", "key").agg(F.count(F.lit(1)).alias("n")).collect():
            found[row["column"]][row["key"]] = row["n"]
    return found


def _rows_of(df: DataFrame, wanted: list[tuple[str, str | None]]) -> DataFrame:
    """(column, value, key) of the rows with one of the keys, of which there is a bounded number."""
    names = list(dict.fromkeys(c for c, _ in wanted))
    keyed = long_form(df, names).withColumn("key", summary_key(F.col("value")))
    keys = df.sparkSession.createDataFrame(wanted, "column string, key string")
    same = (keyed["column"] == keys["column"]) & keyed["key"].eqNullSafe(keys["key"])
    return keyed.join(F.broadcast(keys), same, "left_semi")


def _smallest(df: DataFrame, ties: list[tuple[str, str | None]]) -> dict[str, str]:
    """The smallest text among the keys of each column; long ones are read from the rows."""
    short: dict[str, list[str]] = {}
    for name, key in ties:
        short.setdefault(name, []).extend([key[1:]] if key is not None and key[0] == "=" else [])
    texts = {c: min(t, key=str.encode) for c, t in short.items() if t}
    long = [(c, key) for c, key in ties if key is not None and key[0] == "#"]
    if long:
        for row in _rows_of(df, long).groupBy("column").agg(F.min("value").alias("text")).collect():
            texts[row["column"]] = min([row["text"], *([texts[row["column"]]] if row["column"] in texts else [])], key=str.encode)
    return texts


def registers(error: float) -> int:
    """The binary logarithm of the registers for a relative standard error."""
    need = math.ceil(2 * math.log2(1.04 / error))
    if need > REGISTERS[1]:
        raise ValueError(f"no sketch keeps a standard error of {error}; use exact counts")
    return max(REGISTERS[0], need)


def distinct_counts(df: DataFrame, columns: list[str] | None = None, error: float = 0.005) -> DataFrame:
    """Estimated distinct values of any columns: ``column, distinct, low, high``; NULL counts as one.

    Each column is a sketch of fixed size, so one scan shuffles one sketch per task and column
    whatever the number of values.  ``error`` is the relative standard error; the true number is
    between ``low`` and ``high``, three of them away, with probability 0.997.  NaN is one
    value; columns of an empty table have 0.
    """
    columns = list(dict.fromkeys(df.columns if columns is None else columns))
    require_columns(df, columns)
    size, parts = registers(error), []
    for group in in_groups(columns, COLUMNS_PER_SCAN):
        values = df.select(*[distinct_key(df, c).alias(f"v{i}") for i, c in enumerate(group)])
        row = values.selectExpr(*[
            f"struct(hll_sketch_estimate(hll_sketch_agg(v{i}, {size})) AS n, count(*) > count(v{i}) AS missing) AS e{i}"
            for i in range(len(group))
        ])
        names = F.array(*[
            F.struct(F.lit(c).alias("column"), *distinct_bounds(F.col(f"e{i}.n"), F.col(f"e{i}.missing"), error))
            for i, c in enumerate(group)
        ])
        parts.append(row.select(F.inline(names)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_key(df: DataFrame, name: str) -> Column:
    """A value as a sketch takes it: numbers and texts as they are, anything else as text."""
    kind = df.schema[name].dataType.simpleString()
    value = qcol(name)
    if kind in ("int", "bigint", "string", "binary"):
        return value
    if kind in ("tinyint", "smallint"):
        return value.cast("int")
    if kind in ("float", "double"):
        # 0 and -0 are one value.
        return (value + F.lit(0.0)).cast("string")
    return value.cast("string") if not kind.startswith(("array", "map", "struct")) else F.to_json(F.struct(value))


def distinct_bounds(estimate: Column, missing: Column, error: float) -> list[Column]:
    """``distinct``, ``low`` and ``high`` from the estimate of the values that are not NULL."""
    one = missing.cast("bigint")
    spread = SIGMAS * error
    return [
        (estimate + one).alias("distinct"),
        (F.floor(estimate / (1 + spread)) + one).alias("low"),
        (F.ceil(estimate / (1 - spread)) + one).alias("high"),
    ]
