"""Column profile: types, missing values and row counts in one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from sparkprof.columns import in_groups, is_floating, literal, logical_type, quoted

COLUMNS_PER_SCAN = 200


def profile(df: DataFrame) -> DataFrame:
    """One row per column.

    ``null_count`` counts NULL and NaN, ``non_null_count`` everything but NULL,
    ``nan_count`` what is in both.  All columns share one aggregate; tables wider
    than ``COLUMNS_PER_SCAN`` take one column-pruned scan per group of columns.
    """
    parts = [_profile_group(df, names) for names in in_groups(df.columns, COLUMNS_PER_SCAN)]
    return reduce(DataFrame.unionAll, parts)


def column_info(df: DataFrame, name: str) -> DataFrame:
    """The profile of one column; only that column is read."""
    if name not in df.columns:
        raise KeyError(f"columns not in the table: {name}")
    return _profile_group(df, [name])


def _profile_group(df: DataFrame, names: list[str]) -> DataFrame:
    # SQL text: a wide table makes many expressions.
    places = {name: place for place, name in enumerate(df.columns)}
    aggregates, entries = ["count(*) AS row_count"], []
    for name in names:
        field, column, i = df.schema[name], quoted(name), places[name]
        nan = f"count_if(isnan({column}))" if is_floating(field.dataType) else "0L"
        aggregates += [f"{nan} AS nan_{i}", f"count({column}) AS present_{i}"]
        entries.append(
            f"struct({i} AS position, {literal(name)} AS column, "
            f"{literal(logical_type(field.dataType))} AS type, "
            f"{literal(field.dataType.simpleString())} AS spark_type, "
            f"{str(field.nullable).lower()} AS nullable, "
            f"row_count - present_{i} + nan_{i} AS null_count, nan_{i} AS nan_count, "
            f"present_{i} AS non_null_count, row_count, {len(places)} AS column_count)"
        )
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(entries)}))")
