"""Choosing and preparing the rows a model is trained on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprof.columns import logical_type, qcol, require_columns
from sparkprof.functions.missing import is_missing

SEED = 42
_HASH_RANGE = 2**32


def select_columns(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    names = features + ([target] if target else [])
    require_columns(df, names)
    return df.select([qcol(n) for n in names])


def complete(df: DataFrame, names: list[str]) -> Column:
    """True where none of the named columns is NULL or NaN."""
    held = F.lit(True)
    for name in names:
        held = held & ~is_missing(qcol(name), df.schema[name].dataType)
    return held


def drop_incomplete(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = df.columns if names is None else names
    require_columns(df, names)
    return df.filter(complete(df, names))


def completeness(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(row_count, kept, dropped) of ``drop_incomplete`` in one scan."""
    names = df.columns if names is None else names
    require_columns(df, names)
    held = complete(df, names)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(held).alias("kept"),
        F.count_if(~held).alias("dropped"),
    )


def with_label(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    """Adds the numeric target as a double; booleans count as 0 and 1."""
    require_columns(df, [target])
    kind = logical_type(df.schema[target].dataType)
    if kind not in ("integer", "numeric", "boolean"):
        raise ValueError(f"target {target!r} of type {kind} cannot be used as a number")
    value = qcol(target).cast("int") if kind == "boolean" else qcol(target)
    return df.withColumn(label, value.cast("double"))


def in_train(key: list[str], test_size: float, seed: int = SEED) -> Column:
    """True for the training side of a split decided by a hash of the row's key.

    A row stays on its side however the table is partitioned, re-read or
    recomputed after a lost executor.
    """
    check_share(test_size)
    text = F.concat_ws("-", *[qcol(n).cast("string") for n in key], F.lit(str(seed)))
    # Hexadecimal digits of one length sort like the numbers they stand for.
    bound = min(round((1.0 - test_size) * _HASH_RANGE), _HASH_RANGE - 1)
    return F.md5(text) < f"{bound:08x}"


def hash_split(
    df: DataFrame, key: list[str], test_size: float, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    require_columns(df, key)
    chosen = in_train(key, test_size, seed)
    return df.filter(chosen), df.filter(~chosen)


def random_split(
    df: DataFrame, test_size: float, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Spark's own random split; it changes with the partitioning of the table."""
    check_share(test_size)
    train, test = df.randomSplit([1.0 - test_size, test_size], seed=seed)
    return train, test


def split_sizes(df: DataFrame, chosen: Column) -> DataFrame:
    """(train_size, test_size) in one scan."""
    return df.agg(
        F.count_if(chosen).alias("train_size"), F.count_if(~chosen).alias("test_size")
    )


def check_share(test_size: float) -> None:
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
