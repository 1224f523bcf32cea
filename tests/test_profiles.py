"""Summaries and stored profiles: their bounds, their mergers, and what they read."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkprof.operators import frequent
from sparkprof.operators.describe import categorical_stats
from sparkprof.plans import profiles


def test_distinct_counts_keep_their_bound_on_a_million_values(spark):
    rows = spark.range(1_000_000).selectExpr("id", "cast(id % 70000 as string) AS some", "id / 8 AS halves", "nullif(id % 3, 0) AS few")
    found = {r["column"]: r for r in frequent.distinct_counts(rows, error=0.005).collect()}
    for column, exact in {"id": 1_000_000, "some": 70_000, "halves": 1_000_000, "few": 3}.items():
        r = found[column]
        assert r["low"] <= exact <= r["high"] and abs(r["distinct"] / exact - 1) < 0.015
    assert frequent.distinct_counts(rows.limit(0)).agg(F.sum("high")).first()[0] == 0


def test_distinct_values_of_any_type(spark):
    rows = spark.sql("SELECT * FROM VALUES (1.5D, array(1), named_struct('a', 1), true, binary('x'), date'2024-01-01'),"
                     " (-0D, array(1, 2), named_struct('a', 2), false, binary('y'), NULL),"
                     " (0D, array(1), named_struct('a', 1), NULL, binary('x'), NULL), (double('NaN'), NULL, NULL, true, NULL, NULL),"
                     " (double('NaN'), NULL, NULL, true, NULL, NULL) t(d, l, s, b, x, t)")
    assert {r["column"]: r["distinct"] for r in frequent.distinct_counts(rows).collect()} == \
        {"d": 3, "l": 3, "s": 3, "b": 3, "x": 3, "t": 2}


@pytest.mark.parametrize("tracked, candidates", [(12, 2), (48, 5), (3000, 50)])
def test_modes_are_exact_whatever_the_summary_keeps(spark, tracked, candidates):
    """Small summaries decide less, never wrongly."""
    rows = spark.range(30_000).selectExpr(
        "concat('v', pmod(xxhash64(id), 4000)) AS flat", "if(id % 4 = 0, 'hot', cast(id as string)) AS skewed",
        "concat(repeat('x', 80), id % 3) AS ties", "if(id % 3 < 2, NULL, cast(id as string)) AS holes",
        "cast(NULL as string) AS none", "if(id % 10 < 4, concat('a', id % 2), cast(id as string)) AS two",
    )
    want = {r["column"]: (r["count"], r["top"], r["freq"]) for r in categorical_stats(rows).collect()}
    found = frequent.modes(rows, tracked=tracked, candidates=candidates).collect()
    assert {r["column"]: (r["count"], r["top"], r["freq"]) for r in found} == want
    told = {r["column"]: r["summarised"] for r in found}
    assert told["none"] and (tracked < 3000 or (told["skewed"] and told["holes"] and told["ties"] and told["two"]))
    assert not told["flat"]


def test_the_candidates_alone_are_counted(spark):
    """Where the summary decides, no plan groups by all values."""
    rows = spark.range(1000).selectExpr("if(id % 2 = 0, 'hot', cast(id as string)) AS skewed")
    found = frequent.modes(rows)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("skewed", 1000, "hot", 500, True)]


def lines(spark, small):
    return spark.read.parquet(f"{small}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_extendedprice", "l_returnflag", "l_shipdate",
        "CASE WHEN l_linenumber = 1 THEN double('NaN') WHEN l_linenumber = 2 THEN NULL ELSE 1e9 + l_tax END AS nanny",
        "nullif(l_linenumber, l_linenumber) AS none",
    )


def shown(profile):
    return {r["column"]: r.asDict() for r in profile.collect()}


def agree(merged, whole):
    for column, right in whole.items():
        left = merged[column]
        for name in ("position", "type", "spark_type", "row_count", "null_count", "nan_count", "non_null_count",
                     "count", "min", "max", "top"):
            assert left[name] == right[name], (column, name)
        for name in ("mean", "std"):
            assert left[name] == pytest.approx(right[name], abs=2e-4), (column, name)
        assert left["low"] <= right["distinct"] <= left["high"]


def test_merged_states_equal_those_of_all_rows(spark, small, tmp_path):
    rows, path, kept = lines(spark, small), str(tmp_path / "grown table"), str(tmp_path / "states")
    for part in range(4):
        rows.filter(F.pmod("l_orderkey", F.lit(4)) == part).repartition(2).write.mode("append").parquet(path)
        profiles.table_profile(spark.read.parquet(path), kept).collect()
    table = spark.read.parquet(path)
    merged = shown(profiles.table_profile(table, kept))
    agree(merged, shown(profiles.described(profiles.states(table, by_file=False))))
    # Quartiles of merged sketches keep their rank.
    for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        value = merged["l_extendedprice"][name]
        below = table.filter(F.col("l_extendedprice") <= value).count() / table.count()
        assert abs(below - q) < 0.02
    assert merged["none"]["q1"] is None and merged["none"]["min"] is None and merged["none"]["std"] is None


def test_only_new_files_are_read(spark, small, tmp_path):
    """Files whose states are kept are not opened again: they may even have become unreadable."""
    rows, path, kept = lines(spark, small), str(tmp_path / "t"), str(tmp_path / "s")
    rows.limit(500).coalesce(1).write.parquet(path)
    first = profiles.refresh(spark.read.parquet(path), kept)
    assert len(first) == 1 and profiles.refresh(spark.read.parquet(path), kept) == []
    old = Path(first[0].removeprefix("file:"))
    old.write_bytes(b"no longer a table")
    crc = old.parent / f".{old.name}.crc"
    if crc.exists():
        os.remove(crc)
    rows.limit(700).coalesce(1).write.mode("append").parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    second = profiles.refresh(table, kept)
    assert len(second) == 1 and second != first
    assert {r["row_count"] for r in profiles.table_profile(table, kept).collect()} == {1200}
    # The states of a file that is gone do not count, and a file without rows is read once.
    os.remove(old)
    rows.limit(0).write.mode("append").parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    assert len(profiles.refresh(table, kept)) == 1 and profiles.refresh(table, kept) == []
    assert {r["row_count"] for r in profiles.table_profile(table, kept).collect()} == {700}
