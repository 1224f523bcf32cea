import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprof.columns import logical_type, qcol, quoted
from sparkprof.operators import describe, ordering, paging, quantiles
from sparkprof.operators.histogram import histogram
from sparkprof.operators.profile import column_info, profile

NAN, INF = float("nan"), float("inf")


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_logical_types(spark):
    row = spark.sql(
        "SELECT 1Y a, 1S b, 1 c, 1L d, 1.5F e, 1D f, 1.5BD g, true h, 'x' i, X'00' j, "
        "date'2020-01-01' k, timestamp'2020-01-01' l, timestamp_ntz'2020-01-01' m, "
        "array('x') n, map('a', 1) o, struct(1) p, interval 1 day q"
    )
    kinds = [logical_type(f.dataType) for f in row.schema]
    assert kinds == (
        ["integer"] * 4 + ["numeric"] * 3 + ["boolean", "string", "unknown"]
        + ["datetime"] * 3 + ["nested"] * 3 + ["unknown"]
    )
    assert profile(row).count() == 17


def test_profile_counts_nan_apart_and_quotes_names(spark):
    df = spark.createDataFrame(
        [(1.0, "x"), (NAN, None), (None, "y"), (3.0, "x")], "`a.b` double, `c``d` string"
    )
    found = by_column(profile(df))
    assert found["a.b"]["null_count"] == 2 and found["a.b"]["nan_count"] == 1
    assert found["a.b"]["non_null_count"] == 3 and found["a.b"]["row_count"] == 4
    assert found["c`d"]["null_count"] == 1
    assert column_info(df, "c`d").first()["non_null_count"] == 3
    assert df.select(qcol("c`d")).columns == ["c`d"] and quoted("`") == "````"
    with pytest.raises(KeyError):
        column_info(df, "missing")


def test_profile_of_a_wide_table_in_groups(spark, monkeypatch):
    monkeypatch.setattr("sparkprof.operators.profile.COLUMNS_PER_SCAN", 3)
    df = spark.range(5).select(*[F.col("id").alias(f"c{i}") for i in range(8)])
    rows = profile(df).orderBy("position").collect()
    assert [r["column"] for r in rows] == [f"c{i}" for i in range(8)]
    assert {r["column_count"] for r in rows} == {8}


def test_numeric_stats_edge_cases(spark):
    df = spark.createDataFrame(
        [(1.0, None, 5.0, 2**60 + 1), (NAN, None, 5.0, 3), (None, None, 5.0, 4), (3.0, None, 5.0, 5)],
        "`it's` double, empty double, same double, big bigint",
    ).withColumn("dec", F.lit(Decimal("1.25")).cast("decimal(10,2)"))
    found = by_column(describe.numeric_stats(df))
    quoted_ = found["it's"]
    assert (quoted_["count"], quoted_["nan_count"], quoted_["mean"]) == (2, 1, 2.0)
    assert (quoted_["min"], quoted_["max"], quoted_["std"]) == (1.0, 3.0, 1.4142)
    assert quoted_["median"] == 1.0
    empty = found["empty"]
    assert empty["count"] == 0
    assert all(empty[c] is None for c in ("mean", "std", "min", "q1", "median", "q3", "max"))
    assert found["same"]["std"] == 0.0 and found["same"]["q1"] == 5.0
    assert found["big"]["max_text"] == str(2**60 + 1)
    assert found["dec"]["mean"] == 1.25


def test_exact_quartiles_in_the_statistics(spark):
    df = spark.createDataFrame([(1.0, None), (2.5, None), (NAN, None), (9.0, None)], "x double, e double")
    found = by_column(describe.numeric_stats(df, quantile_error=0))
    assert [found["x"][c] for c in ("q1", "median", "q3")] == [1.0, 2.5, 9.0]
    assert found["e"]["median"] is None


def test_infinite_statistics_are_null(spark):
    df = spark.createDataFrame([(1.0,), (INF,)], "x double")
    row = describe.numeric_stats(df).first()
    assert row["count"] == 2 and row["mean"] is None and row["max"] is None and row["min"] == 1.0


def test_stats_need_numbers(spark):
    with pytest.raises(ValueError):
        describe.numeric_stats(spark.createDataFrame([("a",)], "s string"), ["s"])


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles_in_many_rounds(spark, monkeypatch, seed):
    """Small limits force narrowing; a third of the rows share one value."""
    monkeypatch.setattr(quantiles, "KEPT", 5)
    monkeypatch.setattr(quantiles, "COLUMNS_PER_SCAN", 2)
    monkeypatch.setattr(quantiles, "SKETCH_ERROR", 0.04)
    rng = random.Random(seed)
    n = 6_001
    rows = [(float(7) if rng.random() < 0.34 else rng.uniform(-50, 50),
             float(rng.randrange(3)), rng.gauss(0, 1e-9)) for _ in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    found = quantiles.exact_quantiles(df, ["a", "b", "c"], probabilities).collect()
    for r in found:
        values = sorted(row["abc".index(r["column"])] for row in rows)
        assert r["value"] == values[max(1, math.ceil(r["probability"] * n)) - 1], r


def test_exact_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1.0, None), (NAN, None), (None, None), (3.0, None)], "a double, b double")
    found = {(r["column"], r["probability"]): r["value"]
             for r in quantiles.exact_quantiles(df, ["a", "b"]).collect()}
    assert found[("a", 0.5)] == 1.0 and found[("a", 0.75)] == 3.0 and found[("b", 0.5)] is None


def test_sketched_quartiles_on_skewed_values(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 100_003).cast("double")).alias("x")
    )
    cuts = describe.numeric_stats(df).first()
    estimates = [(p, cuts[c]) for p, c in zip((0.25, 0.5, 0.75), ("q1", "median", "q3"))]
    assert all(r["rank_error"] < 0.01 for r in quantiles.rank_error(df, "x", estimates).collect())


def test_tables_without_such_columns(spark):
    assert describe.numeric_stats(spark.createDataFrame([("a",)], "s string")).count() == 0
    assert describe.categorical_stats(spark.range(3).toDF("n")).count() == 0
    assert describe.value_counts(spark.range(3).toDF("n")).count() == 0


def test_null_can_be_the_mode(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "s string")
    row = describe.categorical_stats(df).first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (3, 2, None, 2)
    assert describe.categories_table(describe.categorical_stats(df)).first()["top"] == "N/A"


def test_mode_ties_and_long_texts(spark):
    same = "p" * 64
    rows = [("b", same + "1"), ("a", same + "2"), ("c", same + "2"), ("c", "z" * 500)]
    df = spark.createDataFrame(rows * 3, "short string, long string")
    found = by_column(describe.categorical_stats(df))
    assert found["short"]["top"] == "c" and found["short"]["freq"] == 6
    assert found["long"]["top"] == same + "2" and found["long"]["unique"] == 3
    tied = describe.categorical_stats(spark.createDataFrame([("b",), ("a",)], "s string")).first()
    assert tied["top"] == "a"


def test_short_modes_read_the_table_once(spark, small):
    """With no long winner the second scan is dropped while the query runs."""
    df = spark.read.parquet(f"{small}/lineitem.parquet").select("l_returnflag")
    result = describe.categorical_stats(df)
    result.collect()
    final = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # The groups are a table by now; the source is not read again.
    assert "lineitem.parquet" not in final


def test_value_counts_with_null(spark):
    df = spark.createDataFrame([("a", None), ("a", "x")], "s string, t string")
    found = {(r["column"], r["value"]): r["n"] for r in describe.value_counts(df).collect()}
    assert found == {("s", "a"): 2, ("t", None): 1, ("t", "x"): 1}


def test_histogram_of_nothing_and_of_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, NAN), (None, INF), (None, 3.0)], "e double, x double")
    assert histogram(df, "e", 5).count() == 0
    rows = histogram(df, "x", 2).orderBy("bin").collect()
    assert [(r["label"], r["count"], r["min"], r["max"]) for r in rows] == [
        ("1.00-2.00", 1, 1.0, 2.0), ("2.00-3.00", 1, 2.0, 3.0)
    ]


@pytest.mark.parametrize("low,high,bins", [(0.1, 0.7, 7), (-3.3, 9.9, 13), (1e-9, 3e-9, 10), (5.0, 5.0, 4)])
def test_histogram_values_on_bounds(spark, low, high, bins):
    width = (high - low) / bins if high != low else 1.0
    values = [low + i * width for i in range(bins if high != low else 1)] + [high, high]
    rows = histogram(spark.createDataFrame([(v,) for v in values], "x double"), "x", bins).orderBy("bin")
    expected = [0] * bins
    for v in values:
        place = next((i for i in range(bins) if low + i * width <= v < low + (i + 1) * width), bins - 1)
        expected[place] += 1
    assert [r["count"] for r in rows.collect()] == expected
    assert sum(expected) == len(values)


def test_histogram_arguments(spark):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    for column, bins, error in (("s", 5, ValueError), ("n", 0, ValueError), ("n", 101, ValueError), ("m", 5, KeyError)):
        with pytest.raises(error):
            histogram(df, column, bins)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_numbered_and_running_totals(spark, coalesce):
    """In one partition and in several, whose offsets must be added."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        check_numbered_and_running_totals(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_numbered_and_running_totals(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(5_000).tolist()
    df = spark.createDataFrame([(v, v % 7) for v in values], "v bigint, w bigint").repartition(5)
    placed = ordering.numbered(df, [F.desc("v")]).collect()
    assert {(r["v"], r["position"]) for r in placed} == {(v, 4_999 - v) for v in values}
    totals = ordering.running_totals(df, [F.col("v")], {"before": "w"}).collect()
    expected, total = {}, 0
    for v in sorted(values):
        expected[v] = total
        total += v % 7
    assert {r["v"]: r["before"] for r in totals} == expected


def test_deep_pages_prune_the_second_scan(spark, tmp_path):
    """The bounds of the page's keys are filters of the scan that fetches its rows."""
    spark.range(1_000).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "t"))
    rows = paging.page(spark.read.parquet(str(tmp_path / "t")), "id", 10, 40)
    assert rows.count() == 10
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "x#" in line)
    assert "id#" in scan and ">=" in scan and "<=" in scan


def test_pages_of_null_and_repeated_keys(spark):
    rows = [(None, 1), (None, 2), (1, 3), (2, 4), (2, 5), (3, 6), (4, 7)]
    df = spark.createDataFrame(rows, "k int, n int").repartition(3)
    for offset in range(8):
        found = [tuple(r) for r in paging.page(df, "k", 4, offset).collect()]
        assert found == rows[offset : offset + 4]


def test_pages(spark):
    df = spark.range(1_000).select(F.col("id"), (F.col("id") % 7).alias("x")).repartition(4)
    ids = lambda rows: [r["id"] for r in rows.collect()]
    assert ids(paging.page(df, "id", 10, 40)) == list(range(40, 50))
    assert ids(paging.page(df, "id", 10, 995)) == list(range(995, 1_000))
    assert ids(paging.page(df, "id", 10, 5_000)) == []
    text = df.select(F.format_string("k%05d", "id").alias("id"))
    assert ids(paging.page(text, "id", 2, 998)) == ["k00998", "k00999"]
    assert ids(paging.page_after(df, "id", 99, 3)) == [100, 101, 102]
    assert paging.preview(df, 3).count() == 3
    assert paging.with_total(paging.page(df, "id", 1), df).first()["total_rows"] == 1_000
    assert paging.display_rows(df, order=["id"]).count() == 10
    for limit, offset in ((0, 0), (10_001, 0), (1, -1)):
        with pytest.raises(ValueError):
            paging.page(df, "id", limit, offset)


def test_groups_of_many_values_are_spread(spark, monkeypatch):
    """One large split: its groups are written by as many tasks as its values need, with the same results."""
    rows = spark.range(0, 3000, 1, 1).select(
        F.expr("concat('v ', id)").alias("unique"), F.expr("nullif(concat('h', id % 4), 'h1')").alias("holed"),
        F.expr("concat(repeat('é', 70), id % 300)").alias("long"), F.expr("cast(null as string)").alias("none"),
    )
    whole = sorted(describe.categorical_stats(rows).collect())
    assert [tuple(r) for r in whole if r["column"] == "unique"] == [("unique", 3000, 3000, "v 0", 1)]
    written, write = [], describe.write_once
    monkeypatch.setattr(describe, "write_once", lambda df, kind: written.append(df.rdd.getNumPartitions()) or write(df, kind))
    monkeypatch.setattr(describe, "VALUES_AT_ONCE", 1000)
    monkeypatch.setattr(describe, "VALUES_COMBINED", 700)
    monkeypatch.setattr(describe, "VALUES_PER_TASK", 500)
    assert sorted(describe.categorical_stats(rows).collect()) == whole
    assert written == [24]
    plan = describe.categorical_stats(rows)._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 2
