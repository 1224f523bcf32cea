import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkprof.functions import casts, missing, text
from sparkprof.functions.rounding import fixed, rounded

NAN, INF = float("nan"), float("inf")


def column_of(spark, values, kind, expression):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression).collect()]


def test_rounding_agrees_with_python(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, 1.005, 2.675, 0.155, 0.145, 99.995, 0.99995, 1e15 + 0.5, -2.675, 78973.865]
    values += [round(rng.uniform(-1_000, 1_000), 3) for _ in range(3_000)]
    values += [rng.randrange(2_000) / 2_000 for _ in range(3_000)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(1_000)]
    assert column_of(spark, values, "double", fixed(F.col("x"), 2)) == [f"{v:.2f}" for v in values]
    assert column_of(spark, values, "double", rounded(F.col("x"), 4)) == [round(v, 4) for v in values]


def test_large_values_keep_their_decimals(spark):
    values = [1216114068759298.25, -998877665544332.125, 2.0**52 + 0.5, 2.0**53 + 2, 2.0**62 + 1024, 1e15, -9.3e14 - 0.375]
    for digits in (2, 4):
        assert column_of(spark, values, "double", fixed(F.col("x"), digits)) == [f"{v:.{digits}f}" for v in values]
        assert column_of(spark, values, "double", rounded(F.col("x"), digits)) == [round(v, digits) for v in values]


def size_text(n):
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n = n / 1024
    return f"{n:.2f} PB"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 2**60), min_size=1, max_size=200))
def test_format_bytes(spark, sizes):
    sizes = [*sizes, 0, 1023, 1024, 1152, 1536 * 1024]
    expected = [size_text(float(n)) for n in sizes]
    assert column_of(spark, sizes, "bigint", text.format_bytes(F.col("x"))) == expected


def test_truncated(spark):
    values = [None, "", "a" * 10, "a" * 11, "äöü" * 5]
    found = column_of(spark, values, "string", text.truncated(F.col("x"), 10))
    assert found == [None, "", "a" * 10, "a" * 7 + "...", "äöüäöüä..."]


def test_title_case(spark):
    values = ["roc_auc", "f1", "r2_score", "RMSE", "a1b_c"]
    found = column_of(spark, values, "string", text.title_case(F.col("x")))
    assert found == [v.replace("_", " ").title() for v in values]


def test_display(spark):
    shown = lambda values, kind: column_of(
        spark, values, kind, text.display_cell(F.col("x"), spark.createDataFrame([], f"x {kind}").schema["x"].dataType)
    )
    assert shown([None, 5.0, 1.23456, -2.0, NAN], "double") == ["-", "5", "1.2346", "-2", "-"]
    assert shown([-0.0, 0.0, -0.25], "double") == ["0", "0", "-0.2500"]
    assert shown([None, True, False], "boolean") == ["-", "Sí", "No"]
    assert shown([None, 7], "int") == ["-", "7"]
    assert shown([None, "x"], "string") == ["-", "x"]
    stats = column_of(spark, [None, "12abc", "x", " -.5e1 ", "3."], "string", text.display_stat(F.col("x")))
    assert stats == ["-", "12.0000", "-", "-5.0000", "3.0000"]
    assert column_of(spark, [None, NAN, 2.5], "double", text.display_stat(F.col("x"))) == ["-", "-", "2.5000"]


def test_casts(spark):
    values = [None, "3.7", " 42 ", "1.5d", "abc", "1e3", "-inf", ""]
    assert column_of(spark, values, "string", casts.safe_double(F.col("x"))) == [
        None, 3.7, 42.0, None, None, 1000.0, -INF, None]
    assert column_of(spark, values, "string", casts.safe_long(F.col("x"))) == [
        None, None, 42, None, None, None, None, None]
    assert column_of(spark, [-1.0, 3.0, 9.0], "double", casts.clamped(F.col("x"), 0.0, 5.0)) == [0.0, 3.0, 5.0]


def test_sanitize(spark):
    df = spark.sql(
        "SELECT double('nan') a, double('inf') b, float('-inf') c, 1.5D d, 'x' e, "
        "array(1D, double('nan')) f, map('k', double('inf')) g, "
        "named_struct('p', double('nan'), 'q', array(named_struct('r', double('inf'), 's', 1))) h, "
        "cast(NULL AS struct<p:double>) i"
    )
    row = missing.sanitize(df).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == (None, None, None, 1.5, "x")
    assert row["f"] == [1.0, None] and row["g"] == {"k": None}
    assert row["h"]["p"] is None and row["h"]["q"][0]["r"] is None and row["h"]["q"][0]["s"] == 1
    assert row["i"] is None
    assert missing.sanitize(df).schema.simpleString() == df.schema.simpleString()
    loaded = missing.normalize_nulls(df).first()
    assert loaded["a"] is None and loaded["b"] == INF


def test_small_helpers(spark):
    df = spark.sql("SELECT map('a', 1, 'b', NULL) m, 'abcdefghij' s, array('x', 'y') l, cast(NULL AS string) n")
    row = df.select(
        missing.without_null_entries(F.col("m")), text.short_id(F.col("s"), 8),
        text.joined(F.col("l")), text.or_default(F.col("n")),
    ).first()
    assert tuple(row) == ({"a": 1}, "abcdefgh...", "x, y", "N/A")


@pytest.mark.parametrize("low,high,label", [(0.0, 0.125, "0.00-0.12"), (-1.5, 2.0, "-1.50-2.00")])
def test_range_label(spark, low, high, label):
    df = spark.createDataFrame([(low, high)], "a double, b double")
    assert df.select(text.range_label(F.col("a"), F.col("b"))).first()[0] == label
