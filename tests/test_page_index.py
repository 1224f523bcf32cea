"""Pages from a stored order, and the points of a line chart."""

import random

import pytest
from pyspark.sql import functions as F

from sparkprof.operators import chart, page_index, paging


def test_pages_and_ranks_agree_with_sorting(spark, tmp_path):
    """NULL and repeated keys, names to be quoted, a column that cannot be ordered."""
    rows = spark.range(3_000).select(
        F.expr("CASE WHEN id % 7 > 0 THEN id % 100 END").alias("the key"), "id",
        F.create_map(F.lit("k"), F.col("id")).alias("map"),
    )
    index = page_index.build_page_index(rows, "the key", str(tmp_path / "an index"), rows_per_file=130)
    again = page_index.PageIndex(spark, "the key", str(tmp_path / "an index"))
    assert index.total() == again.total() == 3_000
    order = sorted(((r["the key"], r["id"]) for r in rows.collect()), key=lambda r: (r[0] is not None, r))
    draw = random.Random(1)
    for _ in range(8):
        limit, offset = draw.randrange(1, 400), draw.randrange(3_200)
        found = again.page(limit, offset)
        assert found.columns == rows.columns
        assert [(r["the key"], r["id"]) for r in found.collect()] == order[offset : offset + limit]
        assert [r["map"]["k"] for r in found.collect()] == [i for _, i in order[offset : offset + limit]]
    for key in (None, -1, 0, 1, 55, 99, 100):
        before = 0 if key is None else sum(k is None or k < key for k, _ in order)
        assert again.rank(key) == before
    with pytest.raises(ValueError):
        again.page(0)


def test_a_page_reads_only_its_files(spark, tmp_path):
    index = page_index.build_page_index(spark.range(10_000), "id", str(tmp_path / "i"), rows_per_file=500)
    assert len(index.page(100, 0).inputFiles()) == 1
    assert len(index.page(100, 7_777).inputFiles()) <= 2
    assert "PushedFilters: [" in index.page(100, 7_777)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in index.page(10, 20)._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_of_nothing(spark, tmp_path):
    index = page_index.build_page_index(spark.range(0), "id", str(tmp_path / "i"))
    assert index.total() == 0 and index.page(5, 0).collect() == [] and index.rank(3) == 0
    nulls = spark.range(5).selectExpr("cast(NULL as string) AS k", "id")
    index = page_index.build_page_index(nulls, "k", str(tmp_path / "n"))
    assert [r["id"] for r in index.page(9, 1).collect()] == [1, 2, 3, 4] and index.rank("a") == 5


def test_a_chart_draws_the_same_line(spark):
    """In every column of pixels the first, last, lowest and highest point stay."""
    rows = spark.range(30_000).selectExpr("id / 10 AS x", "sin(id / 500) * (id % 13) AS y")
    found = [tuple(r) for r in chart.chart_points(rows, "x", "y", columns=200).collect()]
    assert found == sorted(found) and 200 < len(found) <= 800
    every, kept, width = {}, {}, 2999.9 / 200
    for points, columns in ((((r["x"], r["y"]) for r in rows.collect()), every), (found, kept)):
        for x, y in points:
            columns.setdefault(min(199, int(x / width)), []).append((x, y))
    shape = lambda p: (min(p), max(p), min(y for _, y in p), max(y for _, y in p))
    assert {c: shape(p) for c, p in every.items()} == {c: shape(p) for c, p in kept.items()}


def test_charts_of_few_odd_or_no_points(spark):
    rows = spark.sql("SELECT * FROM VALUES (2, 1D), (1, double('NaN')), (NULL, 3D), (1, 5D), (1, double('inf')), (1, 5D) t(x, y)")
    assert [tuple(r) for r in chart.chart_points(rows, "x", "y").collect()] == [(1, 5), (1, 5), (2, 1)]
    assert chart.chart_points(rows.limit(0), "x", "y").collect() == []
    one = spark.range(20_000).selectExpr("7 AS x", "id AS y")
    assert [tuple(r) for r in chart.chart_points(one, "x", "y").collect()] == [(7, 0), (7, 19_999)]
    with pytest.raises(ValueError):
        chart.chart_points(rows, "x", "y", columns=2_501)
