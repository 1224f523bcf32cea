"""Profiles, statistics, histograms and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.inputs import table, union_sql
from sparkprof.operators import chart, describe, frequent, histogram, page_index, paging, profile, quantiles
from sparkprof.operators.features import completeness
from sparkprof.plans import profiles
from sparkprof.scratch import new_path

_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax"]
_QUARTILES = (0.25, 0.5, 0.75)


def numeric_stats(spark, folder):
    """All statistics, with the quartiles searched exactly."""
    return describe.numeric_stats(table(spark, folder, "lineitem"), quantile_error=0)


_CUTS = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
_numeric_stats = union_sql(
    f"""SELECT '{c}' AS "column", count({c})::BIGINT AS "count", 0::BIGINT AS nan_count,
  printf('%.4f', avg({c}))::DOUBLE AS mean, printf('%.4f', stddev_samp({c}))::DOUBLE AS std,
  {', '.join(f"printf('%.4f', quantile_disc({c}, {p})::DOUBLE)::DOUBLE AS {n}" for n, p in _CUTS)},
  min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, min({c})::VARCHAR AS min_text,
  max({c})::VARCHAR AS max_text FROM lineitem"""
    for c in _NUMERIC
)


def numeric_stats_missing(spark, folder):
    """Statistics of columns with NULL and NaN, and of one without any value."""
    rows = table(spark, folder, "lineitem").select(
        F.expr("nullif(l_discount, 0.0D)").alias("with_nulls"),
        F.expr("CASE WHEN l_linenumber = 1 THEN double('NaN') ELSE l_tax END").alias("with_nans"),
        F.lit(None).cast("double").alias("empty"),
    )
    return describe.numeric_stats(rows, quantile_error=0)


_numeric_stats_missing = f"""WITH long AS (
  SELECT 'with_nulls' AS "column", nullif(l_discount, 0.0) AS v, false AS nan FROM lineitem
  UNION ALL SELECT 'with_nans', CASE WHEN l_linenumber <> 1 THEN l_tax END, l_linenumber = 1 FROM lineitem
  UNION ALL SELECT 'empty', NULL, false FROM lineitem)
SELECT "column", count(v)::BIGINT AS "count", count(*) FILTER (nan)::BIGINT AS nan_count,
  printf('%.4f', avg(v))::DOUBLE AS mean, printf('%.4f', stddev_samp(v))::DOUBLE AS std,
  {', '.join(f"printf('%.4f', quantile_disc(v, {p}))::DOUBLE AS {n}" for n, p in _CUTS)},
  min(v) AS min, max(v) AS max, min(v)::VARCHAR AS min_text, max(v)::VARCHAR AS max_text
FROM long GROUP BY "column\""""


def stats_table(spark, folder):
    """The statistics as display text, with exact quartiles."""
    stats = describe.numeric_stats(table(spark, folder, "orders"), quantile_error=0)
    return describe.stats_table(stats)


_stats_table = union_sql(
    f"""SELECT '{c}' AS "column", count({c})::BIGINT AS "count",
  printf('%.4f', avg({c})) AS mean, printf('%.4f', stddev_samp({c})) AS std,
  printf('%.4f', min({c})::DOUBLE) AS min, printf('%.4f', max({c})::DOUBLE) AS max,
  printf('%.4f', quantile_disc({c}, 0.25)::DOUBLE) AS q1,
  printf('%.4f', quantile_disc({c}, 0.5)::DOUBLE) AS median,
  printf('%.4f', quantile_disc({c}, 0.75)::DOUBLE) AS q3 FROM orders"""
    for c in ("o_orderkey", "o_custkey", "o_totalprice")
)


def quartiles(spark, folder):
    found = quantiles.exact_quantiles(table(spark, folder, "lineitem"), _NUMERIC, _QUARTILES)
    return found.drop("value_text")


_quartiles = union_sql(
    f"""SELECT '{c}' AS "column", {p}::DOUBLE AS probability,
  quantile_disc({c}, {p})::DOUBLE AS value FROM lineitem"""
    for c in _NUMERIC
    for p in _QUARTILES
)


def quartiles_bigint(spark, folder):
    """Whole numbers that a double cannot tell apart."""
    rows = table(spark, folder, "lineitem").select(
        (F.lit(2**60) + F.col("l_orderkey")).alias("large"),
        (F.lit(-(2**55)) - F.col("l_partkey")).alias("low"), "l_orderkey",
    )
    found = quantiles.exact_quantiles(rows, rows.columns, _QUARTILES)
    return found.select("column", "probability", "value_text")


_quartiles_bigint = union_sql(
    f"""SELECT '{name}' AS "column", {p}::DOUBLE AS probability,
  quantile_disc({c}, {p})::VARCHAR AS value_text FROM lineitem"""
    for name, c in (("large", f"({2**60} + l_orderkey)"), ("low", f"(-{2**55} - l_partkey)"),
                    ("l_orderkey", "l_orderkey"))
    for p in _QUARTILES
)


def quartiles_approx(spark, folder):
    """The quartiles of the one-pass statistics are within a hundredth of their rank."""
    rows = table(spark, folder, "lineitem").select("l_extendedprice")
    cuts = describe.numeric_stats(rows, quantile_error=0.002).first()
    estimates = [(p, cuts[c]) for p, c in zip(_QUARTILES, ("q1", "median", "q3"))]
    errors = quantiles.rank_error(rows, "l_extendedprice", estimates)
    return errors.select("probability", (F.col("rank_error") <= 0.01).alias("close"))


_quartiles_approx = union_sql(
    f"SELECT {p}::DOUBLE AS probability, count(*) > 0 AS close FROM lineitem" for p in _QUARTILES
)


def _document_strings(spark, folder):
    return table(spark, folder, "documents").select(
        "lang", "source", "text", F.expr("nullif(lang, 'en')").alias("lang_or_null")
    )


_DOCUMENT_STRINGS = {"lang": "lang", "source": "source", "text": "text",
                     "lang_or_null": "nullif(lang, 'en')"}


def categorical_stats(spark, folder):
    return describe.categorical_stats(_document_strings(spark, folder))


_categorical_stats = f"""WITH groups AS ({union_sql(
    f'''SELECT '{name}' AS "column", {expression} AS value, count(*) AS n
  FROM documents GROUP BY ALL'''
    for name, expression in _DOCUMENT_STRINGS.items()
)}), ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC,
  value NULLS LAST) AS place FROM groups)
SELECT "column", sum(n)::BIGINT AS "count", count(*)::BIGINT AS "unique",
  max(CASE WHEN place = 1 THEN value END) AS top, max(n)::BIGINT AS freq
FROM ranked GROUP BY "column\""""


def modes_by_summary(spark, folder):
    """The most frequent values, by summaries and counts of the candidates alone."""
    found = frequent.modes(_document_strings(spark, folder))
    return found.select("column", "count", "top", "freq")


_modes_by_summary = f'SELECT "column", "count", top, freq FROM ({_categorical_stats})'


def modes_of_ties(spark, folder):
    """Columns that the summary cannot decide: every value once, long ties, NULL; and no rows."""
    orders = table(spark, folder, "orders").select(
        F.expr("concat('order ', o_orderkey)").alias("unique"),
        F.expr("nullif(o_orderpriority, '1-URGENT')").alias("holed"),
        F.expr("concat(repeat('y', 70), o_orderkey % 7000)").alias("long"),
    )
    none = orders.limit(0).select(F.col("long").alias("none"))
    found = frequent.modes(orders).unionAll(frequent.modes(none))
    return found.select("column", "count", "top", "freq")


_modes_of_ties = f"""WITH groups AS ({union_sql(
    f'''SELECT '{name}' AS "column", {expression} AS value, count(*) AS n FROM orders GROUP BY ALL'''
    for name, expression in (
        ("unique", "'order ' || o_orderkey"), ("holed", "nullif(o_orderpriority, '1-URGENT')"),
        ("long", "repeat('y', 70) || (o_orderkey % 7000)"),
    )
)}), ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS LAST) AS place
FROM groups)
SELECT "column", sum(n)::BIGINT AS "count", max(CASE WHEN place = 1 THEN value END) AS top,
  max(n)::BIGINT AS freq FROM ranked GROUP BY "column"
UNION ALL SELECT 'none', 0, NULL, 0"""


_DISTINCT = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")


def distinct_sketched(spark, folder):
    """Exact distinct counts beside sketched ones, and whether these keep their bound."""
    lines = table(spark, folder, "lineitem").select(*_DISTINCT, F.expr("nullif(l_discount, 0.0D)").alias("holed"))
    columns = [*_DISTINCT, "holed"]
    exact = lines.agg(*[F.countDistinct(c).alias(c) for c in columns], *[
        (F.count(F.lit(1)) > F.count(c)).cast("bigint").alias(f"_{c}") for c in columns
    ])
    exact = exact.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(c) + F.col(f"_{c}")).alias("exact")) for c in columns
    ])))
    found = frequent.distinct_counts(lines, error=0.005).join(exact, "column")
    return found.select("column", "exact", F.col("exact").between(F.col("low"), F.col("high")).alias("within"))


_distinct_sketched = union_sql(
    f"""SELECT '{name}' AS "column", (count(DISTINCT {c}) + (count(*) > count({c}))::BIGINT)::BIGINT AS exact,
  true AS within FROM lineitem"""
    for name, c in (*((c, c) for c in _DISTINCT), ("holed", "nullif(l_discount, 0.0)"))
)


def _holed_lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_returnflag", "l_shipdate", F.expr("nullif(l_discount, 0.0D)").alias("holed"),
        F.expr("CASE WHEN l_linenumber = 1 THEN double('NaN') WHEN l_linenumber = 2 THEN NULL "
               "ELSE l_tax END").alias("nanny"),
    )


def profile_of_files(spark, folder):
    """A table that grows file by file, profiled from the states of its files."""
    rows, path, kept = _holed_lines(spark, folder), new_path(spark, "grown"), new_path(spark, "states")
    for part in range(3):
        rows.filter(F.pmod("l_orderkey", F.lit(3)) == part).write.mode("append").parquet(path)
        grown = spark.read.parquet(path)
        scanned = profiles.refresh(grown, kept)
        assert 0 < len(scanned) and (part == 0 or len(scanned) < len(grown.inputFiles()))
    found = profiles.table_profile(grown, kept)
    exact = [F.col(c) for c in ("column", "row_count", "null_count", "nan_count", "non_null_count", "count",
                                "min", "max", "mean", "std")]
    return found.select(*exact, F.when(F.col("column") == "l_returnflag", F.col("top")).alias("top"))


_profile_of_files = union_sql(
    f"""SELECT '{name}' AS "column", count(*)::BIGINT AS row_count, (count(*) - count({valid}))::BIGINT AS null_count,
  {nans}::BIGINT AS nan_count, (count(*) - ({missing}))::BIGINT AS non_null_count,
  {f"count({valid})::BIGINT" if number else "0::BIGINT"} AS "count",
  {f"min({valid})::DOUBLE" if number else "NULL::DOUBLE"} AS min, {f"max({valid})::DOUBLE" if number else "NULL::DOUBLE"} AS max,
  {f"printf('%.4f', avg({valid}))::DOUBLE" if number else "NULL::DOUBLE"} AS mean,
  {f"printf('%.4f', stddev_samp({valid}))::DOUBLE" if number else "NULL::DOUBLE"} AS std,
  {"(SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)" if name == "l_returnflag" else "NULL"} AS top
FROM lineitem"""
    for name, valid, nans, missing, number in (
        ("l_orderkey", "l_orderkey", "0", "0", True), ("l_extendedprice", "l_extendedprice", "0", "0", True),
        ("l_returnflag", "l_returnflag", "0", "0", False), ("l_shipdate", "l_shipdate", "0", "0", False),
        ("holed", "nullif(l_discount, 0.0)", "0", "count(*) - count(nullif(l_discount, 0.0))", True),
        ("nanny", "(CASE WHEN l_linenumber > 2 THEN l_tax END)", "count(*) FILTER (l_linenumber = 1)",
         "count(*) FILTER (l_linenumber = 2)", True),
    )
)


_LONG_TIES = "repeat('x', 64) || l_linenumber"


def categorical_stats_ties(spark, folder):
    """Long texts of one beginning, equally frequent; and a table without rows."""
    lines = table(spark, folder, "lineitem").select("l_linenumber", "l_returnflag")
    ties = lines.distinct().select(F.expr(_LONG_TIES).alias("text"))
    none = lines.limit(0).select(F.expr(_LONG_TIES).alias("none"))
    return describe.categorical_stats(ties).unionAll(describe.categorical_stats(none))


_categorical_stats_ties = f"""WITH groups AS (SELECT {_LONG_TIES} AS value, count(*) AS n
  FROM (SELECT DISTINCT l_linenumber, l_returnflag FROM lineitem) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, value NULLS LAST) AS place FROM groups)
SELECT 'text' AS "column", sum(n)::BIGINT AS "count", count(*)::BIGINT AS "unique",
  max(CASE WHEN place = 1 THEN value END) AS top, max(n)::BIGINT AS freq FROM ranked
UNION ALL SELECT 'none', count(*), 0, NULL, 0 FROM lineitem WHERE false"""


def categorical_stats_short(spark, folder):
    """Short strings only: one scan and no texts to read back."""
    rows = table(spark, folder, "lineitem").select(
        "l_linestatus", F.expr("nullif(l_returnflag, 'A')").alias("flag_or_null")
    )
    return describe.categories_table(describe.categorical_stats(rows))


_categorical_stats_short = """WITH groups AS (
  SELECT 'l_linestatus' AS "column", l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY ALL
  UNION ALL
  SELECT 'flag_or_null', nullif(l_returnflag, 'A'), count(*) FROM lineitem GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER
  (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS LAST) AS place FROM groups)
SELECT "column", sum(n)::BIGINT AS "count", count(*)::BIGINT AS "unique",
  coalesce(max(CASE WHEN place = 1 THEN value END), 'N/A') AS top, max(n)::BIGINT AS freq
FROM ranked GROUP BY "column\""""


def value_counts(spark, folder):
    return describe.value_counts(_document_strings(spark, folder))


_value_counts = union_sql(
    f"""SELECT '{name}' AS "column", {expression} AS value, count(*)::BIGINT AS n
  FROM documents GROUP BY ALL"""
    for name, expression in _DOCUMENT_STRINGS.items()
)


def profile_nulls(spark, folder):
    """Missing values of columns with NULLs, NaNs, both and none."""
    rows = table(spark, folder, "lineitem").select(
        "l_quantity",
        F.expr("nullif(l_discount, 0.0D)").alias("discount"),
        F.expr("nullif(l_returnflag, 'A')").alias("a.flag"),
        F.expr("CASE WHEN l_linenumber = 1 THEN double('NaN') "
               "WHEN l_linenumber = 2 THEN NULL ELSE l_tax END").alias("tax"),
    )
    found = profile.profile(rows)
    return found.select("column", "type", "null_count", "nan_count", "non_null_count")


_profile_nulls = """
SELECT 'l_quantity' AS "column", 'numeric' AS type, 0::BIGINT AS null_count,
  0::BIGINT AS nan_count, count(l_quantity)::BIGINT AS non_null_count FROM lineitem
UNION ALL SELECT 'discount', 'numeric', count(*) FILTER (l_discount = 0), 0,
  count(*) FILTER (l_discount <> 0) FROM lineitem
UNION ALL SELECT 'a.flag', 'string', count(*) FILTER (l_returnflag = 'A'), 0,
  count(*) FILTER (l_returnflag <> 'A') FROM lineitem
UNION ALL SELECT 'tax', 'numeric', count(*) FILTER (l_linenumber <= 2),
  count(*) FILTER (l_linenumber = 1), count(*) FILTER (l_linenumber <> 2) FROM lineitem"""


def profile_rowcount(spark, folder):
    """Rows, complete rows and dropped rows, and the width of the table."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.expr("nullif(l_discount, 0.0D)").alias("discount"),
        F.expr("nullif(l_returnflag, 'A')").alias("flag"),
    )
    return completeness(rows).withColumn("column_count", F.lit(len(rows.columns)))


_profile_rowcount = """SELECT count(*)::BIGINT AS row_count,
  count(*) FILTER (l_discount <> 0 AND l_returnflag <> 'A')::BIGINT AS kept,
  count(*) FILTER (l_discount = 0 OR l_returnflag = 'A')::BIGINT AS dropped,
  3 AS column_count FROM lineitem"""


_TYPED = {"events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
          "embeddings": ["vec_id", "embedding", "label"],
          "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                     "o_orderpriority"]}


def column_types(spark, folder):
    parts = [
        profile.profile(table(spark, folder, name)).select(
            F.lit(name).alias("table_name"), "column", "type", "non_null_count", "column_count"
        )
        for name in _TYPED
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


_column_types = union_sql(
    f"""SELECT '{t}' AS table_name, '{c}' AS "column",
  CASE any_value(typeof({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer'
    WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'numeric' WHEN 'TIMESTAMP' THEN 'datetime'
    WHEN 'FLOAT[]' THEN 'nested' ELSE 'unknown' END AS type,
  count({c})::BIGINT AS non_null_count, {len(columns)} AS column_count FROM {t}"""
    for t, columns in _TYPED.items()
    for c in columns
)


def column_info(spark, folder):
    return profile.column_info(table(spark, folder, "events"), "value")


_column_info = """SELECT 4 AS "position", 'value' AS "column", 'numeric' AS type,
  'double' AS spark_type, true AS nullable, count(*) FILTER (value IS NULL)::BIGINT AS null_count,
  0::BIGINT AS nan_count, count(value)::BIGINT AS non_null_count,
  count(*)::BIGINT AS row_count, 6 AS column_count FROM events"""


def _histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""WITH rows AS (SELECT {column} AS x FROM {source}),
span AS (SELECT min(x) AS low, max(x) AS high FROM rows),
edges AS (SELECT i AS bin, low + i * w AS lo, low + (i + 1) * w AS hi FROM
  (SELECT low, CASE WHEN high <> low THEN (high - low) / {bins} ELSE 1.0::DOUBLE END AS w FROM span),
  range({bins}) AS r(i) WHERE low IS NOT NULL)
SELECT bin::INTEGER AS bin, printf('%.2f', lo) || '-' || printf('%.2f', hi) AS label,
  count(x)::BIGINT AS "count", printf('%.4f', lo)::DOUBLE AS min, printf('%.4f', hi)::DOUBLE AS max
FROM edges LEFT JOIN rows ON x >= lo AND (x < hi OR bin = {bins - 1}) GROUP BY ALL"""


def histogram_price(spark, folder):
    return histogram.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 20)


def histogram_on_bounds(spark, folder):
    """Whole numbers, so that most values lie on a bound."""
    return histogram.histogram(table(spark, folder, "lineitem"), "l_quantity", 49)


def histogram_with_gaps(spark, folder):
    """A skewed column: most bins are empty or nearly so."""
    return histogram.histogram(table(spark, folder, "events"), "value", 100)


def histogram_constant(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_quantity") * 0 + 5).alias("five"))
    return histogram.histogram(rows, "five", 10)


_ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority"""


def _shown(rows):
    """Moments as text: the engines' own types differ."""
    return rows.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def preview_head(spark, folder):
    return _shown(paging.preview(table(spark, folder, "orders"), 100, ["o_orderkey"]))


_preview_head = f"{_ORDERS} FROM orders ORDER BY o_orderkey LIMIT 100"


def preview_page(spark, folder):
    orders = table(spark, folder, "orders")
    return _shown(paging.with_total(paging.page(orders, "o_orderkey", 100, 1_000), orders))


_preview_page = f"""{_ORDERS}, (SELECT count(*) FROM orders)::BIGINT AS total_rows
FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 1000"""


def preview_deep_page(spark, folder):
    """The last page, which is not full."""
    orders = table(spark, folder, "orders")
    return _shown(paging.page(orders, "o_orderkey", 1_000, 1_450))


_preview_deep_page = f"{_ORDERS} FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 1450"


def preview_after(spark, folder):
    return _shown(paging.page_after(table(spark, folder, "orders"), "o_orderkey", 1_234, 50))


_preview_after = f"{_ORDERS} FROM orders WHERE o_orderkey > 1234 ORDER BY o_orderkey LIMIT 50"


def _holed_keys(spark, folder):
    """A key that is NULL for one priority and repeated for the others."""
    return table(spark, folder, "orders").select(
        F.expr("nullif(o_orderpriority, '3-MEDIUM')").alias("key"), "o_orderkey"
    )


def _page_sql(limit, offset):
    return f"""SELECT nullif(o_orderpriority, '3-MEDIUM') AS key, o_orderkey FROM orders
ORDER BY key NULLS FIRST, o_orderkey LIMIT {limit} OFFSET {offset}"""


def page_null_and_repeated_keys(spark, folder):
    """From NULL keys on into repeated ones."""
    return paging.page(_holed_keys(spark, folder), "key", 500, 50)


def page_deep_null_keys(spark, folder):
    """Far from the NULL keys, within repeated ones."""
    return paging.page(_holed_keys(spark, folder), "key", 100, 1_100)


def pages_from_index(spark, folder):
    """Pages of a stored order: from NULL into repeated keys, far behind, and beyond the last row."""
    rows = _holed_keys(spark, folder)
    index = page_index.build_page_index(rows, "key", new_path(spark, "pages"), rows_per_file=700)
    return reduce(DataFrame.unionAll, [
        index.page(limit, offset).withColumn("asked", F.lit(offset)) for limit, offset in _ASKED
    ])


_ASKED = ((500, 50), (100, 1_100), (900, 300), (10, 10**9))
_pages_from_index = union_sql(
    f"SELECT *, {offset}::INTEGER AS asked FROM ({_page_sql(limit, offset)})" for limit, offset in _ASKED
)


def ranks_from_index(spark, folder):
    """How many rows come before a key."""
    rows = _holed_keys(spark, folder)
    index = page_index.build_page_index(rows, "key", new_path(spark, "pages"), rows_per_file=700)
    found = [(key, index.rank(key), index.total()) for key in _RANKED]
    return spark.createDataFrame(found, "key string, before bigint, total bigint")


_RANKED = ("1-URGENT", "2-HIGH", "3", "5-LOW", "6", "")
_ranks_from_index = union_sql(
    f"""SELECT '{key}' AS key, count(*) FILTER (o_orderpriority = '3-MEDIUM' OR o_orderpriority < '{key}')::BIGINT AS before,
  count(*)::BIGINT AS total FROM orders""" for key in _RANKED
)


def chart_of_many_points(spark, folder):
    """First, last, lowest and highest point of each column of pixels."""
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") % 997).alias("x"), F.expr("nullif(l_extendedprice, 0)").alias("y")
    )
    return chart.chart_points(rows, "x", "y", columns=100)


_chart_of_many_points = """WITH points AS (SELECT (l_orderkey % 997)::DOUBLE AS x, l_extendedprice AS y FROM lineitem
  WHERE l_extendedprice <> 0),
ends AS (SELECT min(x) AS low, (max(x) - min(x)) / 100 AS width FROM points),
placed AS (SELECT x, y, least(99, floor((x - low) / width)) AS c FROM points, ends),
ranked AS (SELECT x, y, row_number() OVER (PARTITION BY c ORDER BY x, y) AS a,
  row_number() OVER (PARTITION BY c ORDER BY x DESC, y DESC) AS b,
  row_number() OVER (PARTITION BY c ORDER BY y, x) AS d,
  row_number() OVER (PARTITION BY c ORDER BY y DESC, x) AS e FROM placed)
SELECT x, y FROM points WHERE (SELECT count(*) FROM points) <= 10000
UNION ALL SELECT DISTINCT x, y FROM ranked WHERE 1 IN (a, b, d, e) AND (SELECT count(*) FROM points) > 10000"""


def display_cells(spark, folder):
    """The first rows as they are shown."""
    return paging.display_rows(table(spark, folder, "nation"), 10, ["n_nationkey"])


_display_cells = """SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey
FROM nation ORDER BY nation.n_nationkey LIMIT 10"""


QUERIES = {
    "numeric_stats": (numeric_stats, _numeric_stats),
    "numeric_stats_missing": (numeric_stats_missing, _numeric_stats_missing),
    "stats_table": (stats_table, _stats_table),
    "quartiles": (quartiles, _quartiles),
    "quartiles_bigint": (quartiles_bigint, _quartiles_bigint),
    "quartiles_approx": (quartiles_approx, _quartiles_approx),
    "categorical_stats": (categorical_stats, _categorical_stats),
    "categorical_stats_ties": (categorical_stats_ties, _categorical_stats_ties),
    "categorical_stats_short": (categorical_stats_short, _categorical_stats_short),
    "value_counts": (value_counts, _value_counts),
    "modes_by_summary": (modes_by_summary, _modes_by_summary),
    "modes_of_ties": (modes_of_ties, _modes_of_ties),
    "distinct_sketched": (distinct_sketched, _distinct_sketched),
    "profile_of_files": (profile_of_files, _profile_of_files),
    "profile_nulls": (profile_nulls, _profile_nulls),
    "profile_rowcount": (profile_rowcount, _profile_rowcount),
    "column_types": (column_types, _column_types),
    "column_info": (column_info, _column_info),
    "histogram": (histogram_price, _histogram_sql("lineitem", "l_extendedprice", 20)),
    "histogram_on_bounds": (histogram_on_bounds, _histogram_sql("lineitem", "l_quantity", 49)),
    "histogram_with_gaps": (histogram_with_gaps, _histogram_sql("events", "value", 100)),
    "histogram_constant": (histogram_constant, _histogram_sql("lineitem", "(l_quantity * 0 + 5)", 10)),
    "preview_head": (preview_head, _preview_head),
    "preview_page": (preview_page, _preview_page),
    "preview_deep_page": (preview_deep_page, _preview_deep_page),
    "preview_after": (preview_after, _preview_after),
    "page_null_and_repeated_keys": (page_null_and_repeated_keys, _page_sql(500, 50)),
    "page_deep_null_keys": (page_deep_null_keys, _page_sql(100, 1_100)),
    "pages_from_index": (pages_from_index, _pages_from_index),
    "ranks_from_index": (ranks_from_index, _ranks_from_index),
    "chart_of_many_points": (chart_of_many_points, _chart_of_many_points),
    "display_rows": (display_cells, _display_cells),
}
