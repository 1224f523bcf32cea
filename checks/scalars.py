"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import table
from sparkprof.functions import casts, missing, text
from sparkprof.operators.paging import display


def sanitize(spark, folder):
    """NaN and infinities of a floating column become NULL, the rest stays."""
    rows = table(spark, folder, "events").select(
        "event_id",
        F.expr("CASE user_id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('inf') "
               "WHEN 2 THEN -double('inf') ELSE value END").alias("value"),
        "event_type",
    )
    return missing.sanitize(rows)


_sanitize = """SELECT event_id, CASE WHEN user_id % 4 = 3 THEN value END AS value, event_type
FROM events"""


def nulls_on_load(spark, folder):
    """NaN becomes NULL; infinities are values."""
    rows = table(spark, folder, "events").select(
        "event_id",
        F.expr("CASE user_id % 3 WHEN 0 THEN double('NaN') WHEN 1 THEN double('inf') "
               "ELSE value END").alias("value"),
    )
    loaded = missing.normalize_nulls(rows)
    return loaded.select(
        "event_id", F.col("value").isNull().alias("is_null"),
        (F.col("value") == float("inf")).alias("is_infinite"),
    )


_nulls_on_load = """SELECT event_id, user_id % 3 = 0 OR value IS NULL AS is_null,
  CASE user_id % 3 WHEN 1 THEN true WHEN 2 THEN value = 'inf'::DOUBLE END AS is_infinite FROM events"""


def sanitize_nested(spark, folder):
    """The same at every depth: an array of structs, a map of arrays."""
    bad = "CASE user_id % 2 WHEN 0 THEN double('NaN') ELSE value END"
    rows = table(spark, folder, "events").select(
        "event_id",
        F.expr(f"array(named_struct('x', {bad}, 'n', user_id), "
               "named_struct('x', value, 'n', event_id))").alias("items"),
        F.expr(f"map('a', array(value, {bad}), 'b', array(double('inf')))").alias("entries"),
    )
    clean = missing.sanitize(rows)
    return clean.select(
        "event_id",
        F.col("items")[0]["x"].alias("first_x"),
        F.col("items")[0]["n"].alias("first_n"),
        F.col("items")[1]["x"].alias("second_x"),
        F.col("entries")["a"][0].alias("a0"),
        F.col("entries")["a"][1].alias("a1"),
        F.col("entries")["b"][0].alias("b0"),
        F.size("entries").alias("entries"),
    )


_sanitize_nested = """SELECT event_id, CASE WHEN user_id % 2 = 1 THEN value END AS first_x,
  user_id AS first_n, value AS second_x, value AS a0,
  CASE WHEN user_id % 2 = 1 THEN value END AS a1, NULL::DOUBLE AS b0, 2 AS entries FROM events"""

_TEXTS = """CASE c_custkey % 7 WHEN 0 THEN CAST(c_custkey AS {text}) WHEN 1 THEN CAST(c_acctbal AS {text})
  WHEN 2 THEN c_mktsegment WHEN 3 THEN concat('  ', CAST(c_custkey AS {text}), ' ')
  WHEN 4 THEN concat(CAST(c_custkey AS {text}), '.5d') WHEN 5 THEN '' ELSE '1e3' END"""


def safe_cast(spark, folder):
    value = F.expr(_TEXTS.format(text="STRING"))
    return table(spark, folder, "customer").select(
        "c_custkey",
        casts.safe_double(value).alias("as_double"),
        casts.safe_long(value).alias("as_long"),
        casts.clamped(F.col("c_acctbal"), 0.0, 5000.0).alias("clamped"),
    )


_safe_cast = f"""WITH texts AS (SELECT *, {_TEXTS.format(text='VARCHAR')} AS t FROM customer)
SELECT c_custkey,
  CASE WHEN regexp_matches(trim(t), '^[+-]?[0-9.]+(e[0-9]+)?$') THEN TRY_CAST(t AS DOUBLE) END
    AS as_double,
  CASE WHEN regexp_matches(trim(t), '^[+-]?[0-9]+$') THEN TRY_CAST(t AS BIGINT) END AS as_long,
  greatest(0.0, least(c_acctbal, 5000.0))::DOUBLE AS clamped FROM texts"""


def clean_map(spark, folder):
    entries = F.expr("map('status', nullif(o_orderstatus, 'F'), "
                     "'priority', nullif(o_orderpriority, '5-LOW'), 'key', string(o_orderkey))")
    kept = missing.without_null_entries(entries)
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.size(kept).alias("entries"),
        F.array_join(F.map_keys(kept), ",").alias("keys"),
        F.array_join(F.map_values(kept), ",").alias("values"),
    )


_clean_map = """SELECT o_orderkey,
  (1 + (o_orderstatus <> 'F')::INT + (o_orderpriority <> '5-LOW')::INT)::INT AS entries,
  concat_ws(',', CASE WHEN o_orderstatus <> 'F' THEN 'status' END,
    CASE WHEN o_orderpriority <> '5-LOW' THEN 'priority' END, 'key') AS keys,
  concat_ws(',', nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '5-LOW'),
    o_orderkey::VARCHAR) AS "values" FROM orders"""

_SIZE = """CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1000
  WHEN 2 THEN 1000000 WHEN 3 THEN 100000000 WHEN 4 THEN 1000000000 ELSE 100000000000 END"""


def format_bytes(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", text.format_bytes(F.expr(_SIZE)).alias("size")
    )


_format_bytes = f"""WITH sizes AS (SELECT o_orderkey, ({_SIZE})::DOUBLE AS b FROM orders)
SELECT o_orderkey, CASE WHEN b < 1024 THEN printf('%.2f B', b)
  WHEN b < 1024^2 THEN printf('%.2f KB', b / 1024)
  WHEN b < 1024^3 THEN printf('%.2f MB', b / 1024^2)
  WHEN b < 1024^4 THEN printf('%.2f GB', b / 1024^3)
  WHEN b < 1024^5 THEN printf('%.2f TB', b / 1024^4)
  ELSE printf('%.2f PB', b / 1024^5) END AS size FROM sizes"""


def truncate_text(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", text.truncated(F.col("text"), 100).alias("text")
    )


_truncate_text = """SELECT doc_id, CASE WHEN length(text) <= 100 THEN text
  ELSE substr(text, 1, 97) || '...' END AS text FROM documents"""


def format_cells(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        F.expr("if(c_custkey % 3 = 0, round(c_acctbal), c_acctbal / 7)").alias("balance"),
        F.expr("nullif(c_mktsegment, 'MACHINERY')").alias("segment"),
        F.expr("if(c_nationkey = 3, NULL, c_nationkey > 10)").alias("far"),
    )
    cells = display(rows)
    return cells.withColumn(
        "stat", text.display_stat(F.concat("balance", F.lit(" units")))
    )


_format_cells = """WITH rows AS (SELECT c_custkey, c_nationkey,
  CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal) ELSE c_acctbal / 7 END AS b,
  nullif(c_mktsegment, 'MACHINERY') AS s FROM customer),
cells AS (SELECT *, CASE WHEN b IS NULL THEN '-' WHEN b = floor(b) THEN b::BIGINT::VARCHAR
  ELSE printf('%.4f', b) END AS balance FROM rows)
SELECT c_custkey::VARCHAR AS c_custkey, balance, coalesce(s, '-') AS segment,
  CASE WHEN c_nationkey = 3 THEN '-' WHEN c_nationkey > 10 THEN 'Sí' ELSE 'No' END AS far,
  CASE WHEN balance = '-' THEN '-' ELSE printf('%.4f', balance::DOUBLE) END AS stat FROM cells"""


QUERIES = {
    "sanitize": (sanitize, _sanitize),
    "nulls_on_load": (nulls_on_load, _nulls_on_load),
    "sanitize_nested": (sanitize_nested, _sanitize_nested),
    "safe_cast": (safe_cast, _safe_cast),
    "clean_map": (clean_map, _clean_map),
    "format_bytes": (format_bytes, _format_bytes),
    "truncate_text": (truncate_text, _truncate_text),
    "format_cells": (format_cells, _format_cells),
}
