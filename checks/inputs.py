"""Inputs derived from the given tables, once for Spark and once as SQL.

``runs``, ``datasets`` and ``registry`` turn every order and part into entries of
the run and dataset registries; ``predictions`` turns every order into a scored
row.  Spark builds them with DataFrame expressions, the SQL side with a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Runs: one per order.  Metrics are columns on the SQL side and a map in Spark.
_TYPE = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'classification'
  WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'regression'
  ELSE 'clustering' END"""
_ALGORITHM = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN
    CASE o_custkey % 3 WHEN 0 THEN 'logistic_regression' WHEN 1 THEN 'random_forest' ELSE 'gbt' END
  WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN
    CASE o_custkey % 2 WHEN 0 THEN 'linear_regression' ELSE 'decision_tree_reg' END
  ELSE 'kmeans' END"""
_RUN_COLUMNS = f"""
  md5(concat('run-', o_orderkey)) AS id,
  concat('run ', o_orderkey) AS name,
  {_TYPE} AS model_type,
  {_ALGORITHM} AS algorithm,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('target_', o_custkey % 5) END AS target,
  md5(concat('dataset-', o_custkey * 2)) AS dataset_id,
  CAST(floor(o_totalprice) AS BIGINT) AS train_size,
  CAST(floor(o_totalprice / 4) AS BIGINT) AS test_size,
  o_orderdate AS created_at,
  CAST(o_orderkey % 30 + 1 AS VARCHAR(20)) AS max_depth,
  CAST(o_custkey % 100 + 1 AS VARCHAR(20)) AS max_iter,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
    THEN CAST(floor(o_totalprice) AS BIGINT) % 997 / 997.0 END AS accuracy,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'
    THEN CAST(floor(o_totalprice) AS BIGINT) % 991 / 991.0 END AS f1,
  CASE WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN o_totalprice / 8 END AS rmse,
  CASE WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') AND o_orderstatus <> 'F'
    THEN CAST(floor(o_totalprice) AS BIGINT) % 983 / 983.0 END AS r2,
  CASE WHEN o_orderpriority = '5-LOW'
    THEN CAST(floor(o_totalprice) AS BIGINT) % 977 / 977.0 END AS silhouette"""
METRICS = ("accuracy", "f1", "rmse", "r2", "silhouette")

RUNS_SQL = f"runs AS (SELECT *, {_RUN_COLUMNS} FROM orders)".replace(" / 997.0", " / 997::DOUBLE") \
    .replace(" / 991.0", " / 991::DOUBLE").replace(" / 983.0", " / 983::DOUBLE") \
    .replace(" / 977.0", " / 977::DOUBLE")


def _run_columns() -> str:
    text = _RUN_COLUMNS.replace("VARCHAR(20)", "STRING")
    for prime in (997, 991, 983, 977):
        text = text.replace(f" / {prime}.0", f" / {prime}D")
    return text


def runs(spark: SparkSession, folder: str, extra: str = "") -> DataFrame:
    """One run per order, in the layout of the run registry."""
    orders = table(spark, folder, "orders")
    orders.createOrReplaceTempView("_orders")
    flat = spark.sql(f"SELECT *, {_run_columns()} FROM _orders")
    metrics = F.map_from_arrays(
        F.array(*[F.lit(m) for m in METRICS]), F.array(*[F.col(m) for m in METRICS])
    )
    features = F.expr(
        "transform(sequence(0, cast(o_orderkey % 3 as int)), i -> concat('feature_', i))"
    )
    cells = [f"cast(o_orderkey % {k} as bigint)" for k in (7, 11, 13, 17)]
    matrix = F.expr(f"array(array({cells[0]}, {cells[1]}), array({cells[2]}, {cells[3]}))")
    return flat.select(
        "id", "name", "model_type", "algorithm",
        features.alias("features"),
        "target",
        F.create_map(
            F.lit("maxDepth"), "max_depth", F.lit("maxIter"), "max_iter"
        ).alias("params"),
        F.map_filter(metrics, lambda _, v: v.isNotNull()).alias("metrics"),
        F.when(F.col("model_type") == "classification", matrix).alias("confusion_matrix"),
        F.lit(None).cast("map<string,double>").alias("feature_importance"),
        "dataset_id", "train_size", "test_size", "created_at",
        F.lit(None).cast("string").alias("model_path"),
        *([extra] if extra else []),
    )


# Datasets: one per part; half the runs ask for an id that is not there.
_DATASET_COLUMNS = """
  md5(concat('dataset-', p_partkey)) AS id,
  concat(p_name, '.csv') AS filename,
  CASE WHEN p_size > 10 THEN concat('/data/', p_partkey) END AS path,
  CAST(p_size * 100 AS BIGINT) AS row_count,
  p_size AS column_count"""
DATASETS_SQL = f"datasets AS (SELECT *, {_DATASET_COLUMNS} FROM part)"


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "part").createOrReplaceTempView("_part")
    flat = spark.sql(f"SELECT *, {_DATASET_COLUMNS} FROM _part")
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, p_partkey)")
    return flat.select("id", "filename", "path", "row_count", "column_count",
                       created.alias("created_at"))


# Registry: every run is put; some are put again, deleted, or cleared away.
REGISTRY_SQL = f"""{RUNS_SQL},
first_day AS (SELECT min(created_at) AS d FROM runs),
changes AS (
  SELECT id, name, test_size, 'put' AS op, created_at AS updated_at FROM runs
  UNION ALL
  SELECT id, concat(name, ' again'), test_size + 1, 'put', created_at + INTERVAL 1 DAY
  FROM runs WHERE target IS NOT NULL
  UNION ALL
  SELECT id, NULL, NULL, 'delete', created_at + INTERVAL 2 DAY
  FROM runs WHERE algorithm = 'gbt'
  UNION ALL
  SELECT NULL, NULL, NULL, 'clear', d + INTERVAL 365 DAY FROM first_day)"""


def registry(spark: SparkSession, folder: str) -> DataFrame:
    rows = runs(spark, folder)
    moved = lambda days: F.col("created_at") + F.expr(f"INTERVAL {days} DAY")
    puts = rows.withColumns({"op": F.lit("put"), "updated_at": F.col("created_at")})
    again = rows.filter("target IS NOT NULL").withColumns(
        {
            "name": F.concat("name", F.lit(" again")),
            "test_size": F.col("test_size") + 1,
            "op": F.lit("put"),
            "updated_at": moved(1),
        }
    )
    nothing = {
        f.name: F.lit(None).cast(f.dataType)
        for f in rows.schema
        if f.name not in ("id", "created_at")
    }
    gone = rows.filter("algorithm = 'gbt'").withColumns(
        {**nothing, "op": F.lit("delete"), "updated_at": moved(2)}
    )
    first_day = rows.agg(F.min("created_at").alias("created_at"))
    cleared = first_day.withColumns(
        {**nothing, "id": F.lit(None).cast("string"), "op": F.lit("clear"), "updated_at": moved(365)}
    )
    return puts.unionByName(again).unionByName(gone).unionByName(cleared)


# Predictions: three actual classes, a fourth that is only predicted.
PREDICTIONS_SQL = """predictions AS (SELECT o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'O' THEN 1.0 ELSE 2.0 END AS label,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 4 AS DOUBLE) AS prediction FROM orders)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    label = F.expr("CASE o_orderstatus WHEN 'F' THEN 0D WHEN 'O' THEN 1D ELSE 2D END")
    rule = (F.floor("o_totalprice").cast("bigint") % 4).cast("double")
    return table(spark, folder, "orders").select(
        "o_orderkey", label.alias("label"), rule.alias("prediction")
    )


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def hash_split_sql(key: list[str], test_size: float, seed: int = 42) -> str:
    """The training side of the keyed split."""
    text = f"concat_ws('-', {', '.join(key)}, '{seed}')"
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT < {round((1 - test_size) * 2**32)}"
