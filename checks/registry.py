"""Registry and reports over one run per order and one dataset per part."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.inputs import (
    DATASETS_SQL,
    METRICS,
    REGISTRY_SQL,
    RUNS_SQL,
    datasets,
    registry,
    runs,
    table,
    union_sql,
)
from sparkprof.functions.text import joined
from sparkprof.plans import algorithms, reports
from sparkprof.plans import registry as R
from sparkprof.scratch import new_path

_BOTH = f"WITH {RUNS_SQL}, {DATASETS_SQL}"


def registry_register(spark, folder):
    """A table is stored, profiled and registered; the registry gives it back."""
    rows = table(spark, folder, "orders")
    entries = new_path(spark, "registry")
    R.register_dataset(rows, "orders.parquet", new_path(spark, "datasets"), entries, "orders-1")
    current = R.current(R.open_registry(spark, entries, R.DATASET_SCHEMA))
    described = current.select("id", "filename", "row_count", "column_count", F.inline("columns"))
    stored = spark.read.parquet(current.first()["path"])
    return described.withColumn(
        "stored_rows", stored.agg(F.count(F.lit(1))).scalar()
    )


_registry_register = union_sql(
    f"""SELECT 'orders-1' AS id, 'orders.parquet' AS filename, count(*)::BIGINT AS row_count,
  6 AS column_count, '{c}' AS name, '{kind}' AS type, '{stored}' AS spark_type, true AS nullable,
  (count(*) - count({c}))::BIGINT AS null_count, count({c})::BIGINT AS non_null_count,
  count(*)::BIGINT AS stored_rows FROM orders"""
    for c, kind, stored in (
        ("o_orderkey", "integer", "bigint"), ("o_custkey", "integer", "bigint"),
        ("o_orderstatus", "string", "string"), ("o_totalprice", "numeric", "double"),
        ("o_orderdate", "datetime", "timestamp_ntz"), ("o_orderpriority", "string", "string"),
    )
)

def registry_appended(spark, folder):
    """A table that is registered with a third of its rows; the rest is appended in two parts."""
    rows = table(spark, folder, "orders")
    part = lambda k: rows.filter(F.pmod("o_orderkey", F.lit(3)) == k)
    entries = new_path(spark, "registry")
    R.register_dataset(part(0), "orders.parquet", new_path(spark, "datasets"), entries, "orders-1")
    current = lambda: R.current(R.open_registry(spark, entries, R.DATASET_SCHEMA))
    for k in (1, 2):
        R.append_to_dataset(part(k), current(), "orders-1", entries)
    described = current().select("id", "filename", "row_count", "column_count", F.inline("columns"))
    stored = R.read_dataset(current(), "orders-1")
    return described.withColumn("stored_rows", stored.agg(F.count(F.lit(1))).scalar())


_registry_appended = _registry_register


def registry_current(spark, folder):
    """The latest state of every run after puts, deletes and a clear."""
    current = R.current(registry(spark, folder))
    return current.select("id", "name", "test_size", F.col("updated_at").cast("string"))


_registry_current = f"""WITH {REGISTRY_SQL},
cleared AS (SELECT max(updated_at) AS cleared_at FROM changes WHERE op = 'clear'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id
    ORDER BY updated_at DESC, op = 'delete' DESC) AS place
  FROM changes, cleared WHERE op <> 'clear' AND updated_at > cleared_at)
SELECT id, name, test_size::BIGINT AS test_size,
  strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM ranked WHERE place = 1 AND op = 'put'"""


def registry_snapshot(spark, folder):
    """The same from a stored log of which a snapshot holds the first half."""
    log, path = registry(spark, folder), new_path(spark, "log")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema if f.name not in R.CHANGE)
    early = F.pmod(F.xxhash64("id", "updated_at"), F.lit(2)) == 0
    R.append(log.filter(early), path)
    R.take_snapshot(spark, path, schema)
    R.append(log.filter(~early), path)
    current = R.current(R.open_registry(spark, path, schema))
    return current.select("id", "name", "test_size", F.col("updated_at").cast("string"))


def registry_deleted(spark, folder):
    """The runs of one algorithm are deleted by their ids."""
    rows = R.changes(runs(spark, folder), at=datetime(2024, 1, 1))
    ids = rows.filter("algorithm = 'gbt'").select("id")
    gone = R.deleted(ids, rows, at=datetime(2024, 1, 2))
    return R.current(rows.unionByName(gone)).select("id", "name", "train_size", "test_size")


_registry_deleted = f"""WITH {RUNS_SQL} SELECT id, name, train_size, test_size FROM runs
WHERE algorithm <> 'gbt'"""


def registry_updated(spark, folder):
    """A changed field of some runs; ids that are not registered change nothing."""
    rows = runs(spark, folder)
    changed = table(spark, folder, "lineitem").groupBy(
        F.md5(F.concat(F.lit("run-"), F.col("l_orderkey") * 2)).alias("id")
    ).agg(F.max("l_linenumber").cast("bigint").alias("train_size"))
    return R.updated(rows, changed).select("id", "name", "train_size", "test_size")


_registry_updated = f"""WITH {RUNS_SQL}, changed AS (
  SELECT md5(concat('run-', l_orderkey * 2)) AS id, max(l_linenumber)::BIGINT AS train_size
  FROM lineitem GROUP BY ALL)
SELECT id, name, changed.train_size, test_size FROM runs JOIN changed USING (id)"""


def registry_lookup(spark, folder):
    """Which dataset ids the runs ask for exist."""
    ids = runs(spark, folder).select(F.col("dataset_id").alias("id"))
    return R.lookup(ids, datasets(spark, folder))


_registry_lookup = f"""{_BOTH} SELECT DISTINCT dataset_id AS id,
  dataset_id IN (SELECT id FROM datasets) AS found FROM runs"""


def registry_missing(spark, folder):
    """Runs whose dataset is gone."""
    rows = runs(spark, folder).select(F.col("id").alias("run_id"), F.col("dataset_id").alias("id"))
    return R.missing(rows, datasets(spark, folder))


_registry_missing = f"""{_BOTH} SELECT id AS run_id, dataset_id AS id FROM runs
WHERE dataset_id NOT IN (SELECT id FROM datasets)"""


def registry_list(spark, folder):
    listed = R.run_list(runs(spark, folder))
    return listed.select(
        "model_id", "name", "model_type", "algorithm", joined(F.col("features")).alias("features"),
        "target", F.col("params")["maxDepth"].alias("max_depth"),
        F.size("metrics").alias("metrics"), "dataset_id", "train_size", "test_size",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
    )


_COUNT_METRICS = " + ".join(f"({m} IS NOT NULL)::INT" for m in METRICS)
_FEATURES = """array_to_string(list_transform(range(o_orderkey % 3 + 1), lambda i: 'feature_' || i),
    ', ')"""
_registry_list = f"""WITH {RUNS_SQL} SELECT id AS model_id, name, model_type, algorithm,
  {_FEATURES} AS features, target, max_depth, {_COUNT_METRICS} AS metrics, dataset_id,
  train_size, test_size, strftime(created_at, '%Y-%m-%d') AS created FROM runs"""


def dashboard(spark, folder):
    """Totals beside the most recent runs and datasets."""
    sets, rows = datasets(spark, folder), runs(spark, folder)
    totals = reports.dashboard_totals(sets, rows)
    recent = reports.most_recent(rows.select("id", "created_at")).select(
        F.lit("model").alias("kind"), "id"
    ).unionAll(
        reports.most_recent(sets.select("id", "created_at")).select(F.lit("dataset"), "id")
    )
    counted = totals.select(F.struct("datasets", "files", "models")).scalar()
    return recent.select(
        "kind", "id", *[counted.getField(c).alias(c) for c in ("datasets", "files", "models")]
    )


_dashboard = f"""{_BOTH}, totals AS (SELECT
  (SELECT count(*) FROM datasets)::BIGINT AS datasets, (SELECT count(path) FROM datasets)::BIGINT AS files,
  (SELECT count(*) FROM runs)::BIGINT AS models)
SELECT kind, id, totals.* FROM (
  (SELECT 'model' AS kind, id FROM runs ORDER BY created_at DESC, id LIMIT 5) UNION ALL
  (SELECT 'dataset', id FROM datasets ORDER BY p_partkey DESC LIMIT 5)) recent, totals"""


def algorithm_catalog(spark, folder):
    """The catalog with the number of runs of each algorithm."""
    used = algorithms.catalog_use(runs(spark, folder))
    return used.withColumn("params", joined(F.col("params")))


_CATALOG = union_sql(
    "SELECT '{}' AS model_type, '{}' AS algorithm, '{}' AS name, '{}' AS params".format(*row)
    for row in (
        ("classification", "logistic_regression", "Logistic Regression",
         "maxIter, regParam, elasticNetParam"),
        ("classification", "decision_tree", "Decision Tree",
         "maxDepth, minInstancesPerNode, impurity"),
        ("classification", "random_forest", "Random Forest",
         "numTrees, maxDepth, minInstancesPerNode, subsamplingRate"),
        ("classification", "gbt", "Gradient Boosted Trees", "maxIter, maxDepth, stepSize"),
        ("regression", "linear_regression", "Linear Regression",
         "maxIter, regParam, elasticNetParam"),
        ("regression", "decision_tree_reg", "Decision Tree Regressor",
         "maxDepth, minInstancesPerNode, impurity"),
        ("regression", "random_forest_reg", "Random Forest Regressor",
         "numTrees, maxDepth, minInstancesPerNode, subsamplingRate"),
        ("regression", "gbt_reg", "Gradient Boosted Trees Regressor",
         "maxIter, maxDepth, stepSize"),
    )
)
_algorithm_catalog = f"""WITH {RUNS_SQL}, catalog AS ({_CATALOG}),
used AS (SELECT model_type, algorithm, count(*) AS n FROM runs GROUP BY ALL)
SELECT model_type, algorithm, catalog.name, params, coalesce(n, 0)::BIGINT AS runs
FROM catalog LEFT JOIN used USING (model_type, algorithm)"""


def report_model(spark, folder):
    """The full report of every run, nested parts spread out."""
    found = reports.model_reports(runs(spark, folder), datasets(spark, folder))
    return found.select(
        "id", "type", "algorithm", joined(F.col("features")).alias("features"), "target",
        F.col("parameters")["maxIter"].alias("max_iter"),
        *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in METRICS],
        F.col("dataset.id").alias("dataset_id"), "dataset.filename",
        "data_split.train_size", "data_split.test_size",
    )


_report_model = f"""{_BOTH} SELECT runs.id, model_type AS type, algorithm, {_FEATURES} AS features,
  target, max_iter, {', '.join(f'{m}::DOUBLE AS {m}' for m in METRICS)}, datasets.id AS dataset_id,
  filename, train_size, test_size FROM runs LEFT JOIN datasets ON dataset_id = datasets.id"""


def report_all_models(spark, folder):
    found = reports.model_entries(runs(spark, folder), datasets(spark, folder))
    return found.select(
        "id", "type", "algorithm", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.size("metrics").alias("metrics"), F.col("dataset.id").alias("dataset_id"),
        "dataset.filename",
    )


_report_all_models = f"""{_BOTH} SELECT runs.id, model_type AS type, algorithm,
  strftime(created_at, '%Y-%m-%d') AS created, {_COUNT_METRICS} AS metrics,
  datasets.id AS dataset_id, filename FROM runs LEFT JOIN datasets ON dataset_id = datasets.id"""


def report_overview(spark, folder):
    return reports.overview(runs(spark, folder))


_report_overview = f"""WITH {RUNS_SQL}
SELECT 'total' AS section, 'Total Models' AS label, count(*)::BIGINT AS n FROM runs
UNION ALL SELECT 'by_type', upper(model_type[1]) || model_type[2:], count(*) FROM runs
GROUP BY model_type
UNION ALL SELECT 'by_algorithm', algorithm, count(*) FROM runs GROUP BY algorithm"""


def report_summary(spark, folder):
    return reports.summary(runs(spark, folder))


_FACTS = {
    "Model ID": "id", "Model Type": "upper(model_type)", "Algorithm": "algorithm",
    "Created At": "strftime(created_at, '%Y-%m-%dT%H:%M:%S')", "Dataset ID": "dataset_id",
    "Target Variable": "coalesce(target, 'N/A')",
    "Number of Features": "(o_orderkey % 3 + 1)::VARCHAR", "Train Size": "train_size::VARCHAR",
    "Test Size": "test_size::VARCHAR",
}
_report_summary = f"WITH {RUNS_SQL}\n" + union_sql(
    [f"SELECT id, {i} AS position, '{k}' AS label, {v} AS value FROM runs"
     for i, (k, v) in enumerate(_FACTS.items())]
    + ["SELECT id, (9 + i)::INTEGER, 'Feature', 'feature_' || i FROM "
       "(SELECT id, unnest(range(o_orderkey % 3 + 1)) AS i FROM runs)"]
)

_TITLES = {"accuracy": "Accuracy", "f1": "F1", "rmse": "Rmse", "r2": "R2",
           "silhouette": "Silhouette"}


def report_metrics(spark, folder):
    return reports.metrics(runs(spark, folder))


_report_metrics = f"WITH {RUNS_SQL}\n" + union_sql(
    f"SELECT id, '{t}' AS metric, printf('%.4f', {m})::DOUBLE AS value FROM runs WHERE {m} IS NOT NULL"
    for m, t in _TITLES.items()
)


def report_parameters(spark, folder):
    return reports.parameters(runs(spark, folder))


_report_parameters = f"""WITH {RUNS_SQL}
SELECT id, 'maxDepth' AS parameter, max_depth AS value FROM runs
UNION ALL SELECT id, 'maxIter', max_iter FROM runs"""


def report_confusion_matrices(spark, folder):
    return reports.confusion_matrices(runs(spark, folder))


_report_confusion_matrices = f"WITH {RUNS_SQL}\n" + union_sql(
    f"""SELECT id, 'Actual {i // 2}' AS actual, 'Predicted {i % 2}' AS predicted,
  o_orderkey % {k} AS n FROM runs WHERE model_type = 'classification'"""
    for i, k in enumerate((7, 11, 13, 17))
)


def _cell(metric, of_type):
    """A metric as the report writes it; one of another type stays empty."""
    return f"""CASE WHEN model_type = '{of_type}' THEN
    coalesce(printf('%.4f', {metric})::DOUBLE::VARCHAR, 'N/A') END"""


def report_metrics_comparison(spark, folder):
    found = reports.metrics_comparison(runs(spark, folder))
    return found.select("Model ID", "Type", "Algorithm", "Created", "Accuracy", "F1 Score", "RMSE", "R²", "Silhouette")


_report_metrics_comparison = f"""WITH {RUNS_SQL} SELECT id[:8] || '...' AS "Model ID",
  model_type AS "Type", algorithm AS "Algorithm", strftime(created_at, '%Y-%m-%d') AS "Created",
  {_cell('accuracy', 'classification')} AS "Accuracy", {_cell('f1', 'classification')} AS "F1 Score",
  {_cell('rmse', 'regression')} AS "RMSE", {_cell('r2', 'regression')} AS "R²",
  {_cell('silhouette', 'clustering')} AS "Silhouette" FROM runs"""


def report_type_comparison(spark, folder):
    return reports.type_comparison(runs(spark, folder), "regression")


_report_type_comparison = f"""WITH {RUNS_SQL} SELECT id[:12] || '...' AS "Model ID",
  algorithm AS "Algorithm", printf('%.4f', rmse)::DOUBLE::VARCHAR AS "Rmse",
  coalesce(printf('%.4f', r2)::DOUBLE::VARCHAR, 'N/A') AS "R2" FROM runs WHERE model_type = 'regression'"""


def report_csv_views(spark, folder):
    """The report over all runs, written as sheets; every cell of every sheet read back."""
    written = reports.write_report(runs(spark, folder), datasets(spark, folder), new_path(spark, "report"))
    parts = []
    for view, path in written.items():
        sheet = spark.read.options(header=True, quote='"', escape='"').csv(path)
        cells = F.concat_ws("|", *[F.coalesce(f"`{c}`", F.lit("")) for c in sheet.columns])
        parts.append(sheet.select(F.lit(view).alias("view"), cells.alias("cells")))
    return reduce(DataFrame.unionAll, parts)


def _sheet(view, columns, sql):
    cells = ", ".join(f"coalesce({c}::VARCHAR, '')" for c in columns)
    return f"SELECT '{view}' AS \"view\", concat_ws('|', {cells}) AS cells FROM ({sql})"


def _type_sheet(model_type, metrics):
    cells = ", ".join(f"coalesce(printf('%.4f', {m})::DOUBLE::VARCHAR, 'N/A') AS {m}_cell" for m in metrics)
    sql = f"""WITH {RUNS_SQL} SELECT id[:12] || '...' AS short, algorithm, {cells} FROM runs
  WHERE model_type = '{model_type}'"""
    return _sheet(f"{model_type}_models", ["short", "algorithm", *[f"{m}_cell" for m in metrics]], sql)


_report_csv_views = union_sql([
    _sheet("overview", ["section", "label", "n"], _report_overview),
    _sheet("metrics_comparison", ['"Model ID"', '"Type"', '"Algorithm"', '"Created"', '"Accuracy"',
                                  '"F1 Score"', '"RMSE"', '"R²"', '"Silhouette"'],
           _report_metrics_comparison),
    _type_sheet("classification", ["accuracy", "f1"]),
    _type_sheet("regression", ["r2", "rmse"]),
    _type_sheet("clustering", ["silhouette"]),
])


def report_json_models(spark, folder):
    """The report over all runs, written as JSON; its models read back."""
    written = reports.write_report(
        runs(spark, folder), datasets(spark, folder), new_path(spark, "report"), format="json"
    )
    rows = spark.read.schema(
        "report_type string, id string, type string, algorithm string, created_at string, "
        "metrics map<string,double>, dataset struct<id:string,filename:string>"
    ).json(written["models"])
    return rows.select(
        "report_type", "id", "type", "algorithm", F.substring("created_at", 1, 10).alias("created"),
        F.size(F.map_filter("metrics", lambda _, v: v.isNotNull())).alias("metrics"),
        F.col("dataset.id").alias("dataset_id"), "dataset.filename",
    )


_report_json_models = f"""SELECT 'all_models' AS report_type, found.*
FROM ({_report_all_models}) AS found"""


def report_sample_data(spark, folder):
    return reports.sample_data(table(spark, folder, "customer"), ["c_custkey"])


_report_sample_data = "SELECT * FROM customer ORDER BY c_custkey LIMIT 100"


def dataset_profile_list(spark, folder):
    """The columns of a registered table, as a list of the registry shows them."""
    entry = R.dataset_entry(table(spark, folder, "customer"), "c", "customer.csv", None)
    listed = R.dataset_columns(entry)
    return listed.select("id", "name", "type", "null_count", "non_null_count")


_dataset_profile_list = union_sql(
    f"""SELECT 'c' AS id, '{c}' AS name, '{kind}' AS type,
  (count(*) - count({c}))::BIGINT AS null_count, count({c})::BIGINT AS non_null_count FROM customer"""
    for c, kind in {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer",
                    "c_acctbal": "numeric", "c_mktsegment": "string"}.items()
)


QUERIES = {
    "registry_register": (registry_register, _registry_register),
    "registry_appended": (registry_appended, _registry_appended),
    "registry_current": (registry_current, _registry_current),
    "registry_snapshot": (registry_snapshot, _registry_current),
    "registry_deleted": (registry_deleted, _registry_deleted),
    "registry_updated": (registry_updated, _registry_updated),
    "registry_lookup": (registry_lookup, _registry_lookup),
    "registry_missing": (registry_missing, _registry_missing),
    "registry_list": (registry_list, _registry_list),
    "dataset_profile_list": (dataset_profile_list, _dataset_profile_list),
    "dashboard": (dashboard, _dashboard),
    "algorithm_catalog": (algorithm_catalog, _algorithm_catalog),
    "report_model": (report_model, _report_model),
    "report_all_models": (report_all_models, _report_all_models),
    "report_overview": (report_overview, _report_overview),
    "report_summary": (report_summary, _report_summary),
    "report_metrics": (report_metrics, _report_metrics),
    "report_parameters": (report_parameters, _report_parameters),
    "report_confusion_matrices": (report_confusion_matrices, _report_confusion_matrices),
    "report_metrics_comparison": (report_metrics_comparison, _report_metrics_comparison),
    "report_type_comparison": (report_type_comparison, _report_type_comparison),
    "report_csv_views": (report_csv_views, _report_csv_views),
    "report_json_models": (report_json_models, _report_json_models),
    "report_sample_data": (report_sample_data, _report_sample_data),
}
