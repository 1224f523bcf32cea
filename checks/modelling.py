"""Preparation, training, scoring and evaluation over whole tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from checks.inputs import PREDICTIONS_SQL, hash_split_sql, predictions, table
from sparkprof.columns import split_by_kind
from sparkprof.operators import evaluate, features, indexing
from sparkprof.plans import registry
from sparkprof.plans.training import (
    SCALED,
    TrainSpec,
    feature_stages,
    indexed,
    load_registered,
    register_run,
    train,
)
from sparkprof.scratch import new_path

_LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _nullable_orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr("nullif(o_orderstatus, 'F')").alias("status"),
        F.expr("if(o_custkey % 4 = 0, double('NaN'), o_totalprice)").alias("price"),
        "o_orderpriority",
    )


def select_columns(spark, folder):
    orders = table(spark, folder, "orders")
    return features.select_columns(orders, ["o_totalprice", "o_custkey"], "o_orderstatus")


_select_columns = "SELECT o_totalprice, o_custkey, o_orderstatus FROM orders"


def dropna_rows(spark, folder):
    """Rows with a NULL or a NaN in the chosen columns go."""
    return features.drop_incomplete(_nullable_orders(spark, folder), ["status", "price"])


_dropna_rows = """SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price, o_orderpriority
FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 4 <> 0"""


def label_projection(spark, folder):
    """Numbers and booleans as labels, every column kept."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_totalprice") > 50_000).alias("large")
    )
    numbers = features.with_label(rows, "o_custkey", "number_label")
    return features.with_label(numbers, "large")


_label_projection = """SELECT o_orderkey, o_custkey, o_totalprice > 50000 AS large,
  o_custkey::DOUBLE AS number_label, (o_totalprice > 50000)::INT::DOUBLE AS label FROM orders"""


def split_sizes(spark, folder):
    rows = table(spark, folder, "lineitem")
    return features.split_sizes(rows, features.in_train(_LINE_KEY, 0.3))


_split_sizes = f"""SELECT count(*) FILTER (t)::BIGINT AS train_size,
  count(*) FILTER (NOT t)::BIGINT AS test_size
FROM (SELECT {hash_split_sql(_LINE_KEY, 0.3)} AS t FROM lineitem)"""


def split_rows(spark, folder):
    """The same rows whatever the partitioning."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    train_rows, test_rows = features.hash_split(orders.repartition(7), ["o_orderkey"], 0.2)
    return train_rows.withColumn("side", F.lit("train")).unionAll(
        test_rows.withColumn("side", F.lit("test"))
    )


_split_rows = f"""SELECT o_orderkey, o_custkey,
  CASE WHEN {hash_split_sql(['o_orderkey'], 0.2)} THEN 'train' ELSE 'test' END AS side FROM orders"""


def string_index(spark, folder):
    """Values by frequency, ties alphabetical."""
    return indexing.index_values(table(spark, folder, "documents"), "source")


_string_index = """SELECT source AS value, count(*)::BIGINT AS n,
  row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS "index" FROM documents GROUP BY source"""


def string_index_rows(spark, folder):
    """Rows with their index: hot values matched in place, rare and unknown ones too."""
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    values = indexing.index_values(parts.filter("p_name <> 'red widget'"), "p_name")
    asked = parts.withColumn("p_name", F.expr("nullif(p_name, 'blue bolt')"))
    return indexing.apply_index(asked, "p_name", values, hot_share=20)


_string_index_rows = """WITH ix AS (SELECT p_name, row_number() OVER (ORDER BY count(*) DESC, p_name) - 1 AS i
  FROM part WHERE p_name <> 'red widget' GROUP BY p_name),
asked AS (SELECT p_partkey, nullif(p_name, 'blue bolt') AS p_name FROM part)
SELECT p_partkey, p_name, coalesce(i, (SELECT count(*) FROM ix))::DOUBLE AS p_name_indexed
FROM asked LEFT JOIN ix USING (p_name)"""


def _prepared(rows, names):
    stages = feature_stages(rows, names)
    texts = {n: indexing.index_values(rows, n) for n in split_by_kind(rows, names)[1]}
    rows = indexed(rows, names, texts)
    return Pipeline(stages=stages).fit(rows).transform(rows)


def assemble(spark, folder):
    """Numbers first, then indexed strings; rows with missing numbers are skipped."""
    rows = table(spark, folder, "lineitem").select(
        *_LINE_KEY, "l_returnflag", "l_quantity",
        F.expr("nullif(l_discount, 0.0D)").alias("discount"),
    )
    vectors = _prepared(rows, ["l_returnflag", "l_quantity", "discount"])
    parts = vector_to_array("_assembled")
    return vectors.select(
        *_LINE_KEY, *[parts[i].alias(n) for i, n in enumerate(("quantity", "discount", "flag"))]
    )


_assemble = f"""WITH ix AS (SELECT l_returnflag, row_number() OVER
    (ORDER BY count(*) DESC, l_returnflag) - 1 AS i FROM lineitem GROUP BY l_returnflag)
SELECT {', '.join(_LINE_KEY)}, l_quantity AS quantity, l_discount AS discount, i::DOUBLE AS flag
FROM lineitem JOIN ix USING (l_returnflag) WHERE l_discount <> 0"""


def standard_scale(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    scaled = vector_to_array(SCALED)
    return _prepared(rows, ["o_totalprice", "o_custkey"]).select(
        "o_orderkey", F.round(scaled[0], 4).alias("price"), F.round(scaled[1], 4).alias("customer")
    )


_standard_scale = """SELECT o_orderkey,
  round(o_totalprice / (SELECT stddev_samp(o_totalprice) FROM orders), 4) AS price,
  round(o_custkey / (SELECT stddev_samp(o_custkey) FROM orders), 4) AS customer FROM orders"""


def confusion_matrix(spark, folder):
    """Three actual classes and one that is only predicted."""
    counts = evaluate.confusion_counts(predictions(spark, folder))
    return evaluate.confusion_cells(evaluate.confusion_matrix(counts))


def _confusion_sql(classes: int) -> str:
    return f"""WITH {PREDICTIONS_SQL} SELECT 'Actual ' || a AS actual, 'Predicted ' || p AS predicted,
  count(label)::BIGINT AS n FROM range({classes}) AS x(a) CROSS JOIN range({classes}) AS y(p)
  LEFT JOIN predictions ON label = a AND prediction = p GROUP BY ALL"""


def _many_classes(spark, folder):
    """Every customer is a class; predictions are often a neighbour."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("double").alias("label"),
        (F.col("o_custkey") + F.col("o_orderkey") % 3).cast("double").alias("prediction"),
    )
    return evaluate.confusion_counts(orders)


def confusion_many_classes(spark, folder):
    """The pairs that occur among thousands of classes."""
    return evaluate.named_cells(evaluate.confusion_sparse(_many_classes(spark, folder))[1])


_confusion_many_classes = """WITH pairs AS (SELECT o_custkey AS a, o_custkey + o_orderkey % 3 AS p FROM orders),
classes AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS place
  FROM (SELECT a AS class FROM pairs UNION SELECT p FROM pairs))
SELECT 'Actual ' || x.place AS actual, 'Predicted ' || y.place AS predicted, count(*)::BIGINT AS n
FROM pairs JOIN classes x ON x.class = a JOIN classes y ON y.class = p GROUP BY ALL"""


def confusion_filled(spark, folder):
    """Every cell, zeros too, as totals of the rows of the matrix; a hundred customers a class."""
    orders = table(spark, folder, "orders").select(
        F.floor(F.col("o_custkey") / 100).cast("double").alias("label"),
        F.floor(F.col("o_custkey") / 90).cast("double").alias("prediction"),
    )
    classes, cells = evaluate.confusion_sparse(evaluate.confusion_counts(orders))
    filled = evaluate.filled_cells(cells, classes.count())
    return filled.groupBy("position").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("n") > 0).alias("used"), F.sum("n").alias("n")
    )


_confusion_filled = """WITH pairs AS (SELECT floor(o_custkey / 100) AS a, floor(o_custkey / 90) AS p FROM orders),
classes AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS position
  FROM (SELECT a AS class FROM pairs UNION SELECT p FROM pairs))
SELECT position, (SELECT count(*) FROM classes)::BIGINT AS cells, count(DISTINCT p)::BIGINT AS used,
  count(p)::BIGINT AS n FROM classes LEFT JOIN pairs ON a = class GROUP BY position"""


def confusion_matrix_actual(spark, folder):
    """Only the classes that occur as labels."""
    counts = evaluate.confusion_counts(predictions(spark, folder))
    return evaluate.confusion_cells(evaluate.confusion_matrix(counts, actual_only=True))


def classification_metrics(spark, folder):
    found = evaluate.classification_metrics(evaluate.confusion_counts(predictions(spark, folder)))
    return found.select([F.round(c, 6).alias(c) for c in found.columns])


_classification_metrics = f"""WITH {PREDICTIONS_SQL}, classes AS (
  SELECT c::DOUBLE AS c, count(*) FILTER (label = c AND prediction = c) AS hits,
    count(*) FILTER (label = c) AS actual, count(*) FILTER (prediction = c) AS predicted
  FROM predictions, range(4) AS r(c) GROUP BY c),
scores AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p,
  CASE WHEN actual > 0 THEN hits / actual ELSE 0 END AS r FROM classes)
SELECT round(sum(hits) / sum(actual), 6) AS accuracy,
  round(sum(actual * p) / sum(actual), 6) AS precision,
  round(sum(actual * r) / sum(actual), 6) AS recall,
  round(sum(actual * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(actual), 6) AS f1
FROM scores"""


def _scored(spark, folder):
    return table(spark, folder, "lineitem").select(
        (F.col("l_linestatus") == "O").cast("int").alias("label"), "l_extendedprice", "l_quantity"
    )


def roc_auc(spark, folder):
    """A score that is nearly unique and one with many ties."""
    rows = _scored(spark, folder)
    parts = [
        evaluate.roc_auc(rows, name).select(
            F.lit(name).alias("score"), F.round("roc_auc", 8).alias("roc_auc")
        )
        for name in ("l_extendedprice", "l_quantity")
    ]
    return parts[0].unionAll(parts[1])


_roc_auc = " UNION ALL ".join(
    f"""SELECT '{s}' AS score, round(sum(p * (below + n / 2)) / (sum(p)::DOUBLE * sum(n)), 8) AS roc_auc
FROM (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0)::DOUBLE AS below
  FROM (SELECT {s} AS s, count(*) FILTER (l_linestatus = 'O')::DOUBLE AS p,
    count(*) FILTER (l_linestatus <> 'O')::DOUBLE AS n FROM lineitem GROUP BY 1))"""
    for s in ("l_extendedprice", "l_quantity")
)


def regression_metrics(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")
    )
    found = evaluate.regression_metrics(rows)
    return found.select([F.round(c, 4).alias(c) for c in found.columns])


_regression_metrics = """SELECT round(sqrt(avg((p - l) ** 2)), 4) AS rmse, round(avg(abs(p - l)), 4) AS mae,
  round(1 - sum((l - p) ** 2) / (var_pop(l) * count(*)), 4) AS r2
FROM (SELECT l_extendedprice AS l, l_quantity * 1500 AS p FROM lineitem)"""


def predicted_vs_actual(spark, folder):
    return evaluate.predicted_vs_actual(predictions(spark, folder), ["o_orderkey"])


_predicted_vs_actual = f"""WITH {PREDICTIONS_SQL} SELECT o_orderkey, label::DOUBLE AS actual,
  prediction AS predicted FROM predictions ORDER BY o_orderkey LIMIT 100"""


def linreg_coefficients(spark, folder):
    """A closed form: slope and intercept over the whole table."""
    rows = features.with_label(
        table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice"), "l_extendedprice"
    )
    stages = feature_stages(rows, ["l_quantity"])
    fitted = Pipeline(stages=[*stages, LinearRegression(featuresCol=SCALED)]).fit(rows)
    slope = float(fitted.stages[-1].coefficients[0] / fitted.stages[-2].std[0])
    values = (slope, float(fitted.stages[-1].intercept))
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.round(F.lit(values[0]), 5).alias("slope"), F.round(F.lit(values[1]), 3).alias("intercept")
    )


_linreg_coefficients = """SELECT count(*)::BIGINT AS "rows",
  round(regr_slope(l_extendedprice, l_quantity), 5) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem"""


# Training: the model must beat what knows only the labels of the test side, and the
# metrics of the run must be those of the returned predictions.
def _trained(df, **spec):
    # The test tables lie in one file each: spread them over the cores.
    cores = df.sparkSession.sparkContext.defaultParallelism
    result = train(df, TrainSpec(**spec, partitions=cores))
    rows = result.predictions
    if spec["model_type"] == "regression":
        error = F.col("label") - F.col("prediction")
        found = rows.agg(
            F.round(F.stddev_pop("label"), 4).alias("baseline"), F.sqrt(F.avg(error * error)).alias("found")
        )
        name, better = "rmse", F.col("found") < F.col("baseline")
    else:
        share = F.max("n") / F.sum("n")
        baseline = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.round(share, 6)).scalar()
        found = rows.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("found"))
        found = found.withColumn("baseline", baseline)
        name, better = "accuracy", F.col("found") >= F.col("baseline")
    found = found.select("baseline", better.alias("better"), "found").first()
    cells = F.aggregate(F.flatten("confusion_matrix"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return result.run.select(
        "model_type", "algorithm", "target", F.size("features").alias("features"),
        "train_size", "test_size", F.lit(found["baseline"]).alias("baseline"),
        F.lit(found["better"]).alias("better"),
        (F.abs(F.col("metrics")[name] - F.lit(found["found"])) < 1e-9).alias("recomputed"),
        F.coalesce(cells == F.col("test_size"), F.lit(True)).alias("matrix_complete"),
    )


def _trained_sql(source, key, test_size, model_type, algorithm, target, features_, expression=None):
    t = hash_split_sql(key, test_size)
    value = expression or target
    if model_type == "regression":
        baseline = f"round(stddev_pop({value}) FILTER (NOT ({t})), 4)"
    else:
        baseline = f"""round((SELECT max(n) / sum(n)::DOUBLE FROM (SELECT count(*) AS n FROM {source}
    WHERE NOT ({t}) GROUP BY {value})), 6)"""
    return f"""SELECT '{model_type}' AS model_type, '{algorithm}' AS algorithm, '{target}' AS target,
  {features_} AS features, count(*) FILTER ({t})::BIGINT AS train_size,
  count(*) FILTER (NOT ({t}))::BIGINT AS test_size, {baseline} AS baseline, true AS better,
  true AS recomputed, true AS matrix_complete FROM {source}"""


_DIMENSIONS = [f"x{i}" for i in range(64)]


_CORNER = "if(x0 > 0, 2, 0) + if(x1 > 0, 1, 0)"
_CORNER_SQL = "if(embedding[1] > 0, 2, 0) + if(embedding[2] > 0, 1, 0)"


def _embeddings(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rows.select(
        "vec_id", "label", *[F.col("embedding")[i].alias(n) for i, n in enumerate(_DIMENSIONS)]
    ).withColumnRenamed("label", "digit").withColumn("corner", F.expr(_CORNER))


_QUALITY_FEATURES = ["n_chars", "lang", "source", "toxic"]
# Targets that the features explain, which those of the tables are not.
_LONG = "if(n_chars > 1500, 1, 0)"
_DEAR = "if(l_quantity > 25, 'dear', 'cheap')"
_COST = "l_quantity * (1 + l_tax) * 100 - l_linenumber"


def _quality(spark, folder):
    """Labelled documents: the label table is joined to the documents it covers."""
    documents = table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    return documents.join(table(spark, folder, "labels"), "doc_id").withColumn("long", F.expr(_LONG))


def _lines(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rows.withColumns({"price": F.expr(_DEAR), "cost": F.expr(_COST)})


_LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linenumber"]
_LABELLED = "documents JOIN labels USING (doc_id)"


def _classifier(algorithm, rows, source, key, target, names, expression=None, **spec):
    """A query that trains with the default parameters, and its SQL."""

    def query(spark, folder):
        return _trained(
            rows(spark, folder), model_type="classification", algorithm=algorithm,
            features=names, target=target, key=key, **spec,
        )

    return query, _trained_sql(
        source, key, spec.get("test_size", 0.2), "classification", algorithm, target, len(names),
        expression,
    )


def _regressor(algorithm):
    def query(spark, folder):
        return _trained(
            _lines(spark, folder), model_type="regression", algorithm=algorithm,
            features=_LINE_FEATURES, target="cost", key=_LINE_KEY,
        )

    return query, _trained_sql(
        "lineitem", _LINE_KEY, 0.2, "regression", algorithm, "cost", len(_LINE_FEATURES), _COST
    )


def train_kmeans(spark, folder):
    """Ten clusters of the embeddings hold the ten labels better than one would."""
    rows = _embeddings(spark, folder)
    result = train(rows, TrainSpec(
        model_type="clustering", algorithm="kmeans", features=_DIMENSIONS, params={"k": 10}, key=["vec_id"],
        partitions=spark.sparkContext.defaultParallelism,
    ))
    cells = result.model.score(rows).groupBy("prediction", "digit").count()
    pure = cells.groupBy("prediction").agg(F.max("count").alias("hits")).agg(F.sum("hits")).scalar()
    share = rows.groupBy("digit").count().agg(
        F.max("count").alias("most"), F.sum("count").alias("rows")
    )
    return share.select(
        "rows", F.round(F.col("most") / F.col("rows"), 6).alias("baseline"),
        (pure / F.col("rows") > F.col("most") / F.col("rows")).alias("better"),
        F.lit(abs(result.run.first()["metrics"]["silhouette"]) <= 1).alias("silhouette"),
    )


_train_kmeans = """SELECT sum(n)::BIGINT AS "rows", round(max(n) / sum(n)::DOUBLE, 6) AS baseline,
  true AS better, true AS silhouette FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)"""


def random_split(spark, folder):
    """Spark's own split: sizes add up, no row is on both sides, the share is about right."""
    rows = table(spark, folder, "orders").select("o_orderkey")
    first, second = features.random_split(rows, 0.25)
    both = first.withColumn("side", F.lit(0)).unionAll(second.withColumn("side", F.lit(1)))
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys"),
        F.avg("side").between(0.2, 0.3).alias("share"),
    )


_random_split = """SELECT count(*)::BIGINT AS "rows", count(DISTINCT o_orderkey)::BIGINT AS keys,
  true AS share FROM orders"""


def _linear_on_train(spark, folder):
    spec = TrainSpec(
        model_type="regression", algorithm="linear_regression", features=["l_quantity"],
        target="l_extendedprice", key=_LINE_KEY,
    )
    lines = table(spark, folder, "lineitem")
    return train(lines, spec).model, lines


def score_batch(spark, folder):
    """A model fitted on the training side scores the whole table."""
    model, lines = _linear_on_train(spark, folder)
    scored = model.score(lines.select(*_LINE_KEY, "l_quantity"))
    return scored.select(*_LINE_KEY, F.round("prediction", 2).alias("prediction"))


_score_batch = f"""WITH fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a,
  regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem
  WHERE {hash_split_sql(_LINE_KEY, 0.2)})
SELECT {', '.join(_LINE_KEY)}, round(a * l_quantity + b, 2) AS prediction FROM lineitem, fit"""


def model_save_load(spark, folder):
    """A model with a text feature and target, stored and found again by its run."""
    lines = table(spark, folder, "lineitem")
    spec = TrainSpec(
        model_type="classification", algorithm="decision_tree",
        features=["l_quantity", "l_returnflag"], target="l_linestatus", key=_LINE_KEY,
        params={"maxDepth": 3},
    )
    result, runs = train(lines, spec), new_path(spark, "runs")
    identifier = register_run(result, new_path(spark, "models"), runs)
    current = registry.current(registry.open_registry(spark, runs, registry.RUN_SCHEMA))
    model, loaded = result.model, load_registered(current, identifier)
    both = loaded.score(model.score(lines).select(
        *lines.columns, F.col("prediction").alias("first"),
        F.col("predicted_label").alias("first_label"),
    ))
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("prediction") != F.col("first")).alias("changed"),
        F.count_if(F.col("predicted_label") != F.col("first_label")).alias("renamed"),
    )


_model_save_load = """SELECT count(*)::BIGINT AS "rows", 0::BIGINT AS changed, 0::BIGINT AS renamed
FROM lineitem"""


_NUMBERS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def feature_importance(spark, folder):
    """The feature that goes with the target most weighs most; the weights add up to one."""
    spec = TrainSpec(
        model_type="regression", algorithm="random_forest_reg", features=_NUMBERS,
        target="cost", key=_LINE_KEY,
    )
    found = train(_lines(spark, folder), spec).model.importances()
    whole = found.agg(F.round(F.sum("importance"), 6).alias("total"), F.max("importance").alias("most"))
    whole = whole.select(F.struct("total", "most")).scalar()
    return found.select(
        "feature", (F.col("importance") == whole.getField("most")).alias("first"),
        whole.getField("total").alias("total"),
    )


_feature_importance = "WITH found AS (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS feature, abs(corr({name}, {_COST})) AS c FROM lineitem
WHERE {hash_split_sql(_LINE_KEY, 0.2)}""" for name in _NUMBERS
) + """) SELECT feature, c = (SELECT max(c) FROM found) AS "first", 1.0::DOUBLE AS total FROM found"""

QUERIES = {
    "select_columns": (select_columns, _select_columns),
    "dropna_rows": (dropna_rows, _dropna_rows),
    "label_projection": (label_projection, _label_projection),
    "split_sizes": (split_sizes, _split_sizes),
    "split_rows": (split_rows, _split_rows),
    "string_index": (string_index, _string_index),
    "string_index_rows": (string_index_rows, _string_index_rows),
    "assemble": (assemble, _assemble),
    "standard_scale": (standard_scale, _standard_scale),
    "confusion_matrix": (confusion_matrix, _confusion_sql(4)),
    "confusion_many_classes": (confusion_many_classes, _confusion_many_classes),
    "confusion_filled": (confusion_filled, _confusion_filled),
    "confusion_matrix_actual": (confusion_matrix_actual, _confusion_sql(3)),
    "classification_metrics": (classification_metrics, _classification_metrics),
    "roc_auc": (roc_auc, _roc_auc),
    "regression_metrics": (regression_metrics, _regression_metrics),
    "predicted_vs_actual": (predicted_vs_actual, _predicted_vs_actual),
    "linreg_coefficients": (linreg_coefficients, _linreg_coefficients),
    "train_logistic_regression": _classifier(
        "logistic_regression", _embeddings, "embeddings", ["vec_id"], "corner", _DIMENSIONS, _CORNER_SQL
    ),
    "train_decision_tree": _classifier(
        "decision_tree", _quality, _LABELLED, ["doc_id"], "long", _QUALITY_FEATURES,
        _LONG,
    ),
    "train_random_forest": _classifier(
        "random_forest", _embeddings, "embeddings", ["vec_id"], "corner", _DIMENSIONS, _CORNER_SQL
    ),
    "train_gbt": _classifier(
        "gbt", _lines, "lineitem", _LINE_KEY, "price", _LINE_FEATURES, _DEAR, test_size=0.3
    ),
    "train_naive_bayes": _classifier(
        "naive_bayes", _lines, "lineitem", _LINE_KEY, "price", _LINE_FEATURES, _DEAR
    ),
    "train_linear_svc": _classifier(
        "linear_svc", _lines, "lineitem", _LINE_KEY, "price", _LINE_FEATURES, _DEAR
    ),
    "train_kmeans": (train_kmeans, _train_kmeans),
    "train_linear_regression": _regressor("linear_regression"),
    "train_decision_tree_reg": _regressor("decision_tree_reg"),
    "train_random_forest_reg": _regressor("random_forest_reg"),
    "train_gbt_reg": _regressor("gbt_reg"),
    "random_split": (random_split, _random_split),
    "score_batch": (score_batch, _score_batch),
    "model_save_load": (model_save_load, _model_save_load),
    "feature_importance": (feature_importance, _feature_importance),
}
