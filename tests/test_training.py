import pytest
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import StringIndexer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprof import scratch
from sparkprof.operators import evaluate, features, indexing, paging
from sparkprof.plans import algorithms, reports, training
from sparkprof.plans.registry import RUN_SCHEMA, current, open_registry
from sparkprof.plans.training import TrainedModel, TrainSpec, register_run, train, validate


@pytest.fixture(scope="module")
def rows(spark):
    """Awkward names, a text feature, and targets the features explain."""
    return spark.range(600).select(
        "id",
        (F.col("id") % 10).cast("double").alias("a.b"),
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").otherwise("z").alias("c_indexed"),
        (F.col("id") % 4 == 1).alias("back`tick"),
        F.when(F.col("id") % 10 > 4, "yes").otherwise("no").alias("answer"),
        (F.col("id") % 10 > 4).alias("flag"),
        (F.col("id") % 10 * 2.0 + 1).alias("number"),
        F.when(F.col("id") % 50 != 0, F.col("id") % 7).cast("double").alias("holes"),
        F.current_date().alias("day"),
    )


FEATURES = ["a.b", "c_indexed", "back`tick"]


def spec(**changed):
    given = dict(model_type="classification", algorithm="decision_tree", features=FEATURES,
                 target="answer", key=["id"], params={"maxDepth": 3})
    return TrainSpec(**{**given, **changed})


def test_text_target_of_two_classes_has_an_auc(rows):
    result = train(rows, spec())
    run = result.run.first()
    assert run["metrics"]["accuracy"] == run["metrics"]["roc_auc"] == 1.0
    assert run["train_size"] + run["test_size"] == 600
    assert sum(map(sum, run["confusion_matrix"])) == run["test_size"]
    assert set(run["feature_importance"]) == set(FEATURES)
    assert abs(sum(run["feature_importance"].values()) - 1) < 1e-9
    first = result.model.importances().first()
    assert first["feature"] == "a.b"
    scored = result.model.score(rows.drop("answer", "flag"))
    assert scored.filter((F.col("predicted_label") == "yes") != (F.col("`a.b`") > 4)).count() == 0
    assert not [c for c in scored.columns if c.startswith("_")]


def test_boolean_target_and_rows_with_holes(rows):
    result = train(rows, spec(target="flag", features=["a.b", "holes"]))
    run = result.run.first()
    assert result.dropped == 12
    assert run["train_size"] + run["test_size"] == 588
    assert run["metrics"]["roc_auc"] == 1.0


def test_regression(rows):
    result = train(rows, spec(model_type="regression", algorithm="linear_regression",
                              target="number", features=["a.b"], params={}))
    metrics = result.run.first()["metrics"]
    assert metrics["r2"] > 0.999999 and metrics["rmse"] < 1e-6
    assert result.run.first()["feature_importance"] is None
    assert result.model.importances().count() == 0


def test_text_features_are_indexed_across_the_cluster(rows):
    """Inputs keep one order, numbers first, whatever the number of values."""
    many = rows.withColumn("c_indexed", F.concat("c_indexed", (F.col("id") % 150).cast("string")))
    for table in (rows, many):
        model = train(table, spec(algorithm="random_forest", params={"numTrees": 3})).model
        assert list(model.indexes) == ["c_indexed"]
        assert model.pipeline.stages[1].getInputCols() == ["_feature_0", "_feature_2", "_feature_1"]
        unseen = table.withColumn("c_indexed", F.lit("never seen")).limit(5)
        scored = model.score(unseen)
        assert {r["c_indexed"] for r in scored.collect()} == {"never seen"} and scored.count() == 5


def test_the_split_reads_only_what_is_used(rows):
    """Without a key the rows are told apart by features and target."""
    with_more = rows.withColumn("more", F.rand())
    sizes = [train(t, spec(key=None)).run.first()["train_size"] for t in (rows, with_more)]
    assert sizes[0] == sizes[1]


def test_many_classes(spark):
    """More classes than trees take without being told."""
    df = spark.range(3_000).select("id", (F.col("id") % 150).cast("double").alias("x"),
                                   F.concat(F.lit("c"), F.col("id") % 150).alias("y"))
    run = train(df, spec(features=["x"], target="y", params={"maxDepth": 2}, key=["id"])).run.first()
    assert len(run["confusion_matrix"]) == 150
    assert sum(map(sum, run["confusion_matrix"])) == run["test_size"]


def test_twenty_thousand_classes(spark, tmp_path):
    """The record keeps no matrix then, the pairs that occur are beside the model and reported from there."""
    df = spark.range(60_000).select(
        "id", F.pmod("id", F.lit(20_000)).cast("double").alias("x"), F.lit(1.0).alias("w"),
        F.concat(F.lit("c"), F.pmod("id", F.lit(20_000))).alias("y"),
    )
    result = train(df, spec(algorithm="naive_bayes", features=["x", "w"], target="y", params={}, key=["id"], keep="table"))
    run = result.run.first()
    assert run["confusion_matrix"] is None
    cells = result.confusion
    # Classes that only test rows have are left out, as with fewer classes.
    scored = result.predictions.count()
    assert cells.agg(F.sum("n")).first()[0] == scored > 0.9 * run["test_size"]
    path = str(tmp_path / "runs")
    identifier = register_run(result, str(tmp_path / "models"), path)
    runs = current(open_registry(spark, path, RUN_SCHEMA))
    view = reports.single_model_views(runs, identifier)["confusion_matrix"]
    assert view.columns == ["id", "actual", "predicted", "n"] and view.count() == cells.count()
    assert view.agg(F.sum("n")).first()[0] == scored


def test_filled_cells_are_the_matrix(spark):
    counts = evaluate.confusion_counts(spark.createDataFrame(PAIRS, "label double, prediction double"))
    classes, cells = evaluate.confusion_sparse(counts)
    pick = lambda df: sorted(tuple(r) for r in df.collect())
    dense = evaluate.confusion_cells(evaluate.confusion_matrix(counts))
    assert pick(evaluate.named_cells(evaluate.filled_cells(cells, classes.count()))) == pick(dense)
    assert pick(evaluate.filled_cells(cells.limit(0), 0)) == []


def test_saved_models_predict_the_same(spark, rows, tmp_path):
    model = train(rows, spec()).model
    model.save(str(tmp_path / "m"))
    loaded = TrainedModel.load(spark, str(tmp_path / "m"))
    pick = lambda m: sorted(tuple(r) for r in m.score(rows).select("id", "predicted_label").collect())
    assert pick(loaded) == pick(model)


def test_numeric_classes_that_do_not_start_at_zero(rows):
    shifted = rows.withColumn("class", F.when(F.col("flag"), 70).otherwise(30))
    result = train(shifted, spec(target="class", index_labels=True))
    assert len(result.run.first()["confusion_matrix"]) == 2
    scored = result.model.score(shifted)
    assert scored.filter(F.col("predicted_label") != F.col("class").cast("string")).count() == 0


def test_advertised_classifiers(rows):
    for algorithm in ("naive_bayes", "linear_svc"):
        run = train(rows, spec(algorithm=algorithm, params={"maxIter": 20, "regParam": 0.01})).run.first()
        assert run["metrics"]["accuracy"] > 0.7 and "roc_auc" in run["metrics"], algorithm


def test_clusters(rows):
    run = train(rows, spec(model_type="clustering", algorithm="kmeans", features=["a.b"], target=None,
                           params={"k": 2, "maxIter": 20})).run.first()
    assert run["target"] is None and 0.5 < run["metrics"]["silhouette"] <= 1
    assert run["params"] == {"k": "2", "maxIter": "20", "seed": "42"}


def test_rows_kept_as_a_table(rows):
    cached, written = (train(rows, spec(keep=k)).run.first() for k in ("cache", "table"))
    assert written["metrics"] == cached["metrics"] and written["train_size"] == cached["train_size"]


def test_random_split(rows):
    run = train(rows, spec(split="random", test_size=0.3)).run.first()
    assert run["train_size"] + run["test_size"] == 600 and 100 < run["test_size"] < 260


def test_refused_before_any_job(rows):
    for changed, error in (
        ({"algorithm": "svm"}, ValueError), ({"model_type": "ranking"}, ValueError),
        ({"features": []}, ValueError), ({"target": ""}, ValueError), ({"test_size": 1}, ValueError),
        ({"features": ["nope"]}, KeyError), ({"features": ["day"]}, ValueError),
        ({"target": "day"}, ValueError), ({"features": ["answer"]}, ValueError),
        ({"model_type": "regression", "algorithm": "gbt_reg"}, ValueError), ({"split": "x"}, ValueError), ({"keep": "x"}, ValueError),
    ):
        with pytest.raises(error):
            validate(rows, spec(**changed))


def test_nothing_left(rows):
    with pytest.raises(ValueError):
        train(rows.withColumn("holes", F.lit(None).cast("double")), spec(features=["holes"]))


def test_parameters():
    forest = algorithms.find("classification", "random_forest")
    given = {"numTrees": "500", "maxDepth": 0, "subsamplingRate": 0.5, "minInstancesPerNode": "x",
             "k": 3, "regParam": 1, "seed": 7}
    with pytest.warns(UserWarning, match="minInstancesPerNode"):
        assert algorithms.typed_params(forest, given) == {
            "numTrees": 200, "maxDepth": 1, "subsamplingRate": 0.5, "seed": 7}
    linear = algorithms.find("regression", "linear_regression")
    assert algorithms.typed_params(linear, {"elasticNetParam": 3, "regParam": -1, "maxIter": 10**6}) == {
        "maxIter": 1000, "regParam": 0.0, "elasticNetParam": 1.0}


def test_catalog(spark):
    rows = algorithms.catalog_table(spark).collect()
    assert len(rows) == 8 and {r["model_type"] for r in rows} == {"classification", "regression"}


def test_hash_split_ignores_partitioning(rows):
    sides = [features.hash_split(rows.repartition(n), ["id"], 0.25)[1] for n in (1, 5)]
    first, second = ({r["id"] for r in side.select("id").collect()} for side in sides)
    assert first == second and 100 < len(first) < 200


def test_index_agrees_with_the_estimator(spark):
    values = ["b"] * 5 + ["a"] * 5 + ["c"] * 9 + [f"v{i}" for i in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    labels = StringIndexer(inputCol="v", outputCol="i").fit(df).labels
    table = indexing.index_values(df, "v").orderBy("index").collect()
    assert [r["value"] for r in table] == list(labels)
    assert [r["index"] for r in table] == list(range(len(labels)))


def test_apply_index_with_hot_rare_unknown_and_null(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 3 + [("c",)], "v string")
    values = indexing.index_values(df, "v")
    asked = df.unionAll(spark.createDataFrame([("new",), (None,)], "v string"))
    for share in (1, 2, 20, 50_000):
        found = indexing.apply_index(asked, "v", values, hot_share=share)
        pairs = {(r["v"], r["v_indexed"]) for r in found.collect()}
        assert pairs == {("a", 0.0), ("b", 1.0), ("c", 2.0), ("new", 3.0), (None, 3.0)}
        assert found.count() == 56


def test_long_values_are_matched_by_their_digest(spark):
    long = "a" * 300
    df = spark.createDataFrame([(long,)] * 9 + [(long + "b",)] * 2 + [("c",)], "v string")
    values = indexing.index_values(df, "v")
    for share in (2, 50_000):
        found = {(r["v"][-1], r["v_indexed"]) for r in indexing.apply_index(df, "v", values, hot_share=share).collect()}
        assert found == {("a", 0.0), ("b", 1.0), ("c", 2.0)}


def test_indexing_reads_its_rows_once(spark, tmp_path):
    rows = spark.range(90).selectExpr(*[f"cast(id % {k} as string) AS c{k}" for k in (2, 3, 7)])
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    indexed = table
    for name in table.columns:
        indexed = indexing.apply_index(indexed, name, indexing.index_values(table, name))
    plan = indexed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("c2#") and plan.count(str(tmp_path.name)) <= 1
    leaves = indexed._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n")
    assert sum("c2#" in leaf and "c7#" in leaf for leaf in leaves.split("\n")) == 1
    assert indexed.count() == 90


PAIRS = [(0.0, 0.0), (1.0, 1.0), (1.0, 2.0), (0.0, 1.0), (0.0, 0.0), (3.0, 1.0)]


def test_metrics_agree_with_the_evaluators(spark):
    df = spark.createDataFrame(PAIRS * 3 + [(1.0, 1.0)], "label double, prediction double")
    counts = evaluate.confusion_counts(df)
    found = evaluate.classification_metrics(counts).first()
    for name, metric in (("accuracy", "accuracy"), ("f1", "f1"), ("precision", "weightedPrecision"),
                         ("recall", "weightedRecall")):
        expected = MulticlassClassificationEvaluator(metricName=metric).evaluate(df)
        assert abs(found[name] - expected) < 1e-12, name
    numbers = evaluate.regression_metrics(df).first()
    for name in ("rmse", "mae", "r2"):
        assert abs(numbers[name] - RegressionEvaluator(metricName=name).evaluate(df)) < 1e-9, name


def test_confusion_matrix_of_all_classes_or_actual_ones(spark):
    counts = evaluate.confusion_counts(spark.createDataFrame(PAIRS, "label double, prediction double"))
    matrix = lambda **k: [r["counts"] for r in evaluate.confusion_matrix(counts, **k).orderBy("position").collect()]
    assert matrix() == [[2, 1, 0, 0], [0, 1, 1, 0], [0, 0, 0, 0], [0, 1, 0, 0]]
    assert matrix(actual_only=True) == [[2, 1, 0], [0, 1, 0], [0, 1, 0]]


def test_nothing_is_left_in_scratch(spark, tmp_path, monkeypatch):
    """What is written on the way to a number is deleted with it."""
    monkeypatch.setattr(scratch, "scratch_folder", lambda _: str(tmp_path))
    df = spark.range(50).select((F.col("id") % 2).alias("label"), (F.col("id") % 7).alias("score"))
    evaluate.roc_auc(df, "score").collect()
    paging.page(df, "score", 5, 20).collect()
    assert (tmp_path / "sparkprof").exists()
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_auc_agrees_with_the_evaluator(spark):
    df = spark.range(2_000).select(
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0).alias("label"),
        (F.hash("id") % 50 + F.when(F.col("id") % 3 == 0, 9).otherwise(0)).cast("double").alias("score"),
    )
    raw = F.udf(lambda s: Vectors.dense(-s, s), VectorUDT())
    expected = BinaryClassificationEvaluator(numBins=0).evaluate(df.withColumn("rawPrediction", raw("score")))
    assert abs(evaluate.roc_auc(df, "score").first()[0] - expected) < 1e-9
    assert evaluate.roc_auc(df.filter("label = 1"), "score").first()[0] is None


def test_constant_label_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    assert evaluate.regression_metrics(df).first()["r2"] is None


def test_label_of_text_is_refused(spark):
    df = spark.createDataFrame([("a",)], T.StructType().add("s", "string"))
    with pytest.raises(ValueError):
        features.with_label(df, "s")


@pytest.mark.parametrize("keep, target", [("cache", "answer"), ("table", "answer"), ("table", "flag")])
def test_tasks_of_a_fit_grow_with_the_rows(rows, monkeypatch, keep, target):
    """Every pass of the fit reads a bounded number of rows per task, however few files hold them."""
    found, fit = [], training.Pipeline.fit

    def counted(pipeline, df, *more):
        sizes = df.groupBy(F.spark_partition_id().alias("part")).count()
        found.append(sizes.agg(F.max("count")).first()[0])
        return fit(pipeline, df, *more)

    monkeypatch.setattr(training, "TASK_VALUES", 30 * (3 + 1 + 10), raising=False)
    monkeypatch.setattr(training.Pipeline, "fit", counted)
    train(rows.coalesce(1), spec(keep=keep, target=target, partitions=2))
    assert found and max(found) <= 30
