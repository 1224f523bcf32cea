import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from sparkprof.operators import boosting
from sparkprof.plans.training import TrainedModel, TrainSpec, train


@pytest.fixture(scope="module")
def rows(spark):
    """Numbers that hardly repeat, few values, and a feature that is constant."""
    found = spark.range(0, 4000, 1, 3).select(
        "id",
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100_003)) / 1000 - 20 * i).alias(f"x{i}") for i in range(3)],
        (F.col("id") % 5).cast("double").alias("few"),
        F.lit(7.0).alias("constant"),
    )
    found = found.withColumn("y", F.expr("x0 * x1 + 50 * few + sin(x2)"))
    # Of classes that the features do not tell apart wholly, no node is pure but for rounding.
    found = found.withColumn("c", F.expr("double(y + pmod(xxhash64(id, 9), 600) - 300 > 0)"))
    inputs = ["x0", "x1", "x2", "few", "constant"]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(found).persist()


def nodes(node):
    """(feature, threshold, prediction, impurity, gain, rows) of each node."""
    rest = (node.prediction(), node.impurity(), node.impurityStats().count())
    if node.subtreeDepth() == 0:
        return [(-1, 0.0, *rest, 0.0)]
    split = node.split()
    here = (split.featureIndex(), split.threshold(), *rest, node.gain())
    return [here, *nodes(node.leftChild()), *nodes(node.rightChild())]


def same_trees(found, wanted):
    assert found.getNumTrees == wanted.getNumTrees and found.treeWeights == wanted.treeWeights
    for one, other in zip(found._java_obj.trees(), wanted._java_obj.trees()):
        left, right = nodes(one.rootNode()), nodes(other.rootNode())
        assert len(left) == len(right)
        for a, b in zip(left, right):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-6, abs=1e-6)


ESTIMATORS = [
    GBTRegressor,
    lambda **given: GBTRegressor(**{"maxDepth": 7, "minInstancesPerNode": 9, **given}),
    GBTClassifier,
]


def estimator(kind, **given):
    made = kind(seed=42, **given)
    return made.setLabelCol("y" if isinstance(made, GBTRegressor) else "c")


@pytest.mark.parametrize("kind", ESTIMATORS)
def test_trees_are_those_of_spark(rows, kind):
    wanted = estimator(kind, maxIter=4).fit(rows)
    found = boosting.Boosting(estimator(kind, maxIter=4)).fit(rows)
    same_trees(found, wanted)
    assert type(found) is type(wanted) and found.numFeatures == wanted.numFeatures == 5
    assert found.getMaxIter() == 4 and found.getLabelCol() == wanted.getLabelCol()
    assert found.featureImportances.toArray() == pytest.approx(wanted.featureImportances.toArray())
    both = found.transform(rows).select("id", F.col("prediction").alias("p"))
    both = both.join(wanted.transform(rows).select("id", "prediction"), "id")
    assert both.filter(F.abs(F.col("p") - F.col("prediction")) > 1e-6).count() == 0


@pytest.mark.parametrize("kind", ESTIMATORS[1:])
def test_small_blocks_tasks_and_groups_give_the_same_trees(rows, monkeypatch, kind):
    wanted = boosting.Boosting(estimator(kind, maxIter=3, maxDepth=4)).fit(rows)
    for name, value in {
        "_BUFFER": 9_000, "_BLOCK": 4_000, "_TASK": 40_000, "_LEAST": 40_000, "_ALONE": 1,
        "_COLLECTED": 1, "_GROUP": 20_000, "_CHAIN": 2, "_TASK_ROWS": 300,
    }.items():
        monkeypatch.setattr(boosting, name, value)
    same_trees(boosting.Boosting(estimator(kind, maxIter=3, maxDepth=4)).fit(rows), wanted)


@pytest.mark.parametrize("kind, most", [(GBTRegressor, 12), (GBTClassifier, 24)])
def test_cells_are_bounded_by_the_bins(spark, kind, most):
    rows = spark.range(0, 20_000, 1, 4).select(
        F.expr("double(id % 3)").alias("a"), F.expr("double(id % 4)").alias("b"),
        F.expr("double(id)").alias("y"), F.expr("double(id % 7 > 2)").alias("c"),
    )
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    made = estimator(kind)
    cells = boosting._cells(rows, made, boosting._Candidates.of(made, rows))
    total = cells.agg(F.count(F.lit(1)), F.sum("n"), F.sum("s")).first()
    signs = 19_999 * 10_000.0 if kind is GBTRegressor else rows.agg(F.sum("c")).scalar()
    signs = signs if kind is GBTRegressor else 2 * rows.filter("c = 1").count() - 20_000
    assert tuple(total) == (most, 20_000, signs)


def test_draws_of_rows_are_left_to_spark(rows):
    made = GBTRegressor(labelCol="y", seed=42, maxIter=3, subsamplingRate=0.5)
    same_trees(boosting.Boosting(made).fit(rows), made.fit(rows))


@pytest.mark.parametrize("column", ["few", "y"])
def test_more_than_two_classes_are_refused_as_before(rows, column):
    said = []
    for fit in (GBTClassifier(labelCol=column).fit, boosting.Boosting(GBTClassifier(labelCol=column)).fit):
        with pytest.raises(Exception) as refusal:
            fit(rows)
        said.append(type(refusal.value))
    assert said[0] is said[1]


def test_one_value_of_features_or_target(rows):
    for made in (GBTRegressor(labelCol="constant", maxIter=2), GBTRegressor(labelCol="y", maxIter=2, featuresCol="one")):
        alone = VectorAssembler(inputCols=["constant"], outputCol="one").transform(rows)
        same_trees(boosting.Boosting(made).fit(alone), made.fit(alone))


def trained(rows, algorithm, tmp_path, **given):
    result = train(rows.drop("features"), TrainSpec(
        algorithm=algorithm, features=["x0", "x1", "few"], key=["id"], params={"maxIter": 5}, **given
    ))
    result.model.save(str(tmp_path / "model"))
    loaded = TrainedModel.load(rows.sparkSession, str(tmp_path / "model"))
    plain = rows.drop("features")
    both = result.model.score(plain).select("id", F.col("prediction").alias("p"))
    both = both.join(loaded.score(plain).select("id", "prediction"), "id")
    assert both.filter("p = prediction").count() == 4000
    assert sum(result.run.first()["feature_importance"].values()) == pytest.approx(1)
    return result


def test_training_a_regressor_does_not_pass_over_rows_for_every_tree(rows, monkeypatch, tmp_path):
    def refused(*_):
        raise AssertionError("trees are grown from single rows")

    monkeypatch.setattr(GBTRegressor, "_fit", refused)
    result = trained(rows, "gbt_reg", tmp_path, model_type="regression", target="y")
    assert isinstance(result.model.pipeline.stages[-1], GBTRegressionModel)
    assert result.run.first()["metrics"]["r2"] > 0.5


def test_training_a_classifier_does_not_pass_over_rows_for_every_tree(rows, monkeypatch, tmp_path):
    def refused(*_):
        raise AssertionError("trees are grown from single rows")

    monkeypatch.setattr(GBTClassifier, "_fit", refused)
    named = rows.withColumn("c", F.when(F.col("c") > 0, "dear").otherwise("cheap"))
    result = trained(named, "gbt", tmp_path, model_type="classification", target="c")
    assert isinstance(result.model.pipeline.stages[-1], GBTClassificationModel)
    assert result.run.first()["metrics"]["roc_auc"] > 0.7
