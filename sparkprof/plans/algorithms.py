"""The algorithms that can be trained and the parameters they take."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Algorithm:
    model_type: str
    key: str
    name: str
    estimator: type
    params: tuple[str, ...]
    trees: bool = False


# Types, keys, names and parameters of the catalog.
_LINEAR = ("maxIter", "regParam", "elasticNetParam")
_TREE = ("maxDepth", "minInstancesPerNode", "impurity")
_FOREST = ("numTrees", "maxDepth", "minInstancesPerNode", "subsamplingRate")
_BOOSTED = ("maxIter", "maxDepth", "stepSize")
CATALOG = (
    Algorithm("classification", "logistic_regression", "Logistic Regression",
              C.LogisticRegression, _LINEAR),
    Algorithm("classification", "decision_tree", "Decision Tree",
              C.DecisionTreeClassifier, _TREE, trees=True),
    Algorithm("classification", "random_forest", "Random Forest",
              C.RandomForestClassifier, _FOREST, trees=True),
    Algorithm("classification", "gbt", "Gradient Boosted Trees",
              C.GBTClassifier, _BOOSTED, trees=True),
    Algorithm("regression", "linear_regression", "Linear Regression",
              R.LinearRegression, _LINEAR),
    Algorithm("regression", "decision_tree_reg", "Decision Tree Regressor",
              R.DecisionTreeRegressor, _TREE, trees=True),
    Algorithm("regression", "random_forest_reg", "Random Forest Regressor",
              R.RandomForestRegressor, _FOREST, trees=True),
    Algorithm("regression", "gbt_reg", "Gradient Boosted Trees Regressor",
              R.GBTRegressor, _BOOSTED, trees=True),
)

# Accepted beside the catalog.  Naive Bayes needs features that are not negative,
# the support vector machine two classes; clustering takes no target.
ADVERTISED = (
    Algorithm("classification", "naive_bayes", "Naive Bayes", C.NaiveBayes, ()),
    Algorithm("classification", "linear_svc", "Linear SVC", C.LinearSVC, ("maxIter", "regParam")),
    Algorithm("clustering", "kmeans", "K-Means", K.KMeans, ("k", "maxIter")),
)

# Parameter types and the limits a value is moved into.
PARAM_TYPES = {
    "maxIter": int,
    "regParam": float,
    "elasticNetParam": float,
    "maxDepth": int,
    "minInstancesPerNode": int,
    "impurity": str,
    "numTrees": int,
    "subsamplingRate": float,
    "stepSize": float,
    "k": int,
    "seed": int,
}
PARAM_LIMITS = {
    "maxIter": (1, 1000),
    "regParam": (0.0, float("inf")),
    "maxDepth": (1, 30),
    "numTrees": (1, 200),
    "elasticNetParam": (0.0, 1.0),
}


def find(model_type: str, key: str) -> Algorithm:
    known = CATALOG + ADVERTISED
    types = sorted({a.model_type for a in known})
    if model_type not in types:
        raise ValueError(f"model_type must be one of {', '.join(types)}")
    of_type = {a.key: a for a in known if a.model_type == model_type}
    if key not in of_type:
        raise ValueError(f"algorithm for {model_type} must be one of {', '.join(of_type)}")
    return of_type[key]


def typed_params(algorithm: Algorithm, given: dict) -> dict:
    """The parameters the estimator accepts, converted and moved into their limits.

    Unknown names and values that do not convert are left out; the latter with a warning.
    """
    accepted = {p.name for p in algorithm.estimator().params}
    result = {}
    for name, convert in PARAM_TYPES.items():
        if name not in given or name not in accepted:
            continue
        try:
            value = convert(given[name])
        except (TypeError, ValueError):
            warnings.warn(f"{name}={given[name]!r} is not a {convert.__name__} and is left out", stacklevel=2)
            continue
        low, high = PARAM_LIMITS.get(name, (value, value))
        result[name] = max(low, min(value, high))
    return result


def catalog_table(spark: SparkSession) -> DataFrame:
    """(model_type, algorithm, name, params)."""
    rows = [(a.model_type, a.key, a.name, list(a.params)) for a in CATALOG]
    return spark.createDataFrame(
        rows, "model_type string, algorithm string, name string, params array<string>"
    )


def catalog_use(runs: DataFrame) -> DataFrame:
    """The catalog with the number of runs of each algorithm, unused ones included."""
    catalog = catalog_table(runs.sparkSession)
    # Counts per algorithm: as many rows as there are algorithm names.
    used = runs.groupBy("model_type", "algorithm").count().withColumnRenamed("count", "runs")
    return catalog.join(used, ["model_type", "algorithm"], "left").fillna(0, ["runs"])
