"""Training, scoring and evaluating a model on a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (
    SQLTransformer,
    StandardScaler,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprof.columns import logical_type, qcol, quoted, require_columns, split_by_kind
from sparkprof.operators import evaluate as E
from sparkprof.operators.boosting import by_cells
from sparkprof.operators.features import (
    SEED,
    check_share,
    complete,
    in_train,
    random_split,
    with_label,
)
from sparkprof.operators.indexing import apply_index, index_values
from sparkprof.plans.algorithms import Algorithm, find, typed_params
from sparkprof.plans.registry import CONFUSION, RUN_SCHEMA, append, changes, get
from sparkprof.scratch import use_checkpoints, write_once

# Columns the pipeline adds, so no feature may have these names.
# Up to so many classes the record of a run holds the whole confusion matrix; of more, its cells that are
# not zero are a table beside the model.
MATRIX_CLASSES = 1_000
# Values of prepared rows that a task of a pass reads at most, about; what an estimator keeps
# beside a row's values counts as so many more.
TASK_VALUES, ROW_VALUES = 8_000_000, 10
RESERVED = ("label", "prediction", "rawPrediction", "probability")
RAW, SCALED = "_assembled", "_features"


@dataclass(frozen=True)
class TrainSpec:
    model_type: str
    algorithm: str
    features: list[str]
    target: str | None = None  # clustering has none
    params: dict = field(default_factory=dict)
    test_size: float = 0.2
    key: list[str] | None = None  # what identifies a row; features and target if not given
    split: str = "hash"  # or "random"
    seed: int = SEED
    name: str | None = None
    dataset_id: str | None = None
    # Index a numeric target like a text one, for classes that are not 0, 1, 2, ...
    index_labels: bool = False
    # Tasks to spread the prepared rows over at least, for tables that lie in few files.
    partitions: int | None = None
    # How the prepared rows are kept for the passes of the fit: in the executors'
    # memory and disks, or as a table in the shared scratch folder, which lost
    # executors cannot take away.
    keep: str = "cache"  # or "table"


@dataclass
class TrainedModel:
    """A fitted pipeline with what is needed to apply it to any table."""

    pipeline: PipelineModel
    features: list[str]
    labels: DataFrame | None = None  # value and index of each class of a text target
    indexes: dict[str, DataFrame] = field(default_factory=dict)

    def score(self, df: DataFrame, keep_vectors: bool = False) -> DataFrame:
        """The table with its predictions; rows with missing features are left out.

        For a string target ``predicted_label`` holds the class name.
        """
        scored = self.pipeline.transform(indexed(df, self.features, self.indexes))
        internal = [c for c in scored.columns if c == RAW or c.startswith(("_feature_", "_text_"))]
        if not keep_vectors:
            internal.append(SCALED)
        scored = scored.drop(*internal)
        if self.labels is None:
            return scored
        names = self.labels.select(
            F.col("index").cast("double").alias("prediction"), F.col("value").alias("predicted_label")
        )
        # No hint: Spark broadcasts the names by their measured size.
        return scored.join(names, "prediction", "left")

    def importances(self) -> DataFrame:
        """(feature, importance) of a tree model, most important first."""
        spark = SparkSession.getActiveSession()
        table = spark.createDataFrame(self.weights(), "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature")

    def weights(self) -> list[tuple[str, float]]:
        """(source name, importance) of each feature; empty unless the model has trees."""
        fitted = self.pipeline.stages[-1]
        if not hasattr(fitted, "featureImportances"):
            return []
        # The assembler's inputs are our names, which end in the feature's place.
        assembler = next(s for s in self.pipeline.stages if isinstance(s, VectorAssembler))
        places = [int(c.split("_")[2]) for c in assembler.getInputCols()]
        found = fitted.featureImportances.toArray().tolist()
        return [(self.features[place], weight) for place, weight in zip(places, found)]

    def save(self, path: str) -> None:
        self.pipeline.write().save(f"{path}/pipeline")
        if self.labels is not None:
            self.labels.write.parquet(f"{path}/labels")
        spark = SparkSession.getActiveSession()
        names = [(n, i) for i, n in enumerate(self.indexes)]
        parts = spark.createDataFrame(
            [(self.features, [n for n, _ in names], self.labels is not None)],
            "features array<string>, indexed array<string>, has_labels boolean",
        )
        parts.write.json(f"{path}/parts")
        for name, i in names:
            self.indexes[name].write.parquet(f"{path}/index_{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainedModel:
        schema = "features array<string>, indexed array<string>, has_labels boolean"
        parts = spark.read.schema(schema).json(f"{path}/parts").first()
        return cls(
            PipelineModel.load(f"{path}/pipeline"),
            list(parts["features"]),
            spark.read.parquet(f"{path}/labels") if parts["has_labels"] else None,
            {n: spark.read.parquet(f"{path}/index_{i}") for i, n in enumerate(parts["indexed"])},
        )


@dataclass
class TrainResult:
    model: TrainedModel
    run: DataFrame  # one row of the run registry
    predictions: DataFrame  # prediction with label and, for two classes, score
    dropped: int = 0  # rows left out for a missing feature or target
    confusion: DataFrame | None = None  # cells of the confusion matrix that are not zero: position, place, n


def validate(df: DataFrame, spec: TrainSpec) -> Algorithm:
    """Everything that can be refused before a job runs."""
    algorithm = find(spec.model_type, spec.algorithm)
    if not spec.features:
        raise ValueError("at least one feature is needed")
    if not spec.target and spec.model_type != "clustering":
        raise ValueError("a target column is needed")
    check_share(spec.test_size)
    if spec.split not in ("hash", "random"):
        raise ValueError("split must be hash or random")
    if spec.keep not in ("cache", "table"):
        raise ValueError("keep must be cache or table")
    require_columns(df, [*_used(spec), *(spec.key or [])])
    for name in spec.features:
        kind = logical_type(df.schema[name].dataType)
        if kind not in ("integer", "numeric", "boolean", "string"):
            raise ValueError(f"feature {name!r} of type {kind} cannot be used")
        if name in RESERVED:
            raise ValueError(f"a feature may not be named {name}")
    if spec.model_type != "clustering":
        _check_target(df, spec)
    return algorithm


def _check_target(df: DataFrame, spec: TrainSpec) -> None:
    if spec.target in spec.features:
        raise ValueError("the target cannot be a feature")
    kind = logical_type(df.schema[spec.target].dataType)
    if kind == "string" and spec.model_type == "regression":
        raise ValueError(f"target {spec.target!r} must be numeric for regression")
    if kind not in ("integer", "numeric", "boolean", "string"):
        raise ValueError(f"target {spec.target!r} of type {kind} cannot be used")


def _used(spec: TrainSpec) -> list[str]:
    """The features and, unless rows are clustered, the target."""
    return [*spec.features, *([spec.target] if spec.model_type != "clustering" else [])]


def train(df: DataFrame, spec: TrainSpec) -> TrainResult:
    """Prepares, splits, fits and evaluates; returns the model and its run record.

    Only the needed columns are kept, once for all passes of the fit, and spread over as
    many tasks as their number of values asks for.
    The default split is by a hash of the row's key, so that a partition
    recomputed after a lost executor holds the same training rows.
    """
    algorithm = validate(df, spec)
    use_checkpoints(df.sparkSession)
    used = _used(spec)
    if spec.split == "hash":
        chosen = in_train(spec.key or used, spec.test_size, spec.seed)
        rows = df.select(
            *[qcol(n) for n in used],
            complete(df, used).alias("_complete"),
            chosen.alias("_train"),
        )
    else:
        flagged = df.select(*[qcol(n) for n in used], complete(df, used).alias("_complete"))
        sides = random_split(flagged, spec.test_size, spec.seed)
        rows = reduce(
            DataFrame.unionAll,
            [side.withColumn("_train", F.lit(first)) for side, first in zip(sides, (True, False))],
        )
    parts = _tasks(df, spec)
    # Where the rows of a table in the scratch folder are read, files are put together by size.
    prepared = write_once(rows, "prepared") if spec.keep == "table" else rows
    prepared = (prepared.repartition(parts) if parts else prepared).persist()
    try:
        return _train_on(prepared, spec, algorithm, parts)
    finally:
        prepared.unpersist()


def _tasks(df: DataFrame, spec: TrainSpec) -> int | None:
    """The partitions of the prepared rows; None if they may stay as they are."""
    values = df.count() * (len(_used(spec)) + ROW_VALUES)
    wanted = -(-values // TASK_VALUES)
    least = spec.partitions or (df.sparkSession.sparkContext.defaultParallelism if wanted > 1 else None)
    return least and max(least, wanted)


def _train_on(rows: DataFrame, spec: TrainSpec, algorithm: Algorithm, parts: int | None) -> TrainResult:
    _, categorical = split_by_kind(rows, spec.features)
    kept, first = F.col("_complete"), F.col("_train")
    sizes = rows.agg(
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("dropped"),
        F.count_if(kept & first).alias("train"),
        F.count_if(kept & ~first).alias("test"),
    ).first()
    if sizes["kept"] == 0:
        raise ValueError("no rows are left without missing values")
    if sizes["train"] == 0 or sizes["test"] == 0:
        raise ValueError(f"the split leaves {sizes['train']} and {sizes['test']} rows")
    train_rows, test_rows = rows.filter(kept & first), rows.filter(kept & ~first)

    # Values are numbered and matched across the cluster, however many there are.
    indexes = {n: index_values(train_rows, n) for n in categorical}
    train_rows = indexed(train_rows, spec.features, indexes)
    labels, labeled = _labeler(train_rows, spec)
    train_rows = labeled(train_rows)
    kept_rows = None
    if indexes or labels is not None:  # every stage of the fit reads these rows
        if spec.keep == "table":
            train_rows = write_once(train_rows, "indexed")
            train_rows = train_rows.repartition(parts) if parts else train_rows
        kept_rows = train_rows.persist()
        train_rows = kept_rows if labels is None else _named(kept_rows, labels)

    params = typed_params(algorithm, spec.params)
    if algorithm.estimator().hasParam("seed"):
        params.setdefault("seed", spec.seed)
    if spec.model_type != "clustering":
        params["labelCol"] = "label"
    estimator = algorithm.estimator(featuresCol=SCALED, **params)
    params.pop("labelCol", None)
    stages = feature_stages(rows, spec.features)
    try:
        pipeline = Pipeline(stages=[*stages, by_cells(estimator)]).fit(train_rows)
    finally:
        if kept_rows is not None:
            kept_rows.unpersist()
    model = TrainedModel(pipeline, list(spec.features), labels, indexes)

    # The label is made first: a scored row need not have a target.
    scored = model.score(labeled(test_rows), keep_vectors=spec.model_type == "clustering")
    predictions = _scores(scored).persist()
    try:
        metrics, counts, cells = _metrics(spec.model_type, predictions)
        run = _run_row(rows.sparkSession, spec, model, params, metrics, counts, sizes)
    finally:
        predictions.unpersist()
    return TrainResult(model, run, predictions.drop(SCALED), sizes["dropped"], cells)


def _by_name(rows: DataFrame, spec: TrainSpec) -> bool:
    """True if the target is text, or to be treated like text."""
    if spec.model_type != "classification":
        return False
    return spec.index_labels or logical_type(rows.schema[spec.target].dataType) == "string"


def _labeler(
    train_rows: DataFrame, spec: TrainSpec
) -> tuple[DataFrame | None, Callable[[DataFrame], DataFrame]]:
    """The class names with their numbers, if any, and what adds the label to rows.

    Rows whose class was not trained on are left out, which keeps two classes two.
    """
    if spec.model_type == "clustering":
        return None, lambda side: side
    if not _by_name(train_rows, spec):
        return None, lambda side: with_label(side, spec.target)
    named = lambda side: side.withColumn("_target", qcol(spec.target).cast("string"))
    labels = index_values(named(train_rows), "_target")
    size = labels.agg(F.count(F.lit(1))).scalar()

    def labeled(side: DataFrame) -> DataFrame:
        marked = apply_index(named(side), "_target", labels, output="label")
        return marked.filter(F.col("label") < size).drop("_target")

    return labels, labeled


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Says how many classes the label has, so that estimators need not guess."""
    about = {"ml_attr": {"type": "nominal", "num_vals": labels.count()}}
    return rows.withMetadata("label", about)


def indexed(df: DataFrame, features: list[str], indexes: dict[str, DataFrame]) -> DataFrame:
    """Adds the index of each text feature under a name of our own."""
    for name, values in indexes.items():
        df = apply_index(df, name, values, output=f"_text_{features.index(name)}")
    return df


def feature_stages(df: DataFrame, features: list[str]) -> list:
    """Assemble (numbers first, then the indexes of texts), scale to unit deviation.

    ``df`` tells the kinds of the features; the rows that are transformed hold the indexes
    of texts (``indexed``) beside them.  Features get names of our own, so that any
    column name can be used.
    """
    numeric, categorical = split_by_kind(df, features)
    place = {name: i for i, name in enumerate(features)}
    ordered = [*numeric, *categorical]
    source = {n: f"_text_{place[n]}" if n in categorical else quoted(n) for n in ordered}
    taken = [f"CAST({source[n]} AS DOUBLE) AS _feature_{place[n]}" for n in ordered]
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(taken)} FROM __THIS__"),
        VectorAssembler(
            inputCols=[f"_feature_{place[n]}" for n in ordered], outputCol=RAW, handleInvalid="skip"
        ),
        StandardScaler(inputCol=RAW, outputCol=SCALED, withStd=True, withMean=False),
    ]


def _scores(scored: DataFrame) -> DataFrame:
    columns = [F.col(c) for c in ("label", "prediction", SCALED) if c in scored.columns]
    if "rawPrediction" in scored.columns:
        raw = vector_to_array("rawPrediction")
        columns.append(F.when(F.size(raw) == 2, F.get(raw, F.lit(1))).alias("score"))
    return scored.select(columns)


def _metrics(model_type: str, predictions: DataFrame) -> tuple[dict, DataFrame | None, DataFrame | None]:
    """The metrics and, for classes, the counts of pairs, if they are few classes, and the cells of the matrix."""
    if model_type == "regression":
        found = E.regression_metrics(predictions).first().asDict()
        return {k: v for k, v in found.items() if v is not None}, None, None
    if model_type == "clustering":
        clusters = predictions.agg(F.count_distinct("prediction")).first()[0]
        if clusters < 2:
            return {}, None, None
        return {"silhouette": ClusteringEvaluator(featuresCol=SCALED).evaluate(predictions)}, None, None
    # As many rows as there are pairs of classes that occur.
    counts = write_once(E.confusion_counts(predictions), "confusion")
    found = E.classification_metrics(counts).first().asDict()
    # One score is one row of two numbers: the model has two classes.
    if "score" in predictions.columns:
        area = E.roc_auc(predictions.filter("score IS NOT NULL"), "score").first()["roc_auc"]
        found["roc_auc"] = area
    classes, cells = E.confusion_sparse(counts)
    few = classes.count() <= MATRIX_CLASSES
    return {k: v for k, v in found.items() if v is not None}, counts if few else None, write_once(cells, "cells")


def register_run(result: TrainResult, folder: str, registry_path: str) -> str:
    """Saves the model and its confusion cells below ``folder``, appends the run and returns its id."""
    identifier = result.run.first()["id"]
    path = f"{folder.rstrip('/')}/{identifier}"
    result.model.save(path)
    if result.confusion is not None:
        result.confusion.write.parquet(f"{path}/{CONFUSION}")
    append(changes(result.run.withColumn("model_path", F.lit(path))), registry_path)
    return identifier


def load_registered(current_runs: DataFrame, identifier: str) -> TrainedModel:
    """The model of a registered run."""
    path = get(current_runs, identifier).first()["model_path"]
    return TrainedModel.load(current_runs.sparkSession, path)


def _run_row(spark, spec: TrainSpec, model, params, metrics, counts, sizes) -> DataFrame:
    importance = dict(model.weights())
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    row = {
        "id": str(uuid.uuid4()),
        "name": spec.name,
        "model_type": spec.model_type,
        "algorithm": spec.algorithm,
        "features": list(spec.features),
        "target": spec.target,
        "params": {k: str(v) for k, v in params.items()},
        "metrics": {k: float(v) for k, v in metrics.items()},
        "confusion_matrix": None,
        "feature_importance": importance or None,
        "dataset_id": spec.dataset_id,
        "train_size": sizes["train"],
        "test_size": sizes["test"],
        "created_at": now,
        "model_path": None,
    }
    run = spark.createDataFrame([row], RUN_SCHEMA)
    if counts is None:
        return run
    # Of few classes, the whole matrix is a field of the row.
    placed = F.sort_array(F.collect_list(F.struct("position", "counts")))
    whole = E.confusion_matrix(counts).agg(F.transform(placed, lambda r: r["counts"]).alias("m")).scalar()
    return run.withColumn("confusion_matrix", whole)
