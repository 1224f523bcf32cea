"""Reports over training runs: every view is a table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprof.functions.rounding import rounded
from sparkprof.functions.text import UNKNOWN, or_default, short_id, title_case
from sparkprof.operators.evaluate import filled_cells, named_cells
from sparkprof.operators.paging import preview
from sparkprof.plans.registry import CONFUSION, get
from sparkprof.sources.sinks import write_views

# Fixed values.
DECIMALS = 4
SAMPLE_ROWS = 100
COMPARED_ID, DETAILED_ID = 8, 12
FORMATS = ("excel", "json")
TRUE_WORDS = ("true", "1", "yes")
KEY_METRICS = {
    "classification": {"accuracy": "Accuracy", "f1": "F1 Score"},
    "regression": {"rmse": "RMSE", "r2": "R²"},
    "clustering": {"silhouette": "Silhouette"},
}


def with_dataset(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Each run with the dataset it was trained on, NULL if that is gone.

    The engine broadcasts the datasets if their measured size allows it and
    otherwise joins by shuffle, splitting a dataset that holds many of the runs.
    """
    known = datasets.select(
        F.col("id").alias("dataset_id"), F.struct("id", "filename").alias("dataset")
    )
    return runs.join(known, "dataset_id", "left")


def model_reports(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """The full report of each run, one row per run."""
    return with_dataset(runs, datasets).select(
        "id",
        F.col("model_type").alias("type"),
        "algorithm",
        "created_at",
        "features",
        "target",
        F.col("params").alias("parameters"),
        "metrics",
        _dataset(),
        F.struct("train_size", "test_size").alias("data_split"),
    )


def model_entries(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """The short entry of each run in a report over all of them."""
    return with_dataset(runs, datasets).select(
        "id", F.col("model_type").alias("type"), "algorithm", "created_at", "metrics", _dataset()
    )


def _dataset() -> Column:
    return F.struct(
        F.col("dataset.id").alias("id"), F.col("dataset.filename").alias("filename")
    ).alias("dataset")


def overview(runs: DataFrame) -> DataFrame:
    """(section, label, n): all runs, runs by type and runs by algorithm.

    Runs are counted once per type and algorithm; all parts come from those counts.
    """
    by_both = (
        runs.select(
            F.coalesce("model_type", F.lit(UNKNOWN)).alias("model_type"),
            F.coalesce("algorithm", F.lit(UNKNOWN)).alias("algorithm"),
        )
        .groupBy("model_type", "algorithm")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    section = lambda name: F.lit(name).alias("section")
    total = by_both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        section("total"), F.lit("Total Models").alias("label"), "n"
    )
    by_type = by_both.groupBy("model_type").agg(F.sum("n").alias("n")).select(
        section("by_type"), title_case(F.col("model_type")).alias("label"), "n"
    )
    by_algorithm = by_both.groupBy("algorithm").agg(F.sum("n").alias("n")).select(
        section("by_algorithm"), F.col("algorithm").alias("label"), "n"
    )
    return total.unionAll(by_type).unionAll(by_algorithm)


def summary(runs: DataFrame) -> DataFrame:
    """(id, position, label, value): nine facts of each run, then its features."""
    facts = {
        "Model ID": F.col("id"),
        "Model Type": F.upper("model_type"),
        "Algorithm": F.col("algorithm"),
        "Created At": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"),
        "Dataset ID": F.col("dataset_id"),
        "Target Variable": or_default(F.col("target")),
        "Number of Features": F.size("features").cast("string"),
        "Train Size": F.col("train_size").cast("string"),
        "Test Size": F.col("test_size").cast("string"),
    }
    rows = F.array(
        *[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in facts.items()]
    )
    names = F.transform(
        "features", lambda f: F.struct(F.lit("Feature").alias("label"), f.alias("value"))
    )
    return runs.select("id", F.posexplode(F.concat(rows, names)).alias("position", "fact")).select(
        "id", "position", "fact.label", "fact.value"
    )


def metrics(runs: DataFrame) -> DataFrame:
    """(id, metric, value): the scalar metrics of each run."""
    exploded = runs.select("id", F.explode("metrics").alias("name", "raw"))
    return exploded.select(
        "id", title_case(F.col("name")).alias("metric"), rounded(F.col("raw"), DECIMALS).alias("value")
    )


def parameters(runs: DataFrame) -> DataFrame:
    """(id, parameter, value)."""
    return runs.select("id", F.explode("params").alias("parameter", "value"))


def confusion_matrices(runs: DataFrame) -> DataFrame:
    """(id, actual, predicted, n): one row per cell of each classification run's matrix."""
    rows = runs.filter(F.col("model_type") == "classification").select(
        "id", F.posexplode("confusion_matrix").alias("i", "cells")
    )
    return rows.select("id", "i", F.posexplode("cells").alias("j", "n")).select(
        "id",
        F.concat(F.lit("Actual "), F.col("i")).alias("actual"),
        F.concat(F.lit("Predicted "), F.col("j")).alias("predicted"),
        "n",
    )


def stored_confusion(runs: DataFrame, model_id: str, filled: bool = False) -> DataFrame:
    """(id, actual, predicted, n) of a run of any number of classes, from the cells kept beside its model.

    Only pairs that occur; with ``filled`` every cell of the classes up to the last that occurs.
    """
    path = get(runs, model_id).first()["model_path"]
    cells = runs.sparkSession.read.parquet(f"{path}/{CONFUSION}")
    if filled:
        last = cells.agg(F.max(F.greatest("position", "place"))).first()[0]
        cells = filled_cells(cells, 0 if last is None else last + 1)
    return named_cells(cells).select(F.lit(model_id).alias("id"), "*")


def sample_data(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    return preview(df, SAMPLE_ROWS, order)


def metrics_comparison(runs: DataFrame) -> DataFrame:
    """One row per run with the key metrics of its type.

    A key metric the run lacks reads as not available, one of another type is NULL.
    """
    cells = []
    for model_type, names in KEY_METRICS.items():
        for name, title in names.items():
            value = or_default(rounded(F.try_element_at("metrics", F.lit(name)), DECIMALS))
            cells.append(F.when(F.col("model_type") == model_type, value).alias(title))
    return runs.select(
        short_id(F.col("id"), COMPARED_ID).alias("Model ID"),
        F.col("model_type").alias("Type"),
        F.col("algorithm").alias("Algorithm"),
        F.date_format("created_at", "yyyy-MM-dd").alias("Created"),
        *cells,
    )


def metric_names(runs: DataFrame) -> list[str]:
    """All metric names of the runs, sorted; each becomes a column, found by a map-side distinct."""
    names = runs.select(F.explode(F.map_keys("metrics")).alias("name")).distinct()
    return sorted(r["name"] for r in names.collect())


def _titles(names: list[str]) -> list[str]:
    """Names as titles; those that would share a title stay as they are."""
    titles = [name.replace("_", " ").title() for name in names]
    return [n if titles.count(t) > 1 else t for n, t in zip(names, titles)]


def type_comparison(
    runs: DataFrame, model_type: str, names: list[str] | None = None
) -> DataFrame:
    """The runs of one type with every scalar metric any of them has.

    Metrics are looked up in each run's own map, so nothing is shuffled.
    """
    of_type = runs.filter(F.col("model_type") == model_type)
    names = metric_names(of_type) if names is None else sorted(names)
    return of_type.select(
        short_id(F.col("id"), DETAILED_ID).alias("Model ID"),
        F.col("algorithm").alias("Algorithm"),
        *[
            or_default(rounded(F.try_element_at("metrics", F.lit(n)), DECIMALS)).alias(t)
            for n, t in zip(names, _titles(names))
        ],
    )


def dashboard_totals(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """(datasets, files, models), one row."""
    files = F.count("path").alias("files")
    counts = datasets.agg(F.count(F.lit(1)).alias("datasets"), files)
    return counts.withColumn("models", runs.agg(F.count(F.lit(1))).scalar())


def most_recent(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The latest entries of a registry, newest first."""
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)


def report_options(format: str = "excel", include_data=False) -> tuple[str, bool]:
    """The checked format and whether data is to be included."""
    chosen = format.lower()
    if chosen not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    if isinstance(include_data, str):
        include_data = include_data.lower() in TRUE_WORDS
    return chosen, bool(include_data)


def single_model_views(
    runs: DataFrame, model_id: str, dataset: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The sheets of one run's report; ``dataset`` adds a sample of its rows."""
    run = get(runs, model_id)
    views = {"summary": summary(run), "metrics": metrics(run), "parameters": parameters(run)}
    known = run.first().asDict()
    if known["model_type"] == "classification":
        # Of very many classes only the pairs that occur are kept.
        large = known["confusion_matrix"] is None and known.get("model_path") is not None
        views["confusion_matrix"] = stored_confusion(runs, model_id) if large else confusion_matrices(run)
    if dataset is not None:
        views["sample_data"] = sample_data(dataset)
    return views


def comparison_views(runs: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a report over all runs; without runs there is no report."""
    if runs.isEmpty():
        raise LookupError("there are no runs to report on")
    views = {"overview": overview(runs), "metrics_comparison": metrics_comparison(runs)}
    known = runs.filter(F.col("model_type").isin(*KEY_METRICS)).select("model_type").distinct()
    present = {r["model_type"] for r in known.collect()}
    for model_type in KEY_METRICS:
        if model_type in present:
            views[f"{model_type}_models"] = type_comparison(runs, model_type)
    return views


def write_report(
    runs: DataFrame,
    datasets: DataFrame,
    path: str,
    model_id: str | None = None,
    format: str = "excel",
    include_data=False,
    dataset: DataFrame | None = None,
    generated_at: datetime | None = None,
) -> dict[str, str]:
    """Writes a report below ``path`` and returns the folder of each part.

    ``excel`` writes the sheets, one folder of CSV files each; ``json`` writes
    one object per run and, over all runs, the overview.
    """
    chosen, with_data = report_options(format, include_data)
    if chosen == "excel":
        if model_id is None:
            views = comparison_views(runs)
        else:
            views = single_model_views(runs, model_id, dataset if with_data else None)
        return write_views(views, path, "csv")
    if model_id is None:
        views = {"summary": overview(runs), "models": model_entries(runs, datasets)}
    else:
        views = {"model": model_reports(get(runs, model_id), datasets)}
    stamp = F.lit(generated_at or datetime.now()).cast("timestamp_ntz").alias("generated_at")
    kind = F.lit("all_models" if model_id is None else "single_model").alias("report_type")
    stamped = {name: view.select(kind, stamp, "*") for name, view in views.items()}
    return write_views(stamped, path, "json")
