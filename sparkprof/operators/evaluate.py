"""Evaluation of predictions: tables with a label and a prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprof.columns import qcol, require_columns
from sparkprof.operators.ordering import numbered, running_totals
from sparkprof.scratch import temporary

SAMPLE_ROWS = 100


def confusion_counts(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """(label, prediction, n) for the pairs that occur."""
    require_columns(predictions, [label, prediction])
    return (
        predictions.select(
            qcol(label).cast("double").alias("label"),
            qcol(prediction).cast("double").alias("prediction"),
        )
        .groupBy("label", "prediction")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_sparse(counts: DataFrame, actual_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The classes (position, label) in ascending order, and the cells (position, place, n) that are not zero.

    Classes are all labels seen on either side, or with ``actual_only`` just the actual
    ones, which leaves out predictions of any other class.  They are numbered across the
    cluster and written once, however many there are.
    """
    seen = F.array("label") if actual_only else F.array("label", "prediction")
    classes = counts.select(F.explode(seen).alias("label")).filter("label IS NOT NULL").distinct()
    classes = numbered(classes, [F.asc("label")]).select("position", "label")
    places = classes.select(F.col("label").alias("prediction"), F.col("position").alias("place"))
    cells = counts.join(classes, "label").join(places, "prediction").select("position", "place", "n")
    return classes, cells


def confusion_matrix(counts: DataFrame, actual_only: bool = False) -> DataFrame:
    """One row per class: (position, label, counts), both in ascending class order.

    ``counts`` holds one number per class, zero where a pair does not occur; for very many
    classes ``confusion_sparse`` has the other pairs alone.
    """
    classes, cells = confusion_sparse(counts, actual_only)
    size = classes.count()
    # The cells of a row that are not zero, in the order of their places.
    rows = cells.groupBy("position").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("cells"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("bigint"), n.cast("int"))
    ends = F.concat(F.array(F.lit(-1).cast("bigint")), F.transform("cells", lambda c: c["place"]))
    filled = F.flatten(F.zip_with(
        "cells", F.slice(ends, 1, F.size("cells")),
        lambda c, end: F.concat(zeros(c["place"] - end - 1), F.array(c["n"])),
    ))
    return (
        classes.join(rows, "position", "left")
        .withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<place:bigint,n:bigint>>")))
        .select(
            "position", "label",
            F.concat(filled, zeros(F.lit(size) - 1 - F.element_at(ends, -1))).alias("counts"),
        )
    )


def filled_cells(cells: DataFrame, classes: int) -> DataFrame:
    """Every cell (position, place, n) of a matrix of so many classes; zeros are made range by range."""
    every = cells.sparkSession.range(classes * classes).select(
        F.expr(f"id DIV {max(classes, 1)}").alias("position"), (F.col("id") % max(classes, 1)).alias("place")
    )
    return every.join(cells, ["position", "place"], "left").select(
        "position", "place", F.coalesce("n", F.lit(0)).alias("n")
    )


def named_cells(cells: DataFrame) -> DataFrame:
    """(actual, predicted, n) with display names of the classes' places."""
    return cells.select(
        F.concat(F.lit("Actual "), F.col("position")).alias("actual"),
        F.concat(F.lit("Predicted "), F.col("place")).alias("predicted"),
        "n",
    )


def confusion_cells(matrix: DataFrame) -> DataFrame:
    """The matrix as (actual, predicted, n) with display names of the classes' places."""
    return named_cells(matrix.select("position", F.posexplode("counts").alias("place", "n")))


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy and the precision, recall and F1 weighted by class frequency, one row."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("hits"), F.col("n").alias("actual"),
                 F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("hits"),
                 F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted")),
    )
    classes = (
        counts.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("hits", "actual", "predicted")])
    )
    hits, actual, predicted = F.col("hits"), F.col("actual"), F.col("predicted")
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    precision, recall = ratio(hits, predicted), ratio(hits, actual)
    weighted = lambda score: F.sum(actual * score) / F.sum(actual)
    return classes.agg(
        (F.sum(hits) / F.sum(actual)).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(ratio(2 * hits, actual + predicted)).alias("f1"),
    )


def roc_auc(predictions: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Exact area under the ROC curve of a 0/1 label, as one row.

    Rows are first counted per score; the running count of negatives over the
    ordered scores is distributed, so distinct scores may be as many as rows.
    One class missing gives NULL.  The number is found at once, and the table of
    ordered scores is deleted then.
    """
    require_columns(predictions, [score, label])
    positive = qcol(label) > 0.5
    by_score = (
        predictions.select(qcol(score).cast("double").alias("score"), positive.alias("positive"))
        .groupBy("score")
        .agg(
            F.count_if("positive").alias("positives"),
            F.count_if(~F.col("positive")).alias("negatives"),
        )
    )
    spark = predictions.sparkSession
    wins = F.col("positives") * (F.col("negatives_below") + F.col("negatives") / 2.0)
    pairs = F.sum("positives").cast("double") * F.sum("negatives").cast("double")
    with temporary(spark):
        ordered = running_totals(by_score, [F.col("score")], {"negatives_below": "negatives"})
        area = ordered.agg((F.sum(wins) / F.nullif(pairs, F.lit(0.0))).alias("roc_auc")).first()
    return spark.createDataFrame([(area["roc_auc"],)], "roc_auc double")


def regression_metrics(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Root mean squared error, mean absolute error and R², one row from one scan."""
    require_columns(predictions, [label, prediction])
    pairs = predictions.select(
        qcol(label).cast("double").alias("l"), qcol(prediction).cast("double").alias("p")
    )
    error = F.col("l") - F.col("p")
    squares = F.sum(error * error)
    spread = F.var_pop("l") * F.count("l")
    return pairs.agg(
        F.sqrt(squares / F.nullif(F.count("l"), F.lit(0))).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1.0 - squares / F.nullif(spread, F.lit(0.0))).alias("r2"),
    )


def predicted_vs_actual(
    predictions: DataFrame,
    key: list[str],
    rows: int = SAMPLE_ROWS,
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """The first (actual, predicted) pairs in key order."""
    require_columns(predictions, [*key, label, prediction])
    return (
        predictions.select(
            *[qcol(k) for k in key],
            qcol(label).cast("double").alias("actual"),
            qcol(prediction).cast("double").alias("predicted"),
        )
        .orderBy(*[qcol(k) for k in key])
        .limit(rows)
    )
