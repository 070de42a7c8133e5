"""Exact metrics from prediction tables ``(y_true, y_pred [, score])``.

``by`` names extra grouping columns, for example a fold number, so that the metrics of all folds
come from one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.numbers import ratio
from tabloom.operators.features import MISSING_CATEGORY
from tabloom.operators.lanes import union_all

SCORE_SEGMENTS = 256


def _pairs(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of (truth, prediction); a missing label is a label of its own, so every row counts."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)).alias(c) for c in ("y_true", "y_pred")]
    return predictions.groupBy(*by, *named).agg(F.count(F.lit(1)).alias("count"))


def class_labels(predictions: DataFrame) -> DataFrame:
    """Distinct labels seen as truth or prediction."""
    return _pairs(predictions, []).select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()


def confusion(predictions: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """``(y_true, y_pred, count)`` of the pairs that occur; with ``labels`` also of theirs that don't, as 0.

    The grid of given labels is as large as their number squared; without them nothing is laid out.
    Pairs with another label, or a missing one, are listed beside the grid, so counts add up to the rows.
    """
    pairs = _pairs(predictions, [])
    if labels is None:
        return pairs
    names = pairs.agg(F.count(F.lit(1))).select(F.array(*[F.lit(x) for x in labels]).alias("labels"))
    grid = names.select("labels", F.explode("labels").alias("y_true")).select(
        "y_true", F.explode("labels").alias("y_pred"))
    return grid.join(pairs, ["y_true", "y_pred"], "full").select(
        "y_true", "y_pred", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def confusion_wide(predictions: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The matrix with one column per predicted label."""
    return confusion(predictions, labels).groupBy("y_true").pivot("y_pred", list(labels)).agg(F.first("count"))


def _long(wide: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(by), list(metrics), "metric", "value")


def classification_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(metric, value)``: accuracy and support-weighted precision, recall and F1."""
    by = list(by)
    pairs = _pairs(predictions, by)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("count")).otherwise(0)
    sides = pairs.select(*by, F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("count").alias("support"), F.lit(0).cast("bigint").alias("guessed"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("count").alias("guessed"), F.lit(0).cast("bigint").alias("hits")),
    )))
    per_label = sides.groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits"))
    precision = ratio(F.col("hits"), F.col("guessed"))
    recall = ratio(F.col("hits"), F.col("support"))
    f1 = ratio(2 * F.col("hits"), F.col("support") + F.col("guessed"))
    weight = F.col("support").cast("double")

    def weighted(value: Column) -> Column:
        return F.try_divide(F.sum(value * weight), F.sum(weight))

    wide = per_label.groupBy(*by).agg(
        F.try_divide(F.sum("hits").cast("double"), F.sum(weight)).alias("accuracy"),
        weighted(precision).alias("precision_weighted"),
        weighted(recall).alias("recall_weighted"),
        weighted(f1).alias("f1_weighted"),
    )
    return _long(wide, by, ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted"])


def roc_auc(predictions: DataFrame, positive: str, score: str = "score") -> DataFrame:
    """One row ``(metric, value)``: exact area under the ROC curve, NULL for a single class.

    Equal scores are merged first. Running totals are taken inside segments of the score range
    (cut at its quantiles, so each holds a like number of rows) and shifted by segment totals.
    """
    marks = [i / SCORE_SEGMENTS for i in range(1, SCORE_SEGMENTS)]
    cuts = sorted(set(predictions.approxQuantile(score, marks, 0.25 / SCORE_SEGMENTS)))
    is_positive = F.col("y_true").cast("string") == F.lit(positive)
    scored = predictions.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(is_positive).cast("double").alias("pos"), F.count_if(~is_positive).cast("double").alias("neg"))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        scored = Bucketizer(splits=splits, inputCol="score", outputCol="segment").transform(scored)
    else:
        scored = scored.withColumn("segment", F.lit(0.0))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # at most SCORE_SEGMENTS rows
    offsets = scored.groupBy("segment").agg(F.sum("neg").alias("n")).select(
        "segment", F.coalesce(F.sum("n").over(before), F.lit(0.0)).alias("offset"))
    below = Window.partitionBy("segment").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = scored.join(F.broadcast(offsets), "segment").withColumn(
        "below", F.col("offset") + F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    area = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return ranked.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("value")).select(
        F.lit("roc_auc").alias("metric"), "value")


def regression_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(metric, value)``: r2, mae, rmse from one aggregate."""
    by = list(by)
    y, p = F.col("y_true").cast("double"), F.col("y_pred").cast("double")
    wide = predictions.groupBy(*by).agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("variance"), F.avg(F.abs(y - p)).alias("mae"))
    # a constant target scores 1 when it is met exactly and 0 otherwise
    r2 = F.when(F.col("variance") > 0, 1 - F.try_divide(F.col("mse"), F.col("variance"))).when(
        F.col("variance") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    return _long(
        wide.select(*by, r2.alias("r2"), "mae", F.sqrt("mse").alias("rmse")), by, ["r2", "mae", "rmse"])


def metrics_table(predictions: DataFrame, task: str, positive: str | None = None) -> DataFrame:
    """All metrics of a task; ``roc_auc`` is NULL unless there is a score for two classes."""
    if task != "classification":
        return regression_metrics(predictions)
    base = classification_metrics(predictions)
    if positive is not None and "score" in predictions.columns:
        return union_all([base, roc_auc(predictions, positive)])
    return union_all([base, base.limit(1).select(F.lit("roc_auc").alias("metric"), F.lit(None).cast("double").alias("value"))])


def summarize_folds(fold_metrics: DataFrame) -> DataFrame:
    """``(metric, mean, std)`` over folds, std with ddof 0."""
    return fold_metrics.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
