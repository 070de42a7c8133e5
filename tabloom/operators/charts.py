"""The numbers behind each chart; drawing is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.hashing import seeded_hash
from tabloom.operators.correlation import correlation
from tabloom.operators.frequencies import top_k
from tabloom.operators.lanes import empty, number_cell, numeric_cells, per_column
from tabloom.operators.profile import missing_ratios
from tabloom.operators.quality import IQR_FACTOR, iqr_outliers
from tabloom.operators.quantiles import quartile_outliers

HISTOGRAM_SCHEMA = "column string, bucket int, lo double, hi double, count bigint"
# How much each chart shows.
HISTOGRAM_BINS = 30
BOX_SCHEMA = (
    "column string, min double, p25 double, p50 double, p75 double, max double, lower_bound double, upper_bound double, "
    "outlier_count bigint"
)
FREQUENCY_TOP = 20
TARGET_TOP = 30
IMPORTANCE_TOP = 25


def missing_bar(df: DataFrame) -> DataFrame:
    return missing_ratios(df)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(column, bucket, lo, hi, count)``: equal-width bins, empty ones included.

    The largest value belongs to the last bin; a constant column has a single bin.
    """
    if not columns:
        return empty(df.sparkSession, HISTOGRAM_SCHEMA)

    limits = per_column(
        df, columns, number_cell(df), [F.min("value").alias("least"), F.max("value").alias("most")],
        "column string, least double, most double").where(F.col("least").isNotNull())
    flat = F.col("least") == F.col("most")
    # limits and bins are bounded by the number of columns, not by the data
    slot = F.least(F.width_bucket("value", F.col("least"), F.col("most"), F.lit(bins)), F.lit(bins))
    counted = (
        numeric_cells(df, columns).join(F.broadcast(limits), "column")
        .select("column", F.when(flat, F.lit(1)).otherwise(slot).cast("int").alias("bucket"))
        .groupBy("column", "bucket").agg(F.count(F.lit(1)).alias("count"))
    )
    step = (F.col("most") - F.col("least")) / bins
    last = F.when(flat, F.lit(1)).otherwise(F.lit(bins))
    shelves = limits.select("column", "least", "most", F.explode(F.sequence(F.lit(1), last)).alias("bucket")).select(
        "column", F.col("bucket").cast("int").alias("bucket"),
        (F.col("least") + (F.col("bucket") - 1) * step).alias("lo"),
        F.when(F.col("bucket") == last, F.col("most")).otherwise(F.col("least") + F.col("bucket") * step).alias("hi"),
    )
    return shelves.join(F.broadcast(counted), ["column", "bucket"], "left").select(
        "column", "bucket", "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    ).orderBy("column", "bucket")


def box_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Five numbers plus the outlier fences of the box beside a histogram, from the same two passes."""
    if not columns:
        return empty(df.sparkSession, BOX_SCHEMA)
    return quartile_outliers(df, columns, IQR_FACTOR, five=True).select(
        "column", "min", "p25", "p50", "p75", "max", "lower_bound", "upper_bound", "outlier_count").orderBy("column")


def category_frequency(df: DataFrame, name: str, top_n: int = FREQUENCY_TOP) -> DataFrame:
    return top_k(df, [name], top_n).orderBy("column", "rank")


def target_distribution(df: DataFrame, target: str, task: str) -> DataFrame:
    """Frequencies for classes, a histogram for numbers."""
    if task == "classification":
        return category_frequency(df, target, TARGET_TOP)
    return histogram(df, [target])


def correlation_cells(df: DataFrame, columns: Sequence[str], max_columns: int | None = None) -> DataFrame:
    """Correlations of all given columns, or of the first ``max_columns``."""
    return correlation(df, list(columns)[:max_columns])


def outlier_bar(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return iqr_outliers(df, columns).select("column", "outlier_ratio").orderBy("outlier_ratio", "column")


def importance_bar(importance: DataFrame, measure: str = "importance", top_n: int = IMPORTANCE_TOP) -> DataFrame:
    """The largest ``top_n`` entries of an importance or Shapley table."""
    return importance.orderBy(F.desc(measure), "feature").limit(top_n)


def prediction_points(predictions: DataFrame, key: Column, points: int, seed: int = 42) -> DataFrame:
    """``(y_true, y_pred)`` points for a scatter chart: the ``points`` smallest row hashes."""
    return (
        predictions.select("y_true", "y_pred", seeded_hash(key, seed).alias("h"))
        .orderBy("h", "y_true", "y_pred").limit(points).select("y_true", "y_pred")
    )


def ideal_line(predictions: DataFrame) -> DataFrame:
    """One row ``(low, high)``: end points of the ideal prediction line."""
    return predictions.agg(
        F.least(F.min("y_true"), F.min("y_pred")).alias("low"),
        F.greatest(F.max("y_true"), F.max("y_pred")).alias("high"),
    )
