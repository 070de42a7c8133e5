"""Train/test splits and folds by seeded hash, with exact stratified variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import HASH_RANGE, seeded_hash
from tabloom.functions.missing import value_or_null

# The bounds of the split settings.
MIN_TEST, MAX_TEST = 0.1, 0.5
MIN_FOLDS, MAX_FOLDS = 2, 10
HASH_SLICES = 4096


def clipped_test_size(test_size: float) -> float:
    return min(max(test_size, MIN_TEST), MAX_TEST)


def hash_split(df: DataFrame, key: Column, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: row-local, so no shuffle; the share is met up to sampling noise."""
    limit = int(clipped_test_size(test_size) * HASH_RANGE)
    return df.withColumn("is_test", seeded_hash(key, seed) < limit)


def hash_folds(df: DataFrame, key: Column, folds: int, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..folds-1: row-local, so no shuffle."""
    return df.withColumn("fold", F.pmod(seeded_hash(key, seed), F.lit(folds)).cast("int"))


def _ranked_keys(df: DataFrame, label: str, key: Column, seed: int, slices: int) -> DataFrame:
    """Rows with ``__key_rank``, ``__before``, ``__copies`` and ``__size`` of their key in its class.

    Keys are ranked, not rows, so copies of a row stay together; a key seen with several labels
    belongs to the smallest. Keys of a class are ranked inside ``slices`` slices of their hash and
    shifted by the slices before, so one class holding most rows still spreads over many tasks.
    """
    keyed = df.withColumn("__k", key.cast("string"))
    keys = (
        keyed.groupBy("__k").agg(F.min(value_or_null(df, label)).alias("__y"), F.count(F.lit(1)).alias("__copies"))
        .withColumn("__h", seeded_hash(F.col("__k"), seed))
        .withColumn("__slice", F.floor(F.col("__h") / (HASH_RANGE // slices)).cast("int"))
    )
    sizes = keys.groupBy("__y", "__slice").agg(F.count(F.lit(1)).alias("__n"), F.sum("__copies").alias("__rows"))
    before = Window.partitionBy("__y").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("__y").alias("__oy"), F.col("__slice").alias("__oslice"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__keys_before"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__rows").over(Window.partitionBy("__y")).alias("__size"),
    )
    within = Window.partitionBy("__y", "__slice").orderBy("__h", "__k")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    ranked = keys.withColumn("__r", F.row_number().over(within)).withColumn("__upto", F.sum("__copies").over(upto)).join(
        offsets, F.col("__y").eqNullSafe(F.col("__oy")) & (F.col("__slice") == F.col("__oslice"))
    ).select(
        F.col("__k").alias("__ranked"), (F.col("__keys_before") + F.col("__r") - 1).alias("__key_rank"),
        (F.col("__rows_before") + F.col("__upto") - F.col("__copies")).alias("__before"), "__copies", "__size",
    )
    return keyed.join(ranked, F.col("__k").eqNullSafe(F.col("__ranked"))).drop("__k", "__ranked")


SCRATCH = ("__key_rank", "__before", "__copies", "__size")


def stratified_split(
    df: DataFrame, label: str, key: Column, test_size: float = 0.2, seed: int = 42, slices: int = HASH_SLICES
) -> DataFrame:
    """Add ``is_test`` so that every class gives its rounded share, exact where keys are unique.

    Copies share a side; the key on the border goes to the side that holds most of its rows.
    """
    wanted = F.floor(F.col("__size") * F.lit(clipped_test_size(test_size)) + F.lit(0.5))
    ranked = _ranked_keys(df, label, key, seed, slices)
    return ranked.withColumn("is_test", F.col("__before") + F.col("__copies") / 2 <= wanted).drop(*SCRATCH)


def stratified_folds(
    df: DataFrame, label: str, key: Column, folds: int, seed: int = 42, slices: int = HASH_SLICES
) -> DataFrame:
    """Add ``fold`` so that the keys of each class are spread evenly over the folds."""
    ranked = _ranked_keys(df, label, key, seed, slices)
    return ranked.withColumn("fold", F.pmod("__key_rank", F.lit(folds)).cast("int")).drop(*SCRATCH)


def safe_folds(df: DataFrame, label: str, requested: int, task: str) -> DataFrame:
    """One row ``folds``: the request clipped to what the smallest class or the row count allows."""
    wanted = min(max(int(requested), MIN_FOLDS), MAX_FOLDS)
    if task == "classification":
        counts = df.select(value_or_null(df, label).alias("y")).where(F.col("y").isNotNull()).groupBy("y").agg(
            F.count(F.lit(1)).alias("n"))
        limit = counts.agg(F.coalesce(F.min("n"), F.lit(0)).alias("limit"))
    else:
        limit = df.agg(F.count(F.lit(1)).alias("n")).select(
            F.when(F.col("n") >= 10, F.floor(F.col("n") / 5)).otherwise(2).alias("limit"))
    return limit.select(
        F.greatest(F.lit(MIN_FOLDS), F.least(F.lit(wanted), F.col("limit"))).cast("int").alias("folds"))
