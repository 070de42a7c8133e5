"""Value frequencies of many columns at once, and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.missing import MISSING_TEXT
from tabloom.functions.text import as_text
from tabloom.operators.lanes import empty, local_table, typed_lanes, union_all

FREQUENCY_SCHEMA = "column string, value string, cnt bigint"
RANKED_SCHEMA = "column string, value string, cnt bigint, rank int"


def frequencies(df: DataFrame, columns: Sequence[str] | None = None, identity: bool = False) -> DataFrame:
    """``(column, value, cnt)`` for all columns; a NULL value row holds the missing cells.

    With ``identity`` long text shows as a digest, for callers that only count.

    Map-side combine collapses frequent values before the shuffle, so a value that fills a
    third of a column costs one row per task.
    """
    names = list(df.columns if columns is None else columns)
    if not names:
        return empty(df.sparkSession, FREQUENCY_SCHEMA)
    frames = []
    for lane in typed_lanes(df, names, identity=identity):
        counted = lane.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
        dtype = lane.schema["value"].dataType
        frames.append(counted.select("column", as_text(F.col("value"), dtype).alias("value"), "cnt"))
    return union_all(frames)


def value_counts(df: DataFrame, name: str, missing_label: str | None = None) -> DataFrame:
    """``(value, cnt)`` of one column. Missing cells are dropped, or counted under a label."""
    freq = frequencies(df, [name]).select("value", "cnt")
    if missing_label is None:
        return freq.where(F.col("value").isNotNull())
    return freq.select(F.coalesce("value", F.lit(missing_label)).alias("value"), "cnt")


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column, ties broken by value.

    The ``rank <= k`` filter lets Spark limit each task to ``k`` rows per column before the
    exchange, so a column of unique ids sends ``k`` rows per task, not all of them.
    """
    order = Window.partitionBy("column").orderBy(F.col("cnt").desc(), F.col("value").asc())
    return freq.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, columns: Sequence[str], k: int = 20, missing_label: str | None = MISSING_TEXT) -> DataFrame:
    """Category frequencies ``(column, value, cnt, rank)`` with missing cells as a category."""
    if not columns:
        return empty(df.sparkSession, RANKED_SCHEMA)
    freq = frequencies(df, columns)
    if missing_label is None:
        freq = freq.where(F.col("value").isNotNull())
    else:
        freq = freq.withColumn("value", F.coalesce("value", F.lit(missing_label)))
    return top_values(freq, k)


def most_frequent(freq: DataFrame) -> DataFrame:
    """``(column, value)``: the most frequent non-missing value, smallest on ties.

    ``min_by`` merges per task and keeps one candidate per column.
    """
    order = F.struct((-F.col("cnt")).alias("neg"), F.col("value").alias("v"))
    return (
        freq.where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(F.min_by("value", order).alias("value"))
    )


def column_counts(freq: DataFrame) -> DataFrame:
    """``(column, missing_count, present_count, unique_count)`` from value frequencies."""
    missing = F.col("value").isNull()
    return freq.groupBy("column").agg(
        F.coalesce(F.sum(F.when(missing, F.col("cnt"))), F.lit(0)).cast("bigint").alias("missing_count"),
        F.coalesce(F.sum(F.when(~missing, F.col("cnt"))), F.lit(0)).cast("bigint").alias("present_count"),
        F.count("value").cast("bigint").alias("unique_count"),
    )


def described_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(position, column, dtype)``: the schema as a table, one row per column."""
    rows = [(i, name, df.schema[name].dataType.simpleString()) for i, name in enumerate(columns)]
    return local_table(df.sparkSession, rows, "position int, column string, dtype string")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact ``(position, column, dtype, missing_count, present_count, unique_count)``."""
    names = list(df.columns if columns is None else columns)
    zero = F.lit(0).cast("bigint")
    # both sides have one row per column of the schema
    return (
        described_columns(df, names)
        .join(F.broadcast(column_counts(frequencies(df, names, identity=True))), "column", "left")
        .select(
            "position", "column", "dtype",
            *[F.coalesce(c, zero).alias(c) for c in ("missing_count", "present_count", "unique_count")],
        )
    )
