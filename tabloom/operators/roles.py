"""Column roles and the target's task type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.dates import best_format_share
from tabloom.functions.missing import value_or_null
from tabloom.functions.names import looks_like_identifier_name
from tabloom.functions.numbers import is_numeric, ratio
from tabloom.operators.frequencies import described_columns, distinct_counts, frequencies
from tabloom.operators.lanes import local_table

# The thresholds of the rules.
DATETIME_SHARE = 0.75
HIGH_CARDINALITY_COUNT = 50
HIGH_CARDINALITY_MIN = 15
HIGH_CARDINALITY_RATIO = 0.5
TASK_UNIQUE_LIMIT = 20
IDENTIFIER_RATIO = 0.8

ROLE_FLAGS = ("is_numeric", "is_categorical", "is_datetime", "is_boolean", "is_high_cardinality")


def _native_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def high_cardinality_rule(unique: Column, present: Column) -> Column:
    share = ratio(unique, F.greatest(present, F.lit(1)))
    return (unique >= HIGH_CARDINALITY_COUNT) | (
        (unique >= HIGH_CARDINALITY_MIN) & (share >= HIGH_CARDINALITY_RATIO)
    )


def _text_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, parse_ratio, present_count, unique_count)`` of text columns from one grouped pass.

    Dates are parsed once per distinct value, weighted by its count.
    """
    freq = frequencies(df, list(columns), identity=True)
    present = F.col("value").isNotNull()
    return freq.groupBy("column").agg(
        best_format_share(F.col("value"), F.col("cnt")).alias("parse_ratio"),
        F.coalesce(F.sum(F.when(present, F.col("cnt"))), F.lit(0)).cast("bigint").alias("present_count"),
        F.count("value").alias("unique_count"),
    )


def datetime_parse_ratio(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, parse_ratio)``: share of the non-null cells of text columns that are dates.

    All rows count, so the answer does not depend on row order.
    """
    return _text_facts(df, columns).select("column", "parse_ratio").orderBy("column")


def column_roles(df: DataFrame) -> DataFrame:
    """``(column, dtype, is_numeric, is_categorical, is_datetime, is_boolean, is_high_cardinality)``.

    The schema settles numbers, booleans and native dates. Only the remaining text-like columns
    are read, in one grouped pass that serves the date and the cardinality test.
    """
    fields = df.schema.fields
    texts = [f.name for f in fields if not is_numeric(f.dataType)
             and not _native_datetime(f.dataType) and not isinstance(f.dataType, T.BooleanType)]
    kinds = [
        (f.name, is_numeric(f.dataType), _native_datetime(f.dataType), isinstance(f.dataType, T.BooleanType))
        for f in fields
    ]
    spark = df.sparkSession
    by_schema = local_table(spark, kinds, "column string, numeric boolean, native boolean, bool boolean")
    # every input of these joins has one row per column
    facts = (
        described_columns(df, df.columns)
        .join(F.broadcast(by_schema), "column")
        .join(F.broadcast(_text_facts(df, texts)), "column", "left")
    )
    is_date = F.col("native") | (~F.col("bool") & ~F.col("numeric") & F.coalesce(
        (F.col("parse_ratio") >= DATETIME_SHARE) & (F.col("present_count") > 0), F.lit(False)))
    is_category = F.col("bool") | (~F.col("numeric") & ~is_date)
    high = is_category & ~F.col("bool") & F.coalesce(
        high_cardinality_rule(F.col("unique_count"), F.col("present_count")), F.lit(False))
    return facts.select(
        "position", "column", "dtype",
        (F.col("numeric") & ~F.col("bool")).alias("is_numeric"),
        is_category.alias("is_categorical"), is_date.alias("is_datetime"),
        F.col("bool").alias("is_boolean"), high.alias("is_high_cardinality"),
    ).orderBy("position").drop("position")


def roles_by_kind(df: DataFrame, roles: DataFrame | None = None) -> dict[str, list[str]]:
    """Roles as name lists in column order: one small row per column comes to the driver."""
    rows = {row["column"]: row for row in (column_roles(df) if roles is None else roles).collect()}
    return {
        flag.removeprefix("is_"): [name for name in df.columns if rows[name][flag]] for flag in ROLE_FLAGS
    }


def _value_totals(df: DataFrame, target: str) -> DataFrame:
    """``(n_rows, usable_rows, unique_count)`` of one column: one grouped count."""
    groups = df.select(value_or_null(df, target).alias("y")).groupBy("y").agg(F.count(F.lit(1)).alias("cnt"))
    zero = F.lit(0).cast("bigint")
    return groups.agg(
        F.coalesce(F.sum("cnt"), zero).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("y").isNotNull(), F.col("cnt"))), zero).alias("usable_rows"),
        F.count("y").alias("unique_count"),
    )


def _task_rule(dtype: T.DataType) -> Column:
    if not is_numeric(dtype) and not _native_datetime(dtype):
        return F.lit("classification")
    limit = F.least(
        F.lit(TASK_UNIQUE_LIMIT),
        F.greatest(F.lit(2), F.floor(F.col("usable_rows") * F.lit(0.1)).cast("int")),
    )
    few = (F.col("usable_rows") == 0) | (F.col("unique_count") <= limit)
    return F.when(few, "classification").otherwise("regression")


def infer_task(df: DataFrame, target: str) -> DataFrame:
    """One row ``(column, task, usable_rows, unique_count)``; also the rule for label arrays."""
    if target not in df.columns:
        raise ValueError(f"no such column: {target}")
    return _value_totals(df, target).select(
        F.lit(target).alias("column"),
        _task_rule(df.schema[target].dataType).alias("task"),
        "usable_rows", "unique_count",
    )


def task_type(df: DataFrame, target: str) -> str:
    return infer_task(df, target).first()["task"]


def identifier_check(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, unique_ratio, is_identifier)``: an id-like name over mostly unique values."""
    names = list(df.columns if columns is None else columns)
    named = [name for name in names if looks_like_identifier_name(name)]
    flags = local_table(
        df.sparkSession, [(name, name in named) for name in names], "column string, id_name boolean"
    )
    rows = F.col("missing_count") + F.col("present_count")
    return distinct_counts(df, names).join(F.broadcast(flags), "column").select(
        "column",
        ratio(F.col("unique_count"), F.greatest(rows, F.lit(1))).alias("unique_ratio"),
        "id_name",
    ).select(
        "column", "unique_ratio",
        (F.col("id_name") & (F.col("unique_ratio") > IDENTIFIER_RATIO)).alias("is_identifier"),
    ).orderBy("column")


def can_stratify(df: DataFrame, label: str) -> DataFrame:
    """One row ``(classes, min_count, can_stratify)``; missing counts as a class."""
    counts = df.select(value_or_null(df, label).alias("y")).groupBy("y").agg(F.count(F.lit(1)).alias("cnt"))
    totals = counts.agg(F.count(F.lit(1)).alias("classes"), F.min("cnt").alias("min_count"))
    return totals.select(
        "classes", "min_count",
        F.coalesce((F.col("classes") >= 2) & (F.col("min_count") >= 2), F.lit(False)).alias("can_stratify"),
    )
