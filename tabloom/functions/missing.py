"""One notion of missing: NaN becomes NULL before anything is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.names import column

MISSING_TEXT = "<missing>"


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def value_or_null(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL."""
    ref = column(name)
    if is_floating(df.schema[name].dataType):
        return F.when(~F.isnan(ref), ref)
    return ref


def normalize_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Project ``columns`` (all by default) with NaN turned into NULL."""
    names = df.columns if columns is None else columns
    return df.select(*[value_or_null(df, name).alias(name) for name in names])


def is_missing(df: DataFrame, name: str) -> Column:
    ref = column(name)
    if is_floating(df.schema[name].dataType):
        return ref.isNull() | F.isnan(ref)
    return ref.isNull()


def fill_missing(text: Column, marker: str = MISSING_TEXT) -> Column:
    return F.coalesce(text, F.lit(marker))
