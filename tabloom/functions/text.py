"""Text rendering helpers used by reports and frequency tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(ref: Column, dtype: T.DataType) -> Column:
    """Text form of a cell; booleans print as True/False."""
    if isinstance(dtype, T.BooleanType):
        return F.when(ref, F.lit("True")).when(~ref, F.lit("False"))
    return ref.cast("string")


def format_percent(share: Column, digits: int = 2) -> Column:
    """0.1234 -> 12.34%, missing -> -"""
    shown = F.format_string(f"%.{digits}f%%", share.cast("double") * F.lit(100.0))
    return F.when(share.isNull() | F.isnan(share.cast("double")), F.lit("-")).otherwise(shown)


def short_text(text: Column, max_len: int = 60) -> Column:
    """Cut long text to ``max_len`` characters, the last three being dots."""
    cut = F.concat(F.substring(text, 1, max_len - 3), F.lit("..."))
    return F.when(F.char_length(text) > max_len, cut).otherwise(text)


def safe_round(value: Column, digits: int = 4) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(number), F.round(number, digits))
