"""Numeric expressions that stay safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def to_number(ref: Column) -> Column:
    """Read anything as double; what does not parse becomes NULL, and so does NaN."""
    number = ref.try_cast("double")
    return F.when(~F.isnan(number), number)


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson correlation; NULL for constant or too short input."""
    x, y = x.cast("double"), y.cast("double")
    both_x = F.when(y.isNotNull(), x)
    both_y = F.when(x.isNotNull(), y)
    ratio = F.try_divide(F.covar_pop(x, y), F.stddev_pop(both_x) * F.stddev_pop(both_y))
    return F.when(~F.isnan(ratio), ratio)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where ``whole`` is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
