"""Table profile: overview, missing cells, numeric and categorical summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.missing import is_missing, normalize_missing
from tabloom.functions.names import column
from tabloom.functions.numbers import is_numeric, ratio
from tabloom.operators.frequencies import (
    column_counts, described_columns, distinct_counts, frequencies, top_values,
)
from tabloom.operators.lanes import empty, per_column, typed_lanes, union_all
from tabloom.operators.quantiles import ACCURACY, approximate_quantiles, exact_quantiles
from tabloom.operators.roles import high_cardinality_rule

# bytes of a cell by type; others have 8
WIDTHS = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4}
NUMERIC_SCHEMA = (
    "column string, count bigint, mean double, std double, min double, "
    "p25 double, p50 double, p75 double, max double"
)
CATEGORICAL_SCHEMA = (
    "column string, unique_count bigint, unique_ratio double, is_high_cardinality boolean, top_values string"
)


def numeric_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if is_numeric(field.dataType)]


def _digests(df: DataFrame) -> DataFrame:
    """``(h1, h2, missing)`` per row: a 128-bit hash of all cells and the number of missing ones.

    Only equality of rows matters to the callers, so nothing else of a wide row is shuffled. Hashes
    skip missing cells; which those are is hashed beside them.
    """
    wide = normalize_missing(df)
    refs = []
    for field in wide.schema.fields:
        ref = column(field.name)
        if isinstance(field.dataType, T.MapType):
            ref = F.array_sort(F.map_entries(ref))
        elif isinstance(field.dataType, T.VariantType):
            ref = F.to_json(ref)
        refs.append(ref)
    gaps = [column(c).isNull() for c in wide.columns]
    missing = sum((gap.cast("bigint") for gap in gaps), F.lit(0).cast("bigint"))
    size = sum((cell_size(f) for f in wide.schema.fields), F.lit(0).cast("bigint"))
    return wide.select(
        F.xxhash64(*refs, *gaps).alias("h1"), F.xxhash64(F.lit(1), *refs, *gaps).alias("h2"), missing.alias("missing"), size.alias("size"))


def cell_size(field: T.StructField) -> Column:
    """Bytes of a cell: the width of a number, the UTF-8 bytes of a text, of a nested value as JSON; a missing cell has none."""
    ref, kind = column(field.name), field.dataType
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType, T.BinaryType)):
        size = F.octet_length(ref)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        size = F.octet_length(F.to_json(ref))
    else:
        width = WIDTHS.get(kind.typeName(), 8)
        size = F.lit(16 if isinstance(kind, T.DecimalType) and kind.precision > 18 else width)
    return F.coalesce(F.when(ref.isNotNull(), size), F.lit(0)).cast("bigint")


def _row_groups(df: DataFrame) -> DataFrame:
    # equal rows have as many missing cells and bytes, so these only ride along
    return _digests(df).groupBy("h1", "h2", "missing", "size").agg(F.count(F.lit(1)).alias("__copies"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row ``duplicate_rows``: rows beyond the first of each group of equal rows.

    NULL equals NULL. One shuffle of row digests; copies collapse before it.
    """
    return _row_groups(df).agg(
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )


def missing_cells(df: DataFrame) -> DataFrame:
    """``(n_rows, total_missing_cells)`` from one scan without any shuffle of rows."""
    per_row = sum((is_missing(df, c).cast("int") for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias("total_missing_cells"),
    )


def overview(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, duplicate_rows, total_missing_cells, missing_cell_ratio, size_bytes.

    Duplicates, missing cells and bytes come from the same grouped rows: one scan, one shuffle.
    """
    grouped = _row_groups(df)
    zero = F.lit(0).cast("bigint")
    sums = grouped.agg(
        F.coalesce(F.sum("__copies"), zero).alias("n_rows"),
        F.coalesce(F.sum(F.col("__copies") - 1), zero).alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("__copies") * F.col("missing")), zero).alias("total_missing_cells"),
        F.coalesce(F.sum(F.col("__copies") * F.col("size")), zero).alias("size_bytes"),
    )
    return sums.select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        "duplicate_rows",
        "total_missing_cells",
        ratio(F.col("total_missing_cells"), F.greatest(F.col("n_rows") * len(df.columns), F.lit(1))).alias(
            "missing_cell_ratio"
        ),
        "size_bytes",
    )


def missing_summary(df: DataFrame, distinct: str = "exact", counts: DataFrame | None = None) -> DataFrame:
    """Per column: dtype, missing_count, missing_ratio, unique_count; worst column first.

    ``distinct="approx"`` replaces the exact distinct count (one shuffle of the values) by a
    sketch in the same single scan. ``counts`` may hand in ``distinct_counts(df)`` if it is there.
    """
    if counts is not None:
        pass
    elif distinct == "approx":
        measures = [
            F.count_if(F.col("value").isNull()).alias("missing_count"),
            F.count("value").alias("present_count"),
            F.approx_count_distinct("value", 0.01).alias("unique_count"),
        ]
        sketched = union_all([
            lane.groupBy("column").agg(*measures) for lane in typed_lanes(df, df.columns, identity=True)])
        zero = F.lit(0).cast("bigint")
        counts = described_columns(df, df.columns).join(F.broadcast(sketched), "column", "left").select(
            "position", "column", "dtype",
            *[F.coalesce(c, zero).alias(c) for c in ("missing_count", "present_count", "unique_count")],
        )
    elif distinct == "exact":
        counts = distinct_counts(df)
    else:
        raise ValueError("distinct must be exact or approx")
    rows = F.col("missing_count") + F.col("present_count")
    return counts.select(
        "column", "dtype", "missing_count",
        ratio(F.col("missing_count"), rows).alias("missing_ratio"),
        "unique_count",
    ).orderBy(F.desc("missing_ratio"), F.desc("missing_count"), "column")


def missing_ratios(df: DataFrame) -> DataFrame:
    """``(column, missing_ratio)`` from one scan, worst first."""
    ratios = per_column(
        df, df.columns, lambda name: is_missing(df, name), [F.avg(F.col("value").cast("double")).alias("missing_ratio")],
        "column string, missing_ratio double")
    return described_columns(df, df.columns).join(F.broadcast(ratios), "column", "left").select(
        "column", F.coalesce("missing_ratio", F.lit(0.0)).alias("missing_ratio")
    ).orderBy(F.desc("missing_ratio"), "column")


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, quantiles: str = "exact", accuracy: int = ACCURACY
) -> DataFrame:
    """Per numeric column: count, mean, std, min, p25, p50, p75, max."""
    names = list(numeric_columns(df) if columns is None else columns)
    if not names:
        return empty(df.sparkSession, NUMERIC_SCHEMA)

    moments = [
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ]
    find = exact_quantiles if quantiles == "exact" else approximate_quantiles
    found = find(
        df, names, [0.25, 0.5, 0.75], accuracy, moments, ", mean double, std double, min double, max double")
    return found.select(
        "column", F.col("n").alias("count"), "mean", "std", "min",
        F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p75"),
        "max",
    ).orderBy("column")


def categorical_summary(df: DataFrame, columns: Sequence[str], top_n: int = 5) -> DataFrame:
    """Per column: unique_count, unique_ratio, is_high_cardinality and the top values as text."""
    names = list(columns)
    if not names:
        return empty(df.sparkSession, CATEGORICAL_SCHEMA)
    freq = frequencies(df, names)  # shown values, so no digests here
    counts = described_columns(df, names).join(F.broadcast(column_counts(freq)), "column", "left")
    # at most top_n rows per column reach this point
    shown = F.concat_ws(": ", F.col("value"), F.col("cnt").cast("string"))
    tops = (
        top_values(freq.where(F.col("value").isNotNull()), top_n)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("shown")))).alias("tops"))
    )
    unique = F.coalesce("unique_count", F.lit(0)).cast("bigint")
    present = F.coalesce("present_count", F.lit(0)).cast("bigint")
    return counts.join(F.broadcast(tops), "column", "left").select(
        "column",
        unique.alias("unique_count"),
        ratio(unique, F.greatest(present, F.lit(1))).alias("unique_ratio"),
        high_cardinality_rule(unique, present).alias("is_high_cardinality"),
        F.coalesce(F.array_join("tops.shown", ", "), F.lit("")).alias("top_values"),
    ).orderBy("column")
