"""Reshaping a wide table for per-column work.

Cells are unpivoted inside each task, so that one small aggregate serves all columns. A single
wide aggregate over many columns generates methods too large for the JIT compiler, which is far
slower.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabloom.functions.hashing import compact
from tabloom.functions.missing import value_or_null
from tabloom.functions.names import quoted
from tabloom.functions.numbers import to_number

# Fixed value: above 128 groups Spark sorts instead of hashing where a sketch is aggregated.
COLUMNS_PER_SCAN = 120


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small driver-made table as a literal relation: no job, and its size is known."""
    struct = T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    arrow = pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=to_arrow_schema(struct))
    return spark.createDataFrame(arrow, struct)


def together(*jobs: Callable[[], Any]) -> list[Any]:
    """Results of jobs that don't need each other, run side by side so that one fills the cores another leaves idle."""
    with ThreadPool(len(jobs)) as pool:
        return pool.map(lambda job: job(), jobs)


def held(df: DataFrame) -> DataFrame:
    """A result of a few rows per column of a table, computed once and kept as a literal relation."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return local_table(spark, [], schema)


def batches(items: Sequence, size: int) -> Iterator[Sequence]:
    for start in range(0, len(items), size):
        yield items[start:start + size]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    cell: Callable[[str], Column],
    measures: Sequence[Column],
    schema: str,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row ``(column, *measures)`` per column; ``measures`` aggregate the column ``value``.

    ``cell`` gives the value of a column, of one type for all. The cells are unpivoted and grouped
    by column name, so the generated code stays small however many columns there are, each task
    sends one row per column, and the whole batch is one scan. A table without rows gives none.
    """
    if not columns:
        return empty(df.sparkSession, schema)
    frames = []
    for batch in batches(list(columns), COLUMNS_PER_SCAN):
        long = _unpivot(df, {name: cell(name) for name in batch}, carry or {})
        frames.append(long.groupBy("column").agg(*measures))
    return union_all(frames)


def _unpivot(df: DataFrame, cells: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """``(column, value, *carry)`` with one row per cell."""
    carried = [ref.alias(f"__{key}") for key, ref in carry.items()]
    wide = df.select(*carried, *[ref.alias(name) for name, ref in cells.items()])
    long = wide.unpivot(
        [f"__{key}" for key in carry], [quoted(name) for name in cells], "column", "value")
    return long.withColumnsRenamed({f"__{key}": key for key in carry})


def number_cell(df: DataFrame) -> Callable[[str], Column]:
    """Cells as double, NULL where missing or not a number."""
    return lambda name: to_number(value_or_null(df, name))


def _lane_type(dtype: T.DataType) -> str:
    """Grouping type that keeps distinct values distinct and cheap to hash."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
        return dtype.simpleString()
    return "string"


def _groupable(ref: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return ref
    if isinstance(dtype, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(ref)))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(ref)
    if isinstance(dtype, T.BinaryType):
        return F.base64(ref)
    return ref.cast("string")


def typed_lanes(
    df: DataFrame, columns: Sequence[str], carry: dict[str, Column] | None = None, identity: bool = False
) -> list[DataFrame]:
    """Unpivoted ``(column, value, *carry)`` frames, one per value type.

    Keeping numbers typed avoids printing every cell; each lane reads only its own columns.
    ``identity`` is for callers that only compare values: long text shrinks to a digest.
    """
    by_type: dict[str, list[str]] = {}
    for name in columns:
        by_type.setdefault(_lane_type(df.schema[name].dataType), []).append(name)
    lanes = []
    for lane, names in by_type.items():
        cells = {}
        for name in names:
            ref = value_or_null(df, name)
            ref = _groupable(ref, df.schema[name].dataType) if lane == "string" else ref.cast(lane)
            cells[name] = compact(ref) if identity and lane == "string" else ref
        long = _unpivot(df, cells, carry or {})
        lanes.append(long)
    return lanes


def numeric_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-missing numeric cells ``(column, value double)`` of all ``columns``."""
    cell = number_cell(df)
    return _unpivot(df, {name: cell(name) for name in columns}, {}).where(F.col("value").isNotNull())
