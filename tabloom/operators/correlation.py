"""Pearson correlation over column pairs."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.lanes import empty, number_cell

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

CORRELATION_SCHEMA = "x string, y string, corr double"
PART_FIELDS = ("n", "mx", "my", "xx", "yy", "xy")
PART_SCHEMA = "i int, j int, " + ", ".join(f"{name} double" for name in PART_FIELDS)


def _shifted(part: pa.RecordBatch, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns])
    there = ~np.isnan(values)
    fresh = np.isnan(shift) & there.any(axis=0)
    shift[fresh] = values[there.argmax(axis=0)[fresh], fresh.nonzero()[0]]
    return np.where(there, values - np.where(np.isnan(shift), 0.0, shift), 0.0), there.astype(np.float64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's moments of every pair over the rows that have both, by matrix products.

    Values are taken relative to the first of their column, so constant columns stay exact.
    """
    shift, sums = None, None
    for batch in batches:
        if shift is None:
            shift = np.full(batch.num_columns, np.nan)
        x, there = _shifted(batch, shift)
        products = np.array([there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x])
        sums = products if sums is None else sums + products
    if sums is None:
        return
    i, j = np.triu_indices(len(shift))
    n, sx, sy, sxx, syy, sxy = sums[:, i, j]
    known = n > 0
    i, j, n, sx, sy, sxx, syy, sxy = (v[known] for v in (i, j, n, sx, sy, sxx, syy, sxy))
    columns = [n, shift[i] + sx / n, shift[j] + sy / n, sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n]
    yield pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, columns)], names=["i", "j", *PART_FIELDS])


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full matrix as ``(x, y, corr)``, each pair over the rows where both are present.

    One scan: each task multiplies its batches into one small matrix for each moment and sends a
    row per pair. The parts are merged around the common mean. NULL for constant or absent pairs.
    """
    names = list(columns)
    if len(names) < 2:
        return empty(df.sparkSession, CORRELATION_SCHEMA)
    cell = number_cell(df)
    parts = df.select(*[cell(name).alias(f"c{k}") for k, name in enumerate(names)]).mapInArrow(_parts, PART_SCHEMA)
    listed = F.collect_list(F.struct(*PART_FIELDS))  # one entry per task
    merged = parts.groupBy("i", "j").agg(
        listed.alias("parts"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("mx")).alias("sx"), F.sum(F.col("n") * F.col("my")).alias("sy"),
        F.min("mx").alias("lx"), F.max("mx").alias("hx"), F.min("my").alias("ly"), F.max("my").alias("hy"))
    # equal means stay exact
    mean_x = F.when(F.col("lx") == F.col("hx"), F.col("lx")).otherwise(F.col("sx") / F.col("total"))
    mean_y = F.when(F.col("ly") == F.col("hy"), F.col("ly")).otherwise(F.col("sy") / F.col("total"))
    centred = merged.withColumns({"ax": mean_x, "ay": mean_y})

    def total(moment: str, left: str, right: str):
        around = lambda p: (p[f"m{left}"] - F.col(f"a{left}")) * (p[f"m{right}"] - F.col(f"a{right}"))
        return F.aggregate("parts", F.lit(0.0), lambda sum, p: sum + p[moment] + p["n"] * around(p))

    spread = F.sqrt(F.greatest(total("xx", "x", "x"), F.lit(0.0))) * F.sqrt(F.greatest(total("yy", "y", "y"), F.lit(0.0)))
    ratio = F.try_divide(total("xy", "x", "y"), spread)
    corr = F.when(ratio.isNotNull() & ~F.isnan(ratio), F.greatest(F.least(ratio, F.lit(1.0)), F.lit(-1.0)))
    labels = F.array(*[F.lit(name) for name in names])
    numbers = F.sequence(F.lit(0), F.lit(len(names) - 1))
    # pairs that no task has seen together are listed too; the grid has a row for each pair of columns
    pairs = df.sparkSession.range(1).select(F.explode(numbers).alias("i")).select("i", F.explode(numbers).alias("j")).where("i <= j")
    half = pairs.join(F.broadcast(centred.select("i", "j", corr.alias("corr"))), ["i", "j"], "left").select(
        F.get(labels, F.col("i")).alias("x"), F.get(labels, F.col("j")).alias("y"), "corr")
    mirror = F.when(
        F.col("x") == F.col("y"), F.array(F.struct("x", "y", "corr"))
    ).otherwise(
        F.array(F.struct("x", "y", "corr"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "corr"))
    )
    return half.select(F.inline(mirror)).orderBy("x", "y")


def upper_triangle(matrix: DataFrame) -> DataFrame:
    return matrix.where(F.col("x") < F.col("y"))
