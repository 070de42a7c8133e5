"""Statistics over columns of numeric arrays (image stacks, sequences, embeddings).

A bundle is a table ``(file, position, name, sample_index, shape, dtype, values, text)`` with one
row per sample: ``shape`` is the shape of a single sample, ``values`` its flattened numbers, and
``text`` its content where the array does not hold numbers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import seeded_hash

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

BUNDLE_SCHEMA = (
    "file string, position int, name string, sample_index bigint, shape array<int>, dtype string, "
    "values array<double>, text string"
)
# Names that mark an array of labels.
LABEL_NAMES = ("y", "label", "labels", "target", "targets", "class", "classes")
STANDARDIZE_EPSILON = 1e-6


def known(values: Column) -> Column:
    """The array without NULL and NaN."""
    return F.filter(values.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _sorted_quantile(ordered: Column, size: Column, p: float) -> Column:
    """Linear-interpolation quantile of a sorted array, NULL when it is empty."""
    position = F.lit(p) * (size - 1)
    below = F.floor(position).cast("int")
    low = F.get(ordered, F.greatest(below, F.lit(0)))
    high = F.coalesce(F.get(ordered, F.greatest(below + 1, F.lit(0))), low)
    return F.when(size > 0, low + (position - below) * (high - low))


def array_summary(bundle: DataFrame) -> DataFrame:
    """Per array: shape as text, ndim, dtype and NaN-aware min, max, mean.

    Each row is reduced to four numbers before the shuffle; a file holding most samples costs
    no more than the partial aggregate of its rows.
    """
    per_row = bundle.select("file", "position", "name", "shape", "dtype", known(F.col("values")).alias("clean")).select(
        "file", "position", "name", "shape", "dtype", F.array_min("clean").alias("low"),
        F.array_max("clean").alias("high"), _total(F.col("clean")).alias("total"), F.size("clean").alias("n"),
    )
    grouped = per_row.groupBy("file", "position", "name", "shape", "dtype").agg(
        F.count(F.lit(1)).alias("samples"), F.min("low").alias("min"), F.max("high").alias("max"),
        F.sum("total").alias("total"), F.sum("n").alias("n"),
    )
    text = F.concat_ws(" × ", F.concat(F.array(F.col("samples").cast("string")), F.col("shape").cast("array<string>")))
    return grouped.select(
        "file", "position", "name", text.alias("shape"), (F.size("shape") + 1).alias("ndim"), "dtype",
        "samples", "min", "max", F.try_divide("total", F.col("n").cast("double")).alias("mean"),
    )


def guess_arrays(summary: DataFrame) -> DataFrame:
    """``(file, x_name, y_name)``: label array by name, feature array by rank and length.

    Several candidates: the first in file order wins, as it does without a label array.
    """
    label = F.lower("name").isin(*LABEL_NAMES)
    first_label = F.min(F.when(label, F.struct("position", "name", "samples")))
    labels = summary.groupBy("file").agg(first_label.alias("y"))
    numeric = F.col("dtype").rlike("^(u?int|float|complex)")
    ranked = summary.join(labels, "file")
    matching = (F.col("ndim") >= 2) & (F.col("name") != F.col("y.name")) & (F.col("samples") == F.col("y.samples"))
    any_array = (F.col("ndim") >= 2) & numeric
    spot = F.struct("position", "name")
    return ranked.groupBy("file", F.col("y.name").alias("y_name")).agg(
        F.coalesce(F.min(F.when(matching, spot)), F.min(F.when(any_array, spot))).alias("x"),
    ).select("file", F.col("x.name").alias("x_name"), "y_name")


def sample_features(df: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """Per sample: mean, std, min, max, p10, p50, p90 and energy of its numbers.

    Row-local: no shuffle. NULL and NaN are left out; a sample without numbers gives NULLs.
    """
    clean = df.select(*keys, known(F.col(values)).alias("clean"))
    sized = clean.select(*keys, F.array_sort("clean").alias("v"), F.size("clean").alias("n"))
    size = F.col("n").cast("double")
    meaned = sized.withColumn("img_mean", F.try_divide(_total(F.col("v")), size))
    spread = F.aggregate(
        "v", F.lit(0.0), lambda total, x: total + (x - F.col("img_mean")) * (x - F.col("img_mean"))
    )
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    return meaned.select(
        *keys, "img_mean", F.sqrt(F.try_divide(spread, size)).alias("img_std"),
        F.get("v", F.lit(0)).alias("img_min"), F.array_max("v").alias("img_max"),
        _sorted_quantile(F.col("v"), F.col("n"), 0.1).alias("img_p10"),
        _sorted_quantile(F.col("v"), F.col("n"), 0.5).alias("img_p50"),
        _sorted_quantile(F.col("v"), F.col("n"), 0.9).alias("img_p90"),
        F.try_divide(squares, size).alias("img_energy"),
    )


def feature_table(bundle: DataFrame, x_name: str, y_name: str | None = None) -> DataFrame:
    """Per-sample statistics of one array, with the label of the same sample as ``target``.

    Raises when the arrays of a file differ in length.
    """
    keys = ["file", "sample_index"]
    is_x, is_y = F.col("name") == x_name, F.col("name") == (y_name or x_name)
    # one pass answers every check; it leaves one row, whatever the number of files
    checks = bundle.where(is_x | is_y).groupBy("file").agg(
        F.count_if(is_x).alias("x"), F.count_if(is_y).alias("y"),
        F.min(F.when(is_x, F.size("shape"))).alias("depth"), F.bool_or(is_y & F.col("text").isNotNull()).alias("worded"),
    ).agg(
        F.coalesce(F.sum("x"), F.lit(0)).alias("x"), F.coalesce(F.sum("y"), F.lit(0)).alias("y"),
        F.min("depth").alias("depth"), F.coalesce(F.bool_or("worded"), F.lit(False)).alias("worded"),
        F.coalesce(F.bool_or(F.col("x") != F.col("y")), F.lit(False)).alias("uneven"),
    ).first()
    for name, rows in ((x_name, checks["x"]), (y_name, checks["y"])):
        if name is not None and not rows:
            raise ValueError(f"no array named {name}")
    if checks["depth"] < 1:
        raise ValueError(f"array {x_name} needs at least two dimensions")
    features = sample_features(bundle.where(is_x), keys)
    if y_name is None:
        return features
    if checks["uneven"]:
        raise ValueError(f"arrays {x_name} and {y_name} differ in length")
    target = F.col("text") if checks["worded"] else F.get("values", F.lit(0))
    return features.join(bundle.where(is_y).select(*keys, target.alias("target")), keys)


def merged(n: int, mean: float, squares: float, more: np.ndarray) -> tuple[int, float, float]:
    """Count, mean and sum of squared distances from the mean, with more numbers added, by Chan's rule."""
    if not more.size:
        return n, mean, squares
    own = float(more.mean())
    together, step = n + more.size, own - mean
    squares += float(((more - own) ** 2).sum()) + step * step * n * more.size / together
    return together, mean + step * more.size / together, squares


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each task that has numbers."""
    n, mean, squares = 0, 0.0, 0.0
    for batch in batches:
        numbers = batch.column(0).flatten().drop_null().to_numpy(zero_copy_only=False)
        n, mean, squares = merged(n, mean, squares, numbers[~np.isnan(numbers)])
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean], "squares": [squares]})


def global_moments(df: DataFrame, values: str = "values") -> DataFrame:
    """One row ``(mean, std)`` over every number of the column; NaN left out, std with ddof 0.

    A task's numbers become one row, and these are merged around the common mean.
    """
    parts = df.select(F.col(values).cast("array<double>").alias("values")).mapInArrow(_moments, "n bigint, mean double, squares double")
    # a row for each task
    everything = Window.partitionBy(F.lit(1))
    common = F.sum(F.col("n") * F.col("mean")).over(everything) / F.sum("n").over(everything)
    return parts.withColumn("common", common).agg(
        F.first("common").alias("mean"),
        F.sqrt(F.try_divide(
            F.sum(F.col("squares") + F.col("n") * (F.col("mean") - F.col("common")) * (F.col("mean") - F.col("common"))),
            F.sum("n").cast("double"))).alias("std"))


def standardize(df: DataFrame, values: str = "values", output: str = "standardized") -> DataFrame:
    """Shift and scale every number by the global mean and std; missing numbers become 0."""
    moments = global_moments(df, values).select(F.struct("mean", "std").alias("m")).scalar()
    scaled = df.withColumn("__m", moments)

    def shift(x: Column) -> Column:
        number = (x - F.col("__m.mean")) / (F.col("__m.std") + STANDARDIZE_EPSILON)
        return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(number)

    return scaled.withColumn(output, F.transform(F.col(values).cast("array<double>"), shift)).drop("__m")


def rescale(df: DataFrame, values: str = "values", slope: Column | None = None,
            intercept: Column | None = None, output: str = "rescaled") -> DataFrame:
    """``x * slope + intercept`` per number; the defaults are 1 and 0, also for NULL."""
    by = F.coalesce(slope, F.lit(1.0)) if slope is not None else F.lit(1.0)
    plus = F.coalesce(intercept, F.lit(0.0)) if intercept is not None else F.lit(0.0)
    return df.withColumn(output, F.transform(F.col(values).cast("array<double>"), lambda x: x * by + plus))


def subsample(df: DataFrame, key: Column, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows without replacement: the smallest seeded hashes of the key."""
    return (
        df.withColumn("__h", seeded_hash(key, seed)).withColumn("__k", key.cast("string"))
        .orderBy("__h", "__k").limit(size).drop("__h", "__k")
    )


def array_slice(bundle: DataFrame, name: str, index: int = 0, slice_index: int | None = None) -> DataFrame:
    """The part of an array shown as a preview; indexes are clipped into range.

    One- and two-dimensional arrays are returned whole, row by row; of a three-dimensional array
    one item; of a deeper one a single slice of that item.
    """
    chosen = bundle.where(F.col("name") == name)
    # clipped for each file by its own length; a row per file on that side
    last = chosen.groupBy("file").agg(F.max("sample_index").alias("__last"))
    item = F.greatest(F.least(F.lit(index), F.col("__last")), F.lit(0))
    deep = F.size("shape") >= 3
    picked = chosen.join(last, "file").where((F.size("shape") < 2) | (F.col("sample_index") == item))
    cut = F.greatest(F.least(F.lit(slice_index or 0), F.get("shape", F.lit(0)) - 1), F.lit(0))
    rest = F.slice("shape", 2, F.greatest(F.size("shape") - 1, F.lit(0)))
    block = F.aggregate(rest, F.lit(1), lambda total, x: total * x)
    return picked.select(
        "file", "name", "sample_index", F.when(deep, cut).alias("slice_index"),
        F.when(deep, rest).otherwise(F.col("shape")).alias("shape"),
        F.when(deep, F.slice("values", cut * block + 1, block)).otherwise(F.col("values")).alias("values"),
    )
