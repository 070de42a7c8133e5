"""Exact quantiles without sorting the table or holding a column in one task.

1. A mergeable sketch gives, per column and probability, a bracket sure to hold the quantile.
   It runs at once and comes back as one row per column, so a task that is run again after a
   lost executor sees the very same brackets.
2. One more pass counts values: those inside a bracket by value, those between brackets as one
   lump per gap. Only about ``4 / accuracy`` of the rows per bracket keep their own value.
3. What was counted is cut into segments of like size; segment totals give offsets and a running
   sum inside each segment finds the wanted rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.operators.lanes import empty, local_table, number_cell, numeric_cells, per_column

# A task sends a sketch of a few thousand numbers per column, so that merging the sketches of very
# many tasks stays cheap; the brackets then hold 0.4 % of the rows each, cut into segments.
ACCURACY = 1_000
SEGMENTS = 256


def _sketch(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int,
    extra: Sequence[Column], extra_schema: str,
) -> list[Row]:
    """One row per column: size, range, bracket marks and the extra measures, from one scan."""
    slack = 2.0 / accuracy
    marks = [min(1.0, max(0.0, p + side)) for p in probs for side in (-slack, slack)]
    value = F.col("value")
    measures = [
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.percentile_approx(value, F.array(*[F.lit(m) for m in marks]), F.lit(accuracy)).alias("marks"),
        *extra,
    ]
    return per_column(
        df, columns, number_cell(df), measures,
        f"column string, n bigint, least double, most double, marks array<double>{extra_schema}").collect()


def _key(intervals: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(key, gap) of a cell: its value inside an interval, else the edge below it and a mark."""
    value = F.col("value")
    inside = F.lit(False)
    edge = F.col("least")
    for low, high in intervals:
        inside = inside | value.between(F.col(low), F.col(high))
        edge = F.greatest(edge, F.when(value > F.col(high), F.col(high)))
    return F.when(inside, value).otherwise(edge), F.when(inside, 0).otherwise(1)


def _placed(keyed: DataFrame) -> DataFrame:
    """The counted keys with their ``segment``, which ascends with the key.

    Segments are cut at quantiles of the keys themselves, so each holds a like number of keys
    however the values are spread. The cuts are one array per column; Spark reuses the exchange of
    the counted keys for them, so nothing is read twice.
    """
    marks = F.array(*[F.lit(i / SEGMENTS) for i in range(1, SEGMENTS)])
    cuts = keyed.groupBy("column").agg(F.array_distinct(F.percentile_approx("key", marks, F.lit(4 * SEGMENTS))).alias("cuts"))
    segment = F.size(F.filter("cuts", lambda cut: cut < F.col("key")))
    return keyed.join(F.broadcast(cuts), "column").select("column", segment.alias("segment"), "key", "gap", "cnt")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY,
    extra: Sequence[Column] = (), extra_schema: str = "",
) -> DataFrame:
    """``(column, n, *extra, q)``: linear-interpolation quantiles, ``q[i]`` for ``probs[i]`` (ascending).

    ``q`` is NULL for a column without values. ``extra`` adds aggregates to the sketch scan, with
    ``extra_schema`` as ``", name type"`` pairs. A column with fewer values than its brackets need
    has brackets from its least to its largest value.
    """
    probs = [float(p) for p in probs]
    if sorted(probs) != probs:
        raise ValueError("probabilities must ascend")
    spark = df.sparkSession
    if not columns:
        return empty(spark, f"column string, n bigint{extra_schema}, q array<double>")
    rows = _sketch(df, columns, probs, accuracy, extra, extra_schema)
    known = {r["column"]: (r["n"], *r[5:]) for r in rows}
    nothing = (0, *[None] * len(extra))
    facts = local_table(
        spark, [(name, *known.get(name, nothing)) for name in columns], f"column string, n bigint{extra_schema}")
    bracketed = _brackets(rows, probs, accuracy)
    if bracketed:
        fences = _fences(spark, bracketed, len(probs))
        answers = _ranked(_counted(df, bracketed, fences, _names("low", "high", len(probs))), fences, probs)
    else:
        answers = empty(spark, "column string, q array<double>")
    # one row per column on both sides
    return facts.join(F.broadcast(answers), "column", "left")


def _brackets(rows: list[Row], probs: Sequence[float], accuracy: int) -> list[tuple]:
    """``(column, n, least, marks)`` of the columns that have values.

    A bracket must span at least the neighbouring ranks, so it needs more rows than marks; with
    fewer, it spans all values.
    """
    return [
        (r["column"], r["n"], r["least"], r["marks"] if r["n"] > 2 * accuracy else [r["least"], r["most"]] * len(probs))
        for r in rows if r["n"] > 0
    ]


def _names(low: str, high: str, k: int) -> list[tuple[str, str]]:
    return [(f"{low}{j}", f"{high}{j}") for j in range(k)]


def _fences(spark: SparkSession, brackets: list[tuple], k: int, extra: int = 0) -> DataFrame:
    """The intervals of each column: one row per column of the schema, safe to broadcast whatever the data size."""
    names = [name for pair in _names("low", "high", k) + _names("xlow", "xhigh", extra) for name in pair]
    rows = [(name, n, least, *marks) for name, n, least, marks in brackets]
    return F.broadcast(local_table(spark, rows, "column string, n bigint, least double" + "".join(f", {name} double" for name in names)))


def _counted(df: DataFrame, brackets: list[tuple], fences: DataFrame, intervals: Sequence[tuple[str, str]]) -> DataFrame:
    """``(column, key, gap, cnt)``: values inside an interval are counted each, those between as lumps."""
    key, gap = _key(intervals)
    return (
        numeric_cells(df, [name for name, *_ in brackets])
        .join(fences, "column")
        .select("column", key.alias("key"), gap.alias("gap"))
        .groupBy("column", "key", "gap")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def _ranked(keyed: DataFrame, fences: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``(column, q)`` from the counted keys; segments are worked out on what is left of the rows."""
    counted = _placed(keyed)
    # at most SEGMENTS rows per column
    before = Window.partitionBy("column").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.groupBy("column", "segment").agg(F.sum("cnt").alias("total"))
        .select("column", "segment", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("column", "segment").orderBy("key", "gap").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.join(F.broadcast(offsets), ["column", "segment"])
        .withColumn("upto", F.col("offset") + F.sum("cnt").over(within))
        .join(fences.select("column", "n"), "column")
    )
    picks = []
    for j, p in enumerate(probs):
        rank = F.floor(F.lit(p) * (F.col("n") - 1))
        spot = F.struct("key", "gap")
        picks.append(F.min(F.when(F.col("upto") > rank, spot)).alias(f"at{j}"))
        picks.append(F.min(F.when(F.col("upto") > rank + 1, spot)).alias(f"next{j}"))
    found = ranked.groupBy("column").agg(*picks)

    values = []
    for j, p in enumerate(probs):
        position = F.lit(p) * (F.col("n") - 1)
        low = F.col(f"at{j}.key")
        fraction = position - F.floor(position)
        # the upper neighbour only counts where the position falls between two ranks
        high = F.when(fraction > 0, F.col(f"next{j}.key"))
        outside = (F.col(f"at{j}.gap") == 1) | ((fraction > 0) & (F.col(f"next{j}.gap") == 1))
        value = F.when(high.isNull() | (high == low), low).otherwise(low + fraction * (high - low))
        missed = F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
        values.append(F.when(outside, missed).otherwise(value))
    return found.join(fences.select("column", "n"), "column").select("column", F.array(*values).alias("q"))


def quartile_outliers(
    df: DataFrame, columns: Sequence[str], factor: float, accuracy: int = ACCURACY, five: bool = False
) -> DataFrame:
    """``(column, flat, lower_bound, upper_bound, outlier_count, outlier_ratio)`` of columns with values.

    Where the quartiles lie is known from the sketch, and so is where the fences can lie. Values
    there are counted each in the pass that finds the quartiles; all others are on one side for
    sure. So the fences cost no scan of their own. ``flat``: no spread between the quartiles, which
    are the bounds then, and no outliers. ``five`` adds ``min, p25, p50, p75, max`` from the same passes.
    """
    probs = [0.25, 0.5, 0.75] if five else [0.25, 0.75]
    brackets, ranges = [], []
    sketched = _sketch(df, columns, probs, accuracy, (), "")
    most = {r["column"]: r["most"] for r in sketched}
    for name, n, least, marks in _brackets(sketched, probs, accuracy):
        a, b, c, d = marks[0], marks[1], marks[-2], marks[-1]
        around = []
        for low, high in ((a - factor * (d - a), b - factor * (c - b)), (c + factor * (c - b), d + factor * (d - a))):
            low, high = min(low, high), max(low, high)
            slack = 1e-9 * (abs(low) + abs(high) + abs(a) + abs(d))  # the fences are rounded too
            wild = not math.isfinite(low - slack) or not math.isfinite(high + slack)
            around += [-math.inf, math.inf] if wild else [low - slack, high + slack]
        brackets.append((name, n, least, [*marks, *around]))
        ranges.append((name, least, most[name]))
    shown = ["min", "p25", "p50", "p75", "max"] if five else []
    if not brackets:
        extra = "".join(f", {name} double" for name in shown)
        return empty(df.sparkSession, f"column string, flat boolean, lower_bound double, upper_bound double{extra}, outlier_count bigint, outlier_ratio double")
    k = len(probs)
    fences = _fences(df.sparkSession, brackets, k, 2)
    keyed = _counted(df, brackets, fences, _names("low", "high", k) + _names("xlow", "xhigh", 2))
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(k - 1))
    spread = F.col("q3") - F.col("q1")
    flat = (spread == 0) | F.isnan(spread)
    limits = F.broadcast(local_table(df.sparkSession, ranges, "column string, min double, max double"))  # a row per column
    bounds = _ranked(keyed, fences, probs).select("column", q1.alias("q1"), q3.alias("q3"), F.get("q", F.lit(1)).alias("p50")).join(limits, "column").select(
        "column", flat.alias("flat"),
        F.when(flat, F.col("q1")).otherwise(F.col("q1") - factor * spread).alias("lower_bound"),
        F.when(flat, F.col("q3")).otherwise(F.col("q3") + factor * spread).alias("upper_bound"),
        *[F.col({"p25": "q1", "p75": "q3"}.get(name, name)).alias(name) for name in shown],
    )
    single = F.col("gap") == 0
    below = F.when(single, F.col("key") < F.col("lower_bound")).otherwise(F.col("key") < F.col("xhigh0"))
    above = F.when(single, F.col("key") > F.col("upper_bound")).otherwise(F.col("key") >= F.col("xhigh1"))
    outside = F.sum(F.when(~F.col("flat") & (below | above), F.col("cnt")).otherwise(0))
    return (
        keyed.join(F.broadcast(bounds), "column").join(fences.select("column", "xhigh0", "xhigh1"), "column")
        .groupBy("column", "flat", "lower_bound", "upper_bound", *shown)
        .agg(outside.alias("outlier_count"), (outside / F.sum("cnt")).alias("outlier_ratio"))
    )


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10_000,
    extra: Sequence[Column] = (), extra_schema: str = "",
) -> DataFrame:
    """Same contract from one scan, with rank error ``1 / accuracy``."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    measures = [
        F.count("value").alias("n"), *extra, F.percentile_approx("value", wanted, F.lit(accuracy)).alias("q")]
    return per_column(
        df, columns, number_cell(df), measures, f"column string, n bigint{extra_schema}, q array<double>")
