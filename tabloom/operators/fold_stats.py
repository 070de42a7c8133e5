"""What feature preparation needs to know of each fold's complement, for all folds at once.

A fold's complement is all rows outside of it. Moments and counts of the folds are summed or merged
into those of the complements, so the table is read once for all folds and not once for each. The
same holds for medians: marks of the folds' sketches bracket every complement's median, one pass
counts the values in any bracket by fold, and each complement ranks the counts of its folds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tabloom.functions.names import column as column_ref
from tabloom.operators.lanes import COLUMNS_PER_SCAN, batches, local_table, number_cell, union_all, _unpivot
from tabloom.operators.quantiles import ACCURACY, _fences, _key, _names, _ranked

MARKS = 64
SEPARATOR = ":"
COMPLEMENT_SCHEMA = "held int, column string, n bigint, n_rows bigint, mean double, variance double, q double"


def _cells(df: DataFrame, columns: Sequence[str], fold: str) -> DataFrame:
    cell = number_cell(df)
    return _unpivot(df, {name: cell(name) for name in columns}, {"fold": column_ref(fold).cast("int")})


def _fold_sketches(df: DataFrame, columns: Sequence[str], fold: str, folds: int) -> dict[str, list[Row | None]]:
    """Per column a row for each fold, or None for a fold without rows. At most folds x columns rows."""
    value = F.col("value")
    measures = [
        F.count(value).alias("n"), F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"),
        F.min(value).alias("least"), F.max(value).alias("most"),
        F.percentile_approx(value, F.array(*[F.lit(i / MARKS) for i in range(MARKS + 1)]), F.lit(ACCURACY)).alias("marks"),
    ]
    found: dict[str, list[Row | None]] = {name: [None] * folds for name in columns}
    frames = [
        _cells(df, some, fold).groupBy("fold", "column").agg(*measures)
        for some in batches(list(columns), max(1, COLUMNS_PER_SCAN // folds))
    ]
    for row in union_all(frames).where(F.col("fold").between(0, folds - 1)).collect():
        found[row["column"]][row["fold"]] = row
    return found


def merged_moments(parts: Sequence[Row]) -> tuple[int, int, float, float]:
    """``(n, n_rows, mean, variance)`` of several folds, by Chan's rule."""
    n, n_rows, mean, squares = 0, 0, 0.0, 0.0
    for part in parts:
        n_rows += part["n_rows"]
        if part["n"]:
            together = n + part["n"]
            step = part["mean"] - mean
            squares += part["variance"] * part["n"] + step * step * n * part["n"] / together
            mean += step * part["n"] / together
            n = together
    return n, n_rows, mean, squares / n if n else 0.0


def _bracket(parts: Sequence[Row], n: int, p: float) -> tuple[float, float]:
    """Bounds that hold the values of the two ranks around ``p``, from the folds' marks.

    A mark's rank is known to a share of ``1 / ACCURACY`` of its fold; twice that is allowed for.
    """
    parts = [part for part in parts if part["n"]]
    rank = math.floor(p * (n - 1))
    slack = 2.0 / ACCURACY

    def most_upto(value: float) -> float:
        total = 0.0
        for part in parts:
            above = next((i for i, mark in enumerate(part["marks"]) if mark > value), None)
            total += part["n"] if above is None else min(part["n"], part["n"] * (above / MARKS + slack) + 1)
        return total

    def least_upto(value: float) -> float:
        total = 0.0
        for part in parts:
            at = sum(mark <= value for mark in part["marks"]) - 1
            total += max(0.0, part["n"] * (at / MARKS - slack) - 1) if at >= 0 else 0.0
            if value >= part["most"]:
                total += part["n"] - (max(0.0, part["n"] * (at / MARKS - slack) - 1) if at >= 0 else 0.0)
        return total

    candidates = sorted({mark for part in parts for mark in part["marks"]})
    low, high = min(part["least"] for part in parts), max(part["most"] for part in parts)
    # both counts grow with the value: halve the candidates
    a, b = 0, len(candidates)
    while a < b:
        mid = (a + b) // 2
        a, b = (mid + 1, b) if most_upto(candidates[mid]) <= rank else (a, mid)
    if a:
        low = candidates[a - 1]
    a, b = 0, len(candidates)
    while a < b:
        mid = (a + b) // 2
        a, b = (a, mid) if least_upto(candidates[mid]) >= rank + 2 else (mid + 1, b)
    if a < len(candidates):
        high = candidates[a]
    return low, high


def complement_quantiles(
    df: DataFrame, columns: Sequence[str], fold: str, folds: int, p: float = 0.5, moments_only: Sequence[str] = (),
) -> DataFrame:
    """``(held, column, n, n_rows, mean, variance, q)`` of the rows outside each fold: two passes in all.

    ``fold`` is a column of whole numbers from 0; ``q`` is the exact quantile ``p`` by linear
    interpolation, NULL without values and for the columns of ``moments_only``.
    """
    spark = df.sparkSession
    names = [*columns, *moments_only]
    sketches = _fold_sketches(df, names, fold, folds)
    facts, brackets, composite = [], {}, []
    for name in names:
        for held in range(folds):
            parts = [part for f, part in enumerate(sketches[name]) if part is not None and f != held]
            n, n_rows, mean, variance = merged_moments(parts)
            facts.append((held, name, n, n_rows, mean if n else None, variance if n else None))
            if n and name not in moments_only:
                low, high = _bracket(parts, n, p)
                least = min(part["least"] for part in parts if part["n"])
                brackets.setdefault(name, []).append((held, low, high))
                composite.append((f"{held}{SEPARATOR}{name}", n, least, low, high))
    known = local_table(spark, facts, "held int, column string, n bigint, n_rows bigint, mean double, variance double")
    if not composite:
        return known.select("*", F.lit(None).cast("double").alias("q"))

    # the brackets of all complements of a column, so that one pass serves them all; unused ones are empty
    every = []
    for name, marks in brackets.items():
        own = [bound for _, low, high in marks for bound in (low, high)]
        least = min(part["least"] for part in sketches[name] if part is not None and part["n"])
        every.append((name, 0, least, [*own, *[math.inf, -math.inf] * (folds - len(marks))]))
    key, gap = _key(_names("low", "high", folds))
    counted = (
        _cells(df, list(brackets), fold).where(F.col("value").isNotNull())
        .join(_fences(spark, every, folds), "column")
        .select("fold", "column", key.alias("key"), gap.alias("gap"))
        .groupBy("fold", "column", "key", "gap").agg(F.count(F.lit(1)).alias("cnt"))
    )
    fences = _fences(spark, [(name, n, least, [low, high]) for name, n, least, low, high in composite], 1)
    held = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("held")
    moved = (
        counted.select("fold", "column", "key", "gap", "cnt", held).where("held != fold")
        .select(F.concat_ws(SEPARATOR, F.col("held").cast("string"), "column").alias("column"), "key", "gap", "cnt")
        .join(fences, "column")
    )
    # seen from one complement, values of the other brackets lie below or above its own
    inside = (F.col("gap") == 0) & F.col("key").between(F.col("low0"), F.col("high0"))
    above = (F.col("key") > F.col("high0")) | ((F.col("gap") == 1) & (F.col("key") >= F.col("high0")))
    own_key = F.when(inside, F.col("key")).when(above, F.col("high0")).otherwise(F.col("least"))
    merged = moved.select("column", own_key.alias("key"), F.when(inside, 0).otherwise(1).alias("gap"), "cnt").groupBy(
        "column", "key", "gap").agg(F.sum("cnt").alias("cnt"))
    ranked = _ranked(merged, fences, [p]).select(
        F.substring_index("column", SEPARATOR, 1).cast("int").alias("held"),
        F.expr(f"substring(column, locate('{SEPARATOR}', column) + 1)").alias("column"), F.get("q", F.lit(0)).alias("q"))
    # one row per column and fold on both sides
    return known.join(F.broadcast(ranked), ["held", "column"], "left")


def complement_categories(cells: DataFrame, names: Sequence[str], fold: Column, folds: int, k: int) -> list[dict[str, dict]]:
    """For each fold, the missing and present counts and the top ``k`` values of the rows outside it: one grouped pass."""
    long = _unpivot(cells, {name: column_ref(name) for name in names}, {"fold": fold.cast("int")})
    counts = [F.count_if(F.col("fold") == f).alias(f"f{f}") for f in range(folds)]
    by_value = long.groupBy("column", "value").agg(F.count_if(F.col("fold").between(0, folds - 1)).alias("total"), *counts)
    outside = by_value.select("column", "value", F.posexplode(F.array(
        *[F.col("total") - F.col(f"f{f}") for f in range(folds)])).alias("held", "cnt")).where("cnt > 0")
    missing = F.col("value").isNull()
    totals = outside.groupBy("held", "column").agg(
        F.coalesce(F.sum(F.when(missing, F.col("cnt"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(~missing, F.col("cnt"))), F.lit(0)).alias("present"), F.count("value").alias("unique"))
    order = Window.partitionBy("held", "column").orderBy(F.desc("cnt"), F.asc("value"))
    tops = outside.where(~missing).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = [{name: {"missing": 0, "present": 0, "unique": 0, "top": []} for name in names} for _ in range(folds)]
    rows = totals.join(tops, ["held", "column"], "left").collect()  # at most folds x columns x k
    for row in sorted(rows, key=lambda r: r["rank"] or 0):
        entry = found[row["held"]][row["column"]]
        entry.update(missing=row["missing"], present=row["present"], unique=row["unique"])
        if row["value"] is not None:
            entry["top"].append((row["value"], row["cnt"]))
    return found
