"""Linear regression over folds from one matrix of products per fold.

Whatever preprocessor was fitted on a fold's complement, its features are linear in a common base: a
one, each number and whether it is missing, and an indicator of each category that any fold keeps.
The products of the base, summed by fold in one pass, so give every complement's normal equations
by addition, for any penalty, and every fold's squared error as well. Only absolute errors need the
rows again: one more pass, in which each row is scored by its own fold's model.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.missing import value_or_null
from tabloom.operators.features import CategoryEncoderModel, NumericEncoderModel, _category
from tabloom.operators.models import LABEL

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

# directions that carry less than this share of the largest are taken as none
RANK_TOLERANCE = 1e-11


@dataclass(frozen=True)
class Base:
    """The common base: numbers with their centre and spread, and known categories."""

    numeric: list[str]
    centre: np.ndarray
    spread: np.ndarray
    categorical: list[str]
    known: list[list[str]]
    label_centre: float
    label_spread: float

    @property
    def width(self) -> int:
        """One, two for a number, one for a category, and for a column's other and missing values."""
        return 1 + 2 * len(self.numeric) + sum(len(k) + 2 for k in self.known)


def _stage(model: PipelineModel, kind: type):
    return next((s for s in model.stages if isinstance(s, kind)), None)


def common_base(fitted: Sequence[PipelineModel], label: tuple[float, float]) -> Base:
    """The base of some preprocessors; ``label``: a centre and a spread, any that come near will do."""
    numbers = [_stage(m, NumericEncoderModel) for m in fitted]
    texts = [_stage(m, CategoryEncoderModel) for m in fitted]
    numeric, centre, spread, categorical, known = [], np.zeros(0), np.zeros(0), [], []
    if numbers[0] is not None:
        first = numbers[0]
        numeric = list(first.getInputCols())
        centre, spread = np.array(first.getOrDefault(first.means)), np.array(first.getOrDefault(first.deviations))
    if texts[0] is not None:
        categorical = list(texts[0].getInputCols())
        for j in range(len(categorical)):
            values = {v for t in texts for v in [*t.getOrDefault(t.keep)[j], t.getOrDefault(t.modes)[j]]}
            known.append(sorted(values))
    return Base(numeric, centre, spread, categorical, known, label[0] or 0.0, label[1] or 1.0)


def feature_map(base: Base, fitted: PipelineModel) -> np.ndarray:
    """The preprocessor as a matrix: its features are this times the base."""
    rows = []
    numbers, texts = _stage(fitted, NumericEncoderModel), _stage(fitted, CategoryEncoderModel)
    if numbers is not None:
        state = [numbers.getOrDefault(p) for p in (numbers.medians, numbers.means, numbers.deviations)]
        for j, (median, mean, deviation) in enumerate(zip(*state)):
            shift, scale = (mean, deviation) if numbers.getScale() else (0.0, 1.0)
            row = np.zeros(base.width)
            row[0] = (base.centre[j] - shift) / scale
            row[1 + 2 * j] = base.spread[j] / scale
            row[2 + 2 * j] = (median - base.centre[j]) / scale  # a missing number has 0 above
            rows.append(row)
    at = 1 + 2 * len(base.numeric)
    if texts is not None:
        other = texts.getOrDefault(texts.otherLabel)
        for j, levels in enumerate(texts.getLevels()):
            keep, mode = set(texts.getOrDefault(texts.keep)[j]), texts.getOrDefault(texts.modes)[j]
            sources = [*base.known[j], None, mode]  # None: a value that no fold keeps
            meant = [s if s in keep else other for s in sources]
            for level in levels:
                row = np.zeros(base.width)
                row[at : at + len(meant)] = [m == level for m in meant]
                rows.append(row)
            at += len(meant)
    return np.array(rows)


def _arranged(rows: DataFrame, base: Base, fold: str) -> DataFrame:
    """``fold, y, numbers, codes``: a code is the place of a category, or that of other or missing values."""
    numbers = [value_or_null(rows, c).try_cast("double") for c in base.numeric]
    numbers = [F.when(~F.isnan(x), x) for x in numbers]
    codes = []
    for name, known in zip(base.categorical, base.known):
        text = _category(rows, name)
        place = F.array_position(F.array(*[F.lit(v) for v in known]), text) - 1
        codes.append(F.when(text.isNull(), len(known) + 1).when(place < 0, len(known)).otherwise(place).cast("int"))
    return rows.select(
        F.col(fold).cast("int").alias("fold"), F.col(LABEL).alias("y"),
        F.array(*numbers).cast("array<double>").alias("numbers"), F.array(*codes).cast("array<int>").alias("codes"))


def _base_rows(batch: pa.RecordBatch, base: Base) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fold, label and base of a batch's rows; the base ends with the label, centred and scaled."""
    n = batch.num_rows
    out = np.zeros((n, base.width + 1))
    out[:, 0] = 1
    at = 1
    if base.numeric:
        cells = batch.column("numbers").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        missing = np.isnan(cells)
        out[:, 1 : 1 + 2 * len(base.numeric) : 2] = np.where(missing, 0.0, (cells - base.centre) / base.spread)
        out[:, 2 : 2 + 2 * len(base.numeric) : 2] = missing
        at += 2 * len(base.numeric)
    if base.categorical:
        codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        for j, known in enumerate(base.known):
            out[np.arange(n), at + codes[:, j]] = 1
            at += len(known) + 2
    y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
    out[:, -1] = (y - base.label_centre) / base.label_spread
    return batch.column("fold").to_numpy(zero_copy_only=False), y, out


def _products(batches: Iterator[pa.RecordBatch], base: Base) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            fold, _, rows = _base_rows(batch, base)
            for f in np.unique(fold).tolist():
                mine = rows[fold == f]
                sums[f] = sums.get(f, 0) + mine.T @ mine
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["fold", "products"])


def fold_products(rows: DataFrame, base: Base, fold: str) -> dict[int, np.ndarray]:
    """Products of the base and the label, summed by fold: one matrix per fold, whatever the rows."""
    size = base.width + 1

    def added(a: dict, b: dict) -> dict:
        return {f: a.get(f, 0) + b.get(f, 0) for f in {*a, *b}}

    parts = _arranged(rows, base, fold).mapInArrow(lambda it: _products(it, base), "fold int, products binary").rdd.map(
        lambda r: {r["fold"]: np.frombuffer(r["products"]).reshape(size, size)})
    # matrices are added up among the tasks; an empty table gives none
    return parts.treeAggregate({}, added, added)


@dataclass(frozen=True)
class Linear:
    """Coefficients on the features of one preprocessor, and what they are on the base."""

    coefficients: np.ndarray
    intercept: float
    on_base: np.ndarray


def solve(products: np.ndarray, base: Base, mapping: np.ndarray, alpha: float) -> Linear:
    """Least squares with ``alpha`` times the squared coefficients added, the intercept free."""
    whole = np.zeros((len(mapping) + 2, len(products)))  # one, features, label
    whole[0, 0] = whole[-1, -1] = 1
    whole[1:-1, :-1] = mapping
    moments = whole @ products @ whole.T
    n, sums = moments[0, 0], moments[0, 1:]
    centred = moments[1:, 1:] - np.outer(sums, sums) / n
    inner, outer = centred[:-1, :-1], centred[:-1, -1]
    if alpha > 0:
        w = np.linalg.solve(inner + alpha * np.eye(len(inner)), outer)
    else:
        w = np.linalg.pinv(inner, rcond=RANK_TOLERANCE, hermitian=True) @ outer
    intercept = (sums[-1] - w @ sums[:-1]) / n
    on_base = mapping.T @ w
    on_base[0] += intercept
    return Linear(w * base.label_spread, float(intercept * base.label_spread + base.label_centre), on_base)


def r_squared(products: np.ndarray, linear: Linear) -> float:
    """On the rows of ``products``; a constant label scores 1 when it is met exactly and 0 otherwise."""
    residual = np.append(-linear.on_base, 1.0)
    error = max(float(residual @ products @ residual), 0.0)
    spread = float(products[-1, -1] - products[0, -1] ** 2 / products[0, 0])
    if spread <= 1e-12 * float(products[-1, -1]):
        return 1.0 if error <= 1e-12 * max(float(products[-1, -1]), 1.0) else 0.0
    return 1 - error / spread


def _errors(batches: Iterator[pa.RecordBatch], base: Base, by_fold: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            fold, _, rows = _base_rows(batch, base)
            total = {f: float(np.abs(rows[fold == f] @ np.append(-by_fold[f], 1.0)).sum()) for f in np.unique(fold).tolist()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], names=["fold", "error"])


def absolute_errors(rows: DataFrame, base: Base, fold: str, models: dict[int, Linear]) -> dict[int, float]:
    """Sum of absolute errors of each fold's rows under that fold's model."""
    on_base = {f: m.on_base for f, m in models.items()}
    errors = _arranged(rows, base, fold).mapInArrow(lambda it: _errors(it, base, on_base), "fold int, error double")
    found = errors.groupBy("fold").agg(F.sum("error").alias("error")).collect()  # one row per fold
    return {r["fold"]: r["error"] * base.label_spread for r in found}
