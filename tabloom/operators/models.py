"""Baseline models by name, their search grids, and their importances."""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.boosting import HistogramBoosting
from tabloom.operators.forest import GrownForest
from tabloom.operators.lanes import empty, local_table

# Model names per task, their settings and their search grids.
CLASSIFIERS = ("Logistic Regression", "Random Forest", "Gradient Boosting", "XGBoost", "LightGBM")
REGRESSORS = (
    "Linear Regression", "Ridge Regression", "Random Forest Regressor", "Gradient Boosting Regressor",
    "XGBoost Regressor", "LightGBM Regressor",
)
FOREST = {"n_estimators": 80, "max_depth": None, "min_samples_leaf": 1}
BOOSTING = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3}
XGBOOST = {
    "n_estimators": 80, "max_depth": 3, "learning_rate": 0.08, "subsample": 0.9, "colsample": 0.9, "l2": 1.0,
    "min_child_weight": 1.0,
}
LIGHTGBM = {"n_estimators": 140, "learning_rate": 0.06, "num_leaves": 31, "min_child_samples": 20, "min_child_weight": 1e-3}
LOGISTIC = {"C": 1.0, "max_iter": 1000}
RIDGE = {"alpha": 1.0}

FOREST_GRID = {"n_estimators": [80, 120, 180], "max_depth": [None, 3, 5, 8], "min_samples_leaf": [1, 2, 4]}
BOOSTING_GRID = {"n_estimators": [60, 100, 140], "learning_rate": [0.03, 0.06, 0.1], "max_depth": [2, 3, 4]}
XGBOOST_GRID = {
    "n_estimators": [80, 120, 160], "max_depth": [2, 3, 4], "learning_rate": [0.03, 0.06, 0.1],
    "subsample": [0.8, 1.0],
}
LIGHTGBM_GRID = {"n_estimators": [80, 140, 200], "num_leaves": [15, 31, 63], "learning_rate": [0.03, 0.06, 0.1]}
LOGISTIC_GRID = {"C": [0.1, 0.5, 1.0, 2.0, 5.0]}
RIDGE_GRID = {"alpha": [0.1, 1.0, 5.0, 10.0]}

MOST_DEPTH = 30
MOST_LEVELS = 64  # of trees whose leaves are counted
NORMAL_SOLVER_FEATURES = 4096
FEATURES, LABEL = "features", "label"


def available_models(task: str) -> tuple[str, ...]:
    return CLASSIFIERS if task == "classification" else REGRESSORS


# ---------------------------------------------------------------- penalties that depend on the data


class PenalizedLogistic(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Logistic regression in terms of ``C``: the penalty weight is ``1 / (C * rows)``."""

    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, C=1.0, maxIter=1000):
        super().__init__()
        self._setDefault(C=1.0, maxIter=1000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> Model:
        rows = df.count()
        return LogisticRegression(
            featuresCol=FEATURES, labelCol=LABEL, maxIter=self.getOrDefault(self.maxIter),
            regParam=1.0 / (self.getOrDefault(self.C) * max(rows, 1)), elasticNetParam=0.0, standardization=False,
        ).fit(df)


class Ridge(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Ridge regression in terms of ``alpha``, the penalty on the sum of squared residuals.

    Spark scales the target by its deviation before fitting, hence the factor in ``regParam``.
    """

    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, alpha=1.0):
        super().__init__()
        self._setDefault(alpha=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> Model:
        facts = df.agg(
            F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL).alias("pop"), F.stddev_samp(LABEL).alias("samp"),
        ).first()
        width = df.schema[FEATURES].metadata.get("ml_attr", {}).get("num_attrs", 0)
        solver, spread = ("normal", facts["pop"]) if width <= NORMAL_SOLVER_FEATURES else ("l-bfgs", facts["samp"])
        return LinearRegression(
            featuresCol=FEATURES, labelCol=LABEL, solver=solver, elasticNetParam=0.0, standardization=False,
            regParam=self.getOrDefault(self.alpha) * (spread or 1.0) / max(facts["n"], 1),
        ).fit(df)


# ---------------------------------------------------------------- factory


def _depth(max_depth: int | None) -> int:
    return MOST_DEPTH if max_depth is None else max_depth


def _boosting(task: str, n_classes: int, seed: int, settings: dict[str, Any], **growth: Any) -> Estimator:
    objective = "squared" if task == "regression" else "logistic" if n_classes <= 2 else "softmax"
    return HistogramBoosting(
        objective=objective, classes=max(n_classes, 2), rounds=settings["n_estimators"], rate=settings["learning_rate"],
        seed=seed, **growth)


def make_model(task: str, name: str, seed: int = 42, n_classes: int = 2, **overrides: Any) -> Estimator:
    """Estimator of a named baseline; ``overrides`` use the names of the search grid."""
    if name not in available_models(task):
        raise ValueError(f"unknown model for {task}: {name}")
    if name == "Logistic Regression":
        settings = {**LOGISTIC, **overrides}
        return PenalizedLogistic(C=settings["C"], maxIter=settings["max_iter"])
    if name == "Linear Regression":
        return LinearRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=0.0)
    if name == "Ridge Regression":
        return Ridge(alpha={**RIDGE, **overrides}["alpha"])
    if name == "Random Forest":
        settings = {**FOREST, **overrides}
        return GrownForest(
            numTrees=settings["n_estimators"], maxDepth=_depth(settings["max_depth"]),
            minInstances=settings["min_samples_leaf"], balanced=True, seed=seed)
    if name == "Random Forest Regressor":
        settings = {**FOREST, **overrides}
        return GrownForest(
            numTrees=settings["n_estimators"], maxDepth=_depth(settings["max_depth"]),
            minInstances=settings["min_samples_leaf"], seed=seed)
    many = task == "classification" and n_classes > 2
    if name.startswith("Gradient Boosting"):
        settings = {**BOOSTING, **overrides}
        # splits by squared error on the gradients, leaf values by one Newton step
        return _boosting(
            task, n_classes, seed, settings, maxDepth=settings["max_depth"], unitGain=True,
            leafScale=(n_classes - 1) / n_classes if many else 1.0)
    if name.startswith("XGBoost"):
        settings = {**XGBOOST, **overrides}
        return _boosting(
            task, n_classes, seed, settings, maxDepth=settings["max_depth"], l2=settings["l2"], minWeight=settings["min_child_weight"],
            hessianScale=2.0 if many else 1.0, rowShare=settings["subsample"], featureShare=settings["colsample"])
    settings = {**LIGHTGBM, **overrides}
    return _boosting(
        task, n_classes, seed, settings, maxLeaves=settings["num_leaves"], maxDepth=MOST_LEVELS, minRows=settings["min_child_samples"],
        minWeight=settings["min_child_weight"], hessianScale=n_classes / (n_classes - 1) if many else 1.0)


def param_grid(name: str) -> dict[str, list[Any]]:
    for prefix, grid in (
        ("Random Forest", FOREST_GRID), ("Gradient Boosting", BOOSTING_GRID), ("XGBoost", XGBOOST_GRID),
        ("LightGBM", LIGHTGBM_GRID), ("Logistic Regression", LOGISTIC_GRID), ("Ridge Regression", RIDGE_GRID),
    ):
        if name.startswith(prefix):
            return grid
    return {}


def candidates(name: str, search_type: str, n_iter: int, seed: int) -> list[dict[str, Any]]:
    """All settings of the grid, or a seeded sample of them without replacement."""
    grid = param_grid(name)
    if not grid:
        return []
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if search_type == "grid":
        return every
    return random.Random(seed).sample(every, min(n_iter, len(every)))


# ---------------------------------------------------------------- importance


def importance_values(model: Model) -> list[float] | None:
    """Per-slot importance: tree importances, or mean absolute coefficient over classes."""
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    rows = coefficient_rows(model)
    if rows is None:
        return None
    return [sum(abs(v) for v in column) / len(rows) for column in zip(*rows)]


def coefficient_rows(model: Model) -> list[list[float]] | None:
    """Coefficients, one row per class (one row for two classes or a number)."""
    if hasattr(model, "coefficientMatrix"):
        return [[float(v) for v in row] for row in model.coefficientMatrix.toArray()]
    if hasattr(model, "coefficients"):
        return [[float(v) for v in model.coefficients.toArray()]]
    return None


IMPORTANCE_SCHEMA = "feature string, importance double"


def feature_importance(df: DataFrame, model: Model, names: Sequence[str]) -> DataFrame:
    """``(feature, importance)``, largest first; empty when the model has none."""
    values = importance_values(model)
    if values is None or len(values) != len(names):
        return empty(df.sparkSession, IMPORTANCE_SCHEMA)
    return local_table(df.sparkSession, list(zip(names, values)), IMPORTANCE_SCHEMA).orderBy(
        F.desc("importance"), "feature")
