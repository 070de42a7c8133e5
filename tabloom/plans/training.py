"""Train, search, cross-validate and score one baseline model on a table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.hashing import row_key
from tabloom.functions.missing import value_or_null
from tabloom.functions.names import column
from tabloom.functions.numbers import is_numeric, to_number
from tabloom.operators import evaluate, gram, splits
from tabloom.operators.features import (
    MAX_CATEGORIES, MIN_FREQUENCY, TablePreprocessor, encode_labels, feature_slots, label_classes,
)
from tabloom.operators.lanes import local_table, together, union_all
from tabloom.operators.models import (
    FEATURES, LABEL, RIDGE, available_models, candidates, feature_importance, make_model,
)
from tabloom.operators.quality import MIN_USABLE_ROWS, target_gate
from tabloom.operators.roles import roles_by_kind

SEARCH_SCHEMA = "rank_test_score int, mean_test_score double, std_test_score double, params string"
SEARCH_TOP = 20
LINEAR_REGRESSORS = ("Linear Regression", "Ridge Regression")
KEY, TEST, FOLD, STRATUM, SHARES = "__key", "is_test", "fold", "__stratum", "__shares"
# Names that training gives to columns of its own; a column of the table is renamed if it has one.
OWN_NAMES = frozenset((
    "features", "label", "weight", "prediction", "probability", "rawprediction", "centred", "candidate", TEST, FOLD,
    "y_true", "y_pred", "score", "positive_class_probability",
))


@dataclass(frozen=True)
class ModelConfig:
    """Settings of one training run. Field names and defaults, as saved configurations have them."""

    target_col: str
    task_type: str
    model_name: str
    test_size: float = 0.2
    random_state: int = 42
    scale_numeric: bool = True
    exclude_datetime: bool = True
    rare_min_frequency: float = MIN_FREQUENCY
    rare_max_categories: int = MAX_CATEGORIES
    use_cv: bool = False
    cv_folds: int = 5
    use_search: bool = False
    search_type: str = "random"
    n_iter: int = 12

    def __post_init__(self) -> None:
        if self.task_type not in ("classification", "regression"):
            raise ValueError("task_type must be classification or regression")
        if self.model_name not in available_models(self.task_type):
            raise ValueError(f"unknown model for {self.task_type}: {self.model_name}")
        if self.search_type not in ("grid", "random"):
            raise ValueError("search_type must be grid or random")
        if self.rare_max_categories < 1 or not 0 <= self.rare_min_frequency <= 1:
            raise ValueError("rare categories: keep at least one, with a frequency in 0..1")

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


@dataclass(frozen=True)
class Prepared:
    """Rows fit for training, with ``label`` and a row key; ``rows`` is lazy.

    Features named like a column of the training's own go by another name here; ``original`` has
    the table's name for each of those.
    """

    rows: DataFrame
    numeric: list[str]
    categorical: list[str]
    classes: list[str]
    usable_rows: int
    dropped_rows: int
    original: dict[str, str] = field(default_factory=dict)

    def name(self, feature: str) -> str:
        return self.original.get(feature, feature)


@dataclass
class TrainResult:
    model: PipelineModel
    metrics: DataFrame
    predictions: DataFrame
    importance: DataFrame
    task_type: str
    model_name: str
    numeric_features: list[str]
    categorical_features: list[str]
    feature_names: list[str]
    dropped_rows: int
    test_rows: DataFrame
    label_classes: list[str] = field(default_factory=list)
    confusion: DataFrame | None = None
    cv_summary: DataFrame | None = None
    search_summary: DataFrame | None = None
    best_params: dict[str, Any] | None = None
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Free the cached split and scores; the result's tables stay usable and are computed anew."""
        for table in self.cached:
            table.unpersist()

    @property
    def used_features(self) -> list[str]:
        return self.numeric_features + self.categorical_features


def prepare(
    df: DataFrame, config: ModelConfig, key: Column | None = None, features: Sequence[str] | None = None
) -> Prepared:
    """Check the target, drop rows without it, pick features and encode the label.

    ``features`` narrows the choice to some columns, by default all but the target are considered.

    ``key`` identifies a row for splits and folds; by default equal rows share a key, so a copy
    of a training row never lands in the test set.
    """
    target = config.target_col
    gate = target_gate(df, target).first()
    if not gate["ok"]:
        raise ValueError(gate["message"])
    renamed = _own_names_avoided(df.columns, target)
    keyed = df.select(
        *[column(c).alias(renamed.get(c, c)) for c in df.columns], (row_key(df) if key is None else key).cast("string").alias(KEY))
    clean = keyed.where(value_or_null(keyed, target).isNotNull())
    offered = [c for c in clean.columns if c not in (target, KEY)]
    if features is not None:
        wanted = {renamed.get(c, c) for c in features}
        offered = [c for c in offered if c in wanted]
    kinds = roles_by_kind(clean.select(*[column(c) for c in offered]))
    numeric, categorical = kinds["numeric"], kinds["categorical"]
    if config.exclude_datetime:
        dates = set(kinds["datetime"])
        numeric = [c for c in numeric if c not in dates]
        categorical = [c for c in categorical if c not in dates]
    classes: list[str] = []
    usable = gate["usable_rows"]
    if config.task_type == "classification":
        classes = label_classes(clean, target)
        rows = encode_labels(clean, target, classes, LABEL)
    else:
        rows = clean.withColumn(LABEL, to_number(column(target))).where(F.col(LABEL).isNotNull())
        if not is_numeric(df.schema[target].dataType):  # a number that isn't missing is one
            usable = rows.count()
        if usable < MIN_USABLE_ROWS:
            raise ValueError("fewer than 10 rows are left with a numeric target")
    return Prepared(rows, numeric, categorical, classes, usable, gate["n_rows"] - usable, {new: old for old, new in renamed.items()})


def _own_names_avoided(columns: Sequence[str], target: str) -> dict[str, str]:
    """New names for columns named like one of the training's own, which it would overwrite."""
    taken, renamed = {c.lower() for c in columns}, {}
    for name in columns:
        if name != target and (name.lower() in OWN_NAMES or name.startswith("__")):
            new = f"{name.lstrip('_')}_feature"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            renamed[name] = new
    return renamed


def split(prepared: Prepared, config: ModelConfig, exact: bool = False) -> DataFrame:
    """Rows with ``is_test``, by a hash of their key: without a shuffle, close to the share asked for.

    ``exact`` gives each class its rounded share, for a shuffle of the rows.
    """
    rows = prepared.rows
    if not exact:
        return splits.hash_split(rows, F.col(KEY), config.test_size, config.random_state)
    stratum = F.col(LABEL) if prepared.classes else F.lit(0.0)
    return splits.stratified_split(
        rows.withColumn(STRATUM, stratum), STRATUM, F.col(KEY), config.test_size, config.random_state).drop(STRATUM)


def with_folds(rows: DataFrame, prepared: Prepared, folds: int, seed: int, exact: bool = False) -> DataFrame:
    """Rows with ``fold``, by a hash of their key, or evenly for each class if ``exact``."""
    if not exact:
        return splits.hash_folds(rows, F.col(KEY), folds, seed + 1)
    stratum = F.col(LABEL) if prepared.classes else F.lit(0.0)
    return splits.stratified_folds(
        rows.withColumn(STRATUM, stratum), STRATUM, F.col(KEY), folds, seed + 1).drop(STRATUM)


def preprocessor(prepared: Prepared, config: ModelConfig) -> TablePreprocessor:
    return TablePreprocessor(
        numeric=prepared.numeric, categorical=prepared.categorical, scale=config.scale_numeric,
        minFrequency=config.rare_min_frequency, maxCategories=config.rare_max_categories)


def _estimator(config: ModelConfig, classes: Sequence[str], params: dict[str, Any]) -> Estimator:
    return make_model(config.task_type, config.model_name, config.random_state, len(classes), **params)


def _as_predictions(scored: DataFrame, classes: Sequence[str], extra: Sequence[str] = (), with_shares: bool = False) -> DataFrame:
    """``(y_true, y_pred [, score])`` as text for classes, as numbers otherwise.

    ``with_shares`` adds the probabilities of several classes as an array.
    """
    if not classes:
        return scored.select(*extra, F.col(LABEL).alias("y_true"), F.col("prediction").alias("y_pred"))
    names = F.array(*[F.lit(name) for name in classes])
    columns = [
        F.get(names, F.col(LABEL).cast("int")).alias("y_true"),
        F.get(names, F.col("prediction").cast("int")).alias("y_pred"),
    ]
    if len(classes) == 2 and "probability" in scored.columns:
        columns.append(F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
    elif with_shares and "probability" in scored.columns:
        columns.append(vector_to_array("probability").alias(SHARES))
    return scored.select(*extra, *columns)


def _scores(predictions: DataFrame, task: str, by: str) -> dict[int, float]:
    """The score that ranks candidates, for each value of ``by``."""
    if task == "classification":
        metrics, wanted = evaluate.classification_metrics(predictions, [by]), "f1_weighted"
    else:
        metrics, wanted = evaluate.regression_metrics(predictions, [by]), "r2"
    return {row[by]: row["value"] for row in metrics.where(F.col("metric") == wanted).collect()}


def search(
    train: DataFrame, prepared: Prepared, config: ModelConfig, folds: int, parallelism: int = 2
) -> tuple[DataFrame, dict[str, Any]] | None:
    """Rank the candidate settings by their mean score over the folds.

    The preprocessors of all folds are fitted in shared passes. A linear regression needs one more
    pass for all folds and penalties; other models are fitted per fold and candidate, on prepared
    rows that stay cached for that time.
    """
    settings = candidates(config.model_name, config.search_type, config.n_iter, config.random_state)
    if not settings:
        return None
    if config.model_name in LINEAR_REGRESSORS:
        linear = LinearFolds(train, prepared, config, folds)
        scores = [linear.r_squared(params) for params in settings]
    else:
        scores = _fold_scores(train, prepared, config, folds, settings, parallelism)
    means = [sum(values) / len(values) for values in scores]
    deviations = [
        (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 for values, mean in zip(scores, means)]
    ranks = [1 + sum(other > mean for other in means) for mean in means]
    rows = sorted(
        (rank, mean, deviation, json.dumps(params, sort_keys=True))
        for rank, mean, deviation, params in zip(ranks, means, deviations, settings))
    best = settings[ranks.index(1)]
    table = local_table(train.sparkSession, rows[:SEARCH_TOP], SEARCH_SCHEMA).orderBy("rank_test_score", "params")
    return table, best


def _fold_scores(
    train: DataFrame, prepared: Prepared, config: ModelConfig, folds: int, settings: list[dict[str, Any]], parallelism: int
) -> list[list[float]]:
    """Each candidate's score on each fold: a fit per fold and candidate, one scoring job per fold."""
    scores: list[list[float]] = [[] for _ in settings]
    for number, fitted in enumerate(preprocessor(prepared, config).fit_folds(train, FOLD, folds)):
        fitting, holding = train.where(F.col(FOLD) != number), train.where(F.col(FOLD) == number)
        inside = fitted.transform(fitting).select(FEATURES, LABEL).persist(StorageLevel.MEMORY_AND_DISK)
        outside = fitted.transform(holding).select(FEATURES, LABEL).persist(StorageLevel.MEMORY_AND_DISK)

        with ThreadPool(parallelism) as pool:
            models = pool.map(lambda params: _estimator(config, prepared.classes, params).fit(inside), settings)
        # one job scores all candidates of the fold
        scored = union_all([
            _as_predictions(model.transform(outside), prepared.classes).select(
                F.lit(i).alias("candidate"), "y_true", "y_pred")
            for i, model in enumerate(models)
        ])
        found = _scores(scored, config.task_type, "candidate")
        for i in range(len(settings)):
            scores[i].append(found[i])
        inside.unpersist()
        outside.unpersist()
    return scores


class LinearFolds:
    """Linear regressions on the complements of all folds, from one matrix of products per fold."""

    def __init__(self, rows: DataFrame, prepared: Prepared, config: ModelConfig, folds: int) -> None:
        self.rows, self.ridge = rows, config.model_name == "Ridge Regression"
        fitted = preprocessor(prepared, config).fit_folds(rows, FOLD, folds)
        label = rows.agg(F.avg(LABEL).alias("mean"), F.stddev_pop(LABEL).alias("spread")).first()
        self.base = gram.common_base(fitted, (label["mean"], label["spread"]))
        self.maps = [gram.feature_map(self.base, model) for model in fitted]
        self.products = gram.fold_products(rows, self.base, FOLD)

    def models(self, params: dict[str, Any]) -> dict[int, gram.Linear]:
        """By fold, the model of all other folds; folds without rows have none."""
        alpha = {**RIDGE, **params}["alpha"] if self.ridge else 0.0
        total = sum(self.products.values())
        return {
            f: gram.solve(total - own, self.base, self.maps[f], alpha)
            for f, own in sorted(self.products.items()) if total[0, 0] > own[0, 0]
        }

    def r_squared(self, params: dict[str, Any]) -> list[float]:
        return [gram.r_squared(self.products[f], model) for f, model in self.models(params).items()]

    def mean_absolute_errors(self, params: dict[str, Any]) -> list[float]:
        models = self.models(params)
        errors = gram.absolute_errors(self.rows, self.base, FOLD, models)
        return [errors[f] / self.products[f][0, 0] for f in models]


def cross_validate(
    rows: DataFrame, prepared: Prepared, config: ModelConfig, folds: int, params: dict[str, Any]
) -> DataFrame:
    """``(metric, mean, std)`` over the folds of ``rows``.

    The preprocessors of all folds share their passes, and linear regressions share theirs too;
    other models are fitted fold by fold, with one job for all metrics.
    """
    if config.model_name in LINEAR_REGRESSORS:
        linear = LinearFolds(rows, prepared, config, folds)
        values = [("r2", v) for v in linear.r_squared(params)]
        values += [("mean_absolute_error", v) for v in linear.mean_absolute_errors(params)]
        return evaluate.summarize_folds(local_table(rows.sparkSession, values, "metric string, value double"))
    held = []
    for number, fitted in enumerate(preprocessor(prepared, config).fit_folds(rows, FOLD, folds)):
        fitting, holding = rows.where(F.col(FOLD) != number), rows.where(F.col(FOLD) == number)
        model = _estimator(config, prepared.classes, params).fit(fitted.transform(fitting).select(FEATURES, LABEL))
        held.append(_as_predictions(model.transform(fitted.transform(holding)), prepared.classes, [FOLD]))
    everything = union_all(held)
    if config.task_type == "classification":
        metrics = evaluate.classification_metrics(everything, [FOLD]).where(
            F.col("metric").isin("accuracy", "f1_weighted"))
    else:
        metrics = evaluate.regression_metrics(everything, [FOLD]).where(
            F.col("metric").isin("r2", "mae")).withColumn(
            "metric", F.when(F.col("metric") == "mae", "mean_absolute_error").otherwise(F.col("metric")))
    return evaluate.summarize_folds(metrics)


def _fit(train: DataFrame, prepared: Prepared, config: ModelConfig, params: dict[str, Any]) -> PipelineModel:
    fitted = preprocessor(prepared, config).fit(train)
    features = fitted.transform(train).select(FEATURES, LABEL)
    return PipelineModel([fitted, _estimator(config, prepared.classes, params).fit(features)])


def _fold_count(rows: DataFrame, config: ModelConfig) -> int:
    return splits.safe_folds(rows, LABEL, config.cv_folds, config.task_type).first()["folds"]


def train_model(
    df: DataFrame, config: ModelConfig, key: Column | None = None, exact_split: bool = False,
    parallelism: int = 2, cache: bool = True, features: Sequence[str] | None = None,
) -> TrainResult:
    """Prepare, split, fit (with search when asked), score on the test rows, cross-validate.

    ``cache`` keeps the prepared rows and the scores in memory and on the executors' disks until
    ``release()``; without it they are computed wherever they are needed.
    """
    prepared = prepare(df, config, key, features)
    rows = split(prepared, config, exact_split)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK) if cache else rows
    train, test = rows.where(~F.col(TEST)), rows.where(F.col(TEST))
    folds = _fold_count(train, config) if config.use_search or config.use_cv else 0

    search_summary, best = None, None
    if config.use_search:
        found = search(
            with_folds(train, prepared, folds, config.random_state, exact_split), prepared, config, folds, parallelism)
        if found:
            search_summary, best = found

    def validated() -> DataFrame | None:
        if not config.use_cv:
            return None
        folded = with_folds(rows, prepared, folds, config.random_state, exact_split)
        summary = cross_validate(folded, prepared, config, folds, best or {})
        return local_table(df.sparkSession, summary.collect(), "metric string, mean double, std double")

    model, cv_summary = together(lambda: _fit(train, prepared, config, best or {}), validated)

    used = prepared.numeric + prepared.categorical
    raw = _as_predictions(model.transform(test), prepared.classes, [column(c) for c in used], with_shares=True)
    raw = raw.persist(StorageLevel.MEMORY_AND_DISK) if cache else raw  # metrics, confusion and table share the scores
    named = [c for c in ("y_true", "y_pred", "score") if c in raw.columns]
    # a feature named like one of the result's columns keeps its other name there
    shown = [column(c).alias(c if prepared.name(c).lower() in OWN_NAMES else prepared.name(c)) for c in used]
    shares = [
        F.get(SHARES, F.lit(i)).alias(f"probability_{name}") for i, name in enumerate(prepared.classes)] if SHARES in raw.columns else []
    predictions = raw.select(
        *[F.col(c).alias("positive_class_probability" if c == "score" else c) for c in named], *shares, *shown)
    compared = raw.select(*named)
    positive = prepared.classes[1] if len(prepared.classes) == 2 else None
    names = [
        prepared.name(source) if level is None else f"{prepared.name(source)}_{level}"
        for _, _, source, level in feature_slots(model.stages[0])
    ]
    fitted: Model = model.stages[-1]
    return TrainResult(
        model=model,
        metrics=evaluate.metrics_table(compared, config.task_type, positive),
        predictions=predictions,
        importance=feature_importance(df, fitted, names),
        task_type=config.task_type, model_name=config.model_name,
        numeric_features=[prepared.name(c) for c in prepared.numeric],
        categorical_features=[prepared.name(c) for c in prepared.categorical], feature_names=names,
        dropped_rows=prepared.dropped_rows,
        test_rows=model.stages[0].transform(test).select(KEY, FEATURES, LABEL),
        label_classes=prepared.classes,
        confusion=evaluate.confusion(compared, prepared.classes) if prepared.classes else None,
        cv_summary=cv_summary, search_summary=search_summary, best_params=best, cached=[rows, raw] if cache else [],
    )
