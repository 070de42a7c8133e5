"""Feature preparation as ``pyspark.ml`` stages, fitted on training rows only.

Fitted state is small and lives in Params: a median, mean and deviation per numeric column, and
at most ``maxCategories`` kept values per categorical column. So stages copy and save like any
other ``pyspark.ml`` stage.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.missing import value_or_null
from tabloom.functions.names import column
from tabloom.functions.text import as_text
from tabloom.operators.fold_stats import complement_categories, complement_quantiles
from tabloom.operators.frequencies import column_counts, frequencies, most_frequent, top_values
from tabloom.operators.lanes import local_table
from tabloom.operators.quantiles import exact_quantiles

# The labels and defaults of rare-category grouping.
MISSING_CATEGORY = "__MISSING__"
OTHER_CATEGORY = "__OTHER__"
MIN_FREQUENCY = 0.01
MAX_CATEGORIES = 30


class _ColumnStage(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    def _pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.getInputCols(), self.getOutputCols()))


# ---------------------------------------------------------------- numeric columns


class _NumericParams(_ColumnStage):
    scale = Param(Params._dummy(), "scale", "standardise after imputation", TypeConverters.toBoolean)

    def getScale(self) -> bool:
        return self.getOrDefault(self.scale)


class NumericEncoder(Estimator, _NumericParams):
    """Median imputation, then optional scaling by the population deviation.

    Mean and deviation after imputation follow from the moments of the present cells and the
    median, so scaling needs no scan of its own.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, scale=True):
        super().__init__()
        self._setDefault(scale=True)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "NumericEncoderModel":
        names = self.getInputCols()

        moments = [
            F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")]
        medians = exact_quantiles(
            df, names, [0.5], extra=moments, extra_schema=", n_rows bigint, mean double, variance double")
        found = {r["column"]: r for r in medians.withColumn("median", F.get("q", F.lit(0))).collect()}
        return self.model_of([found[name] for name in names])

    def model_of(self, rows: Sequence) -> "NumericEncoderModel":
        """The model for known ``n, n_rows, mean, variance, median`` of each input column."""
        fills, means, deviations = [], [], []
        for row in rows:
            fill = row["median"] if row["n"] else 0.0
            n_rows = row["n_rows"] or 0
            gaps, total = n_rows - row["n"], max(n_rows, 1)
            mean = ((row["mean"] or 0.0) * row["n"] + fill * gaps) / total
            if row["n"]:
                spread = row["n"] * (row["variance"] + (row["mean"] - mean) ** 2) + gaps * (fill - mean) ** 2
            else:
                spread = 0.0
            fills.append(float(fill))
            means.append(float(mean))
            deviations.append(math.sqrt(spread / total) or 1.0)
        model = NumericEncoderModel()
        self._copyValues(model)
        return model._set(medians=fills, means=means, deviations=deviations)


class NumericEncoderModel(Model, _NumericParams):
    medians = Param(Params._dummy(), "medians", "fill value per column", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean per column after imputation", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "divisor per column", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = {}
        for i, (source, target) in enumerate(self._pairs()):
            number = value_or_null(df, source).try_cast("double")
            filled = F.coalesce(F.when(~F.isnan(number), number), F.lit(self.getOrDefault(self.medians)[i]))
            if self.getScale():
                filled = (filled - F.lit(self.getOrDefault(self.means)[i])) / F.lit(
                    self.getOrDefault(self.deviations)[i])
            columns[target] = filled
        return df.withColumns(columns)


# ---------------------------------------------------------------- categorical columns


def _category(df: DataFrame, name: str) -> Column:
    return as_text(value_or_null(df, name), df.schema[name].dataType)


def as_categories(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[_category(df, name).alias(name) for name in names])


def keep_categories(counts: list[tuple[str, int]], n_rows: int, min_frequency: float, max_categories: int) -> list[str]:
    """Kept values out of ``counts`` (most frequent first, cut at ``max_categories``)."""
    at_least = max(1, math.ceil(min_frequency * n_rows))
    head = counts[:max_categories]
    return [value for value, n in head if n >= at_least] or [value for value, _ in head]


def _category_counts(df: DataFrame, names: Sequence[str], k: int) -> dict[str, dict]:
    """Per column the top ``k`` present values and the missing count: one grouped pass."""
    freq = frequencies(as_categories(df, names), list(names))
    totals = column_counts(freq)
    tops = top_values(freq.where(F.col("value").isNotNull()), k)
    found = {name: {"missing": 0, "present": 0, "unique": 0, "top": []} for name in names}
    rows = totals.join(tops, "column", "left").select(
        "column", "missing_count", "present_count", "unique_count", "value", "cnt", "rank").collect()
    for row in sorted(rows, key=lambda r: r["rank"] or 0):
        entry = found[row["column"]]
        entry.update(missing=row["missing_count"], present=row["present_count"], unique=row["unique_count"])
        if row["value"] is not None:
            entry["top"].append((row["value"], row["cnt"]))
    return found


class ModeImputer(Estimator, _ColumnStage):
    """Fill missing categories with the most frequent value, the smallest on ties."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ModeImputerModel":
        names = self.getInputCols()
        found = {r["column"]: r["value"] for r in most_frequent(frequencies(as_categories(df, names), names)).collect()}
        model = ModeImputerModel()
        self._copyValues(model)
        return model._set(modes=[found.get(name, MISSING_CATEGORY) for name in names])


class ModeImputerModel(Model, _ColumnStage):
    modes = Param(Params._dummy(), "modes", "fill value per column", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        modes = self.getOrDefault(self.modes)
        return df.withColumns({
            target: F.coalesce(_category(df, source), F.lit(modes[i]))
            for i, (source, target) in enumerate(self._pairs())
        })


class _GroupingParams(_ColumnStage):
    minFrequency = Param(Params._dummy(), "minFrequency", "smallest share of a kept value", TypeConverters.toFloat)
    maxCategories = Param(Params._dummy(), "maxCategories", "kept values per column", TypeConverters.toInt)
    otherLabel = Param(Params._dummy(), "otherLabel", "label of grouped values", TypeConverters.toString)

    def _grouped(self, text: Column, keep: list[str]) -> Column:
        return F.when(text.isin(keep), text).otherwise(F.lit(self.getOrDefault(self.otherLabel)))


def _string_lists(value) -> list[list[str]]:
    return [[str(item) for item in items] for items in value]


class RareCategoryGrouper(Estimator, _GroupingParams):
    """Collapse rare and unseen values into one label; missing cells are a category."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, minFrequency=MIN_FREQUENCY,
                 maxCategories=MAX_CATEGORIES, otherLabel=OTHER_CATEGORY):
        super().__init__()
        self._setDefault(minFrequency=MIN_FREQUENCY, maxCategories=MAX_CATEGORIES, otherLabel=OTHER_CATEGORY)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "RareCategoryGrouperModel":
        names = self.getInputCols()
        limit = self.getOrDefault(self.maxCategories)
        keeps = []
        for entry in _category_counts(df, names, limit).values():
            counts = list(entry["top"])
            if entry["missing"]:
                counts.append((MISSING_CATEGORY, entry["missing"]))
                counts.sort(key=lambda pair: (-pair[1], pair[0]))
            n_rows = entry["missing"] + entry["present"]
            keeps.append(keep_categories(counts, n_rows, self.getOrDefault(self.minFrequency), limit))
        model = RareCategoryGrouperModel()
        self._copyValues(model)
        return model._set(keep=keeps)


class RareCategoryGrouperModel(Model, _GroupingParams):
    keep = Param(Params._dummy(), "keep", "kept values per column", _string_lists)

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = self.getOrDefault(self.keep)
        return df.withColumns({
            target: self._grouped(F.coalesce(_category(df, source), F.lit(MISSING_CATEGORY)), keep[i])
            for i, (source, target) in enumerate(self._pairs())
        })


class CategoryEncoder(Estimator, _GroupingParams):
    """Mode imputation, rare grouping and the level list from a single frequency pass.

    Output columns hold the grouped value. Unseen values become the other label when training
    rows had one, and an all-zero one-hot vector otherwise.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, minFrequency=MIN_FREQUENCY,
                 maxCategories=MAX_CATEGORIES, otherLabel=OTHER_CATEGORY):
        super().__init__()
        self._setDefault(minFrequency=MIN_FREQUENCY, maxCategories=MAX_CATEGORIES, otherLabel=OTHER_CATEGORY)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "CategoryEncoderModel":
        entries = _category_counts(df, self.getInputCols(), max(self.getOrDefault(self.maxCategories), 1))
        return self.model_of(list(entries.values()))

    def model_of(self, entries: Sequence[dict]) -> "CategoryEncoderModel":
        """The model for known ``missing`` and ``present`` counts and ``top`` values of each input column."""
        limit = self.getOrDefault(self.maxCategories)
        modes, keeps, levels = [], [], []
        for entry in entries:
            n_rows = entry["missing"] + entry["present"]
            top = entry["top"] or [(MISSING_CATEGORY, 0)]
            mode, present = top[0]
            counts = [(mode, present + entry["missing"]), *top[1:]]
            keep = keep_categories(counts, n_rows, self.getOrDefault(self.minFrequency), limit)
            covered = sum(n for value, n in counts if value in set(keep))
            other = [self.getOrDefault(self.otherLabel)] if covered < n_rows else []
            modes.append(mode)
            keeps.append(keep)
            levels.append(sorted({*keep, *other}))
        model = CategoryEncoderModel()
        self._copyValues(model)
        return model._set(modes=modes, keep=keeps, levels=levels)


class CategoryEncoderModel(Model, _GroupingParams):
    modes = Param(Params._dummy(), "modes", "fill value per column", TypeConverters.toListString)
    keep = Param(Params._dummy(), "keep", "kept values per column", _string_lists)
    levels = Param(Params._dummy(), "levels", "levels seen in training per column", _string_lists)

    def _transform(self, df: DataFrame) -> DataFrame:
        modes, keep = self.getOrDefault(self.modes), self.getOrDefault(self.keep)
        return df.withColumns({
            target: self._grouped(F.coalesce(_category(df, source), F.lit(modes[i])), keep[i])
            for i, (source, target) in enumerate(self._pairs())
        })

    def getLevels(self) -> list[list[str]]:
        return self.getOrDefault(self.levels)


class CategoryOneHot(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """All levels, alphabetical; an unknown level is a zero vector. ``levels`` come from the encoder."""

    levels = Param(Params._dummy(), "levels", "levels per column", _string_lists)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, levels=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        names = self.getInputCols()
        indexes = [f"__index_{name}" for name in names]
        indexers = PipelineModel([
            StringIndexerModel.from_labels(levels, name, index, handleInvalid="keep")
            for levels, name, index in zip(self.getOrDefault(self.levels), names, indexes)
        ])
        # the sizes are in the column metadata: fitting runs no job
        encoder = OneHotEncoder(inputCols=indexes, outputCols=self.getOutputCols(), dropLast=True)
        return PipelineModel([indexers, encoder.fit(indexers.transform(df)), _Drop(columns=indexes)])


class _Drop(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    columns = Param(Params._dummy(), "columns", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getOrDefault(self.columns))


# ---------------------------------------------------------------- the whole preprocessor


class TablePreprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric columns ++ one-hot categories as a sparse ``features`` vector; others are dropped from it."""

    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)
    scale = Param(Params._dummy(), "scale", "standardise numeric columns", TypeConverters.toBoolean)
    minFrequency = Param(Params._dummy(), "minFrequency", "smallest share of a kept value", TypeConverters.toFloat)
    maxCategories = Param(Params._dummy(), "maxCategories", "kept values per column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numeric=None, categorical=None, scale=True, minFrequency=MIN_FREQUENCY,
                 maxCategories=MAX_CATEGORIES):
        super().__init__()
        self._setDefault(numeric=[], categorical=[], scale=True, minFrequency=MIN_FREQUENCY, maxCategories=MAX_CATEGORIES)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        numbers, texts = self._encoders()
        return self._assembled(df, numbers.fit(df) if numbers else None, texts.fit(df) if texts else None)

    def fit_folds(self, df: DataFrame, fold: str, folds: int) -> list[PipelineModel]:
        """For each of the folds 0, 1, ... the preprocessor that ``fit`` gives for all rows outside of it.

        Numbers take two passes over the table and categories one, however many folds there are.
        """
        numbers, texts = self._encoders()
        numeric: list = [None] * folds
        categorical: list = [None] * folds
        if numbers:
            names = numbers.getInputCols()
            found = complement_quantiles(df, names, fold, folds).withColumnRenamed("q", "median").collect()
            rows = {(r["held"], r["column"]): r for r in found}
            numeric = [numbers.model_of([rows[held, name] for name in names]) for held in range(folds)]
        if texts:
            names, limit = texts.getInputCols(), max(self.getOrDefault(self.maxCategories), 1)
            cells = df.select(*[_category(df, name).alias(name) for name in names], column(fold).alias("__fold"))
            counted = complement_categories(cells, names, F.col("__fold"), folds, limit)
            categorical = [texts.model_of([entries[name] for name in names]) for entries in counted]
        return [self._assembled(df, n, t) for n, t in zip(numeric, categorical)]

    def _encoders(self) -> tuple["NumericEncoder | None", "CategoryEncoder | None"]:
        numeric, categorical = self.getOrDefault(self.numeric), self.getOrDefault(self.categorical)
        if not numeric and not categorical:
            raise ValueError("no feature columns: keep at least one numeric or categorical column")
        numbers = NumericEncoder(
            inputCols=numeric, outputCols=[f"__num_{i}" for i in range(len(numeric))], scale=self.getOrDefault(self.scale))
        texts = CategoryEncoder(
            inputCols=categorical, outputCols=[f"__cat_{i}" for i in range(len(categorical))],
            minFrequency=self.getOrDefault(self.minFrequency), maxCategories=self.getOrDefault(self.maxCategories))
        return numbers if numeric else None, texts if categorical else None

    def _assembled(self, df: DataFrame, numbers: Model | None, texts: Model | None) -> PipelineModel:
        stages, parts, scratch = [], [], []
        if numbers is not None:
            stages.append(numbers)
            parts += numbers.getOutputCols()
        if texts is not None:
            grouped = texts.getOutputCols()
            hot = [f"__hot_{i}" for i in range(len(grouped))]
            one_hot = CategoryOneHot(inputCols=grouped, outputCols=hot, levels=texts.getLevels())
            stages += [texts, one_hot.fit(texts.transform(df))]
            parts += hot
            scratch += grouped
        # names without dots or blanks, so the assembler takes any table
        stages += [VectorAssembler(inputCols=parts, outputCol="features"), _Drop(columns=parts + scratch)]
        return PipelineModel(stages)


def feature_slots(preprocessor: PipelineModel) -> list[tuple[int, str, str, str | None]]:
    """``(slot, feature, source_column, level)`` of a fitted preprocessor, in vector order."""
    slots: list[tuple[int, str, str, str | None]] = []
    for stage in preprocessor.stages:
        if isinstance(stage, NumericEncoderModel):
            for name in stage.getInputCols():
                slots.append((len(slots), name, name, None))
        elif isinstance(stage, CategoryEncoderModel):
            for name, levels in zip(stage.getInputCols(), stage.getLevels()):
                for level in levels:
                    slots.append((len(slots), f"{name}_{level}", name, level))
    return slots


def feature_names(df: DataFrame, preprocessor: PipelineModel) -> DataFrame:
    return local_table(
        df.sparkSession, feature_slots(preprocessor), "slot int, feature string, source_column string, level string")


# ---------------------------------------------------------------- labels


def label_classes(df: DataFrame, label: str) -> list[str]:
    """Sorted class names as text; a model holds weights for each of them on the driver anyway."""
    names = df.select(_category(df, label).alias("y")).where(F.col("y").isNotNull()).distinct()
    return sorted(row["y"] for row in names.collect())


def encode_labels(df: DataFrame, label: str, classes: Sequence[str], output: str = "label") -> DataFrame:
    """Add the position of the class in ``classes`` as a double; unseen classes become NULL."""
    text = df.withColumn("__class", _category(df, label))
    model = StringIndexerModel.from_labels(list(classes), "__class", "__label", handleInvalid="keep")
    seen = F.when(F.col("__label") < len(classes), F.col("__label"))
    return model.transform(text).withColumn(output, seen).drop("__class", "__label")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, cnt, weight)`` with balanced weights: rows / (classes * rows of the class)."""
    counts = df.select(_category(df, label).alias("label")).where(F.col("label").isNotNull()).groupBy("label").agg(
        F.count(F.lit(1)).alias("cnt"))
    totals = counts.agg(F.struct(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).select("t").scalar()
    return counts.withColumn("t", totals).select(
        "label", "cnt", (F.col("t.n") / (F.col("t.k") * F.col("cnt").cast("double"))).alias("weight"))


def one_hot_long(df: DataFrame, keys: Sequence[str], grouped: Sequence[str]) -> DataFrame:
    """``(keys, column, level)``: the non-zero entries of a one-hot matrix."""
    entries = F.array(*[F.struct(F.lit(name).alias("column"), column(name).alias("level")) for name in grouped])
    return df.select(*keys, F.inline(entries))
