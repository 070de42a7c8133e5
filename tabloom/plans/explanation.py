"""Mean absolute Shapley value per feature of a trained model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.arrays import subsample
from tabloom.operators.lanes import empty, local_table
from tabloom.operators.models import FEATURES, coefficient_rows
from tabloom.operators.trees import FlatTree, explain, flat_trees
from tabloom.plans.training import KEY, TrainResult
from tabloom.session import cut_lineage

SHAP_SCHEMA = "feature string, mean_abs_shap double"
# Fixed value: rows explained by default.
DEFAULT_SAMPLES = 120
PERMUTATIONS = 8


def linear_shapley(rows: DataFrame, coefficients: Sequence[Sequence[float]], names: Sequence[str]) -> DataFrame:
    """Exact values of a linear model: mean of ``|w (x - mean x)|`` over all rows.

    Two aggregates over the vectors; the class axis is averaged.
    """
    centred = StandardScaler(inputCol=FEATURES, outputCol="centred", withMean=True, withStd=False).fit(rows)
    summary = centred.transform(rows).select(
        Summarizer.metrics("normL1", "count").summary(F.col("centred")).alias("s")
    ).select("s.normL1", "s.count").first()
    weights = [sum(abs(row[j]) for row in coefficients) / len(coefficients) for j in range(len(names))]
    values = [
        (name, float(weight * total / summary["count"]))
        for name, weight, total in zip(names, weights, summary["normL1"].toArray())
    ]
    return local_table(rows.sparkSession, values, SHAP_SCHEMA).orderBy(F.desc("mean_abs_shap"), "feature")


def sampled_shapley(
    rows: DataFrame, model: Model, names: Sequence[str], max_samples: int = DEFAULT_SAMPLES,
    permutations: int = PERMUTATIONS, seed: int = 42,
) -> DataFrame:
    """Permutation-sampled values for any model, on ``max_samples`` rows.

    ``rows`` holds ``(key, features)``. For each row and permutation the features of a background
    row are replaced one by one; what a step changes in the output belongs to its feature. All
    steps are scored by one ``model.transform``; their number is bounded by the settings:
    ``max_samples * permutations * (features + 1)``.
    """
    if max_samples < 1:
        raise ValueError("max_samples must be 1 or more")
    width = len(names)
    drawn = cut_lineage(subsample(rows, F.col(KEY), max_samples, seed).select(KEY, vector_to_array(FEATURES).alias("x")))
    # max_samples rows from here, the caller's choice
    order = Window.orderBy(F.xxhash64(F.lit(seed), KEY), KEY)
    numbered = drawn.select((F.row_number().over(order) - 1).alias("row"), "x")
    size = numbered.agg(F.count(F.lit(1))).scalar()
    partner = F.pmod(F.xxhash64(F.lit(seed), "row", "permutation"), F.col("size"))
    walks = (
        numbered.select("row", "x", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("permutation"))
        .withColumn("size", size).withColumn("partner", partner.cast("int"))
        .join(F.broadcast(numbered.select(F.col("row").alias("partner"), F.col("x").alias("background"))), "partner")
    )
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    spread = walks.repartition(parallel, "row", "permutation")
    shuffled = F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda j: F.struct(F.xxhash64(F.lit(seed), F.col("row"), F.col("permutation"), j).alias("h"), j.alias("j"))))
    arranged = spread.withColumn("order", F.transform(shuffled, lambda item: item["j"])).withColumn(
        "place", F.transform(
            F.array_sort(F.transform("order", lambda j, t: F.struct(j.alias("j"), t.alias("t")))),
            lambda item: item["t"]))
    steps = arranged.select(
        "row", "permutation", "order", "place", "x", "background",
        F.explode(F.sequence(F.lit(0), F.lit(width))).alias("step"))
    mixed = F.transform("x", lambda value, j: F.when(F.get("place", j) < F.col("step"), value).otherwise(
        F.get("background", j)))
    scored = model.transform(steps.select(
        "row", "permutation", "step", F.get("order", F.col("step") - 1).alias("slot"),
        array_to_vector(mixed).alias(FEATURES)))
    output = next((name for name in ("probability", "rawPrediction") if name in scored.columns), None)
    outputs = vector_to_array(output) if output else F.array(F.col("prediction"))
    walk = Window.partitionBy("row", "permutation").orderBy("step")
    changes = scored.select("row", "permutation", "step", "slot", outputs.alias("f")).withColumn(
        "before", F.lag("f").over(walk)).where(F.col("step") > 0)
    parts = changes.select("row", "slot", F.posexplode(F.zip_with("f", "before", lambda a, b: a - b)).alias("class", "change"))
    per_row = parts.groupBy("row", "slot", "class").agg(F.avg("change").alias("value"))
    feature = F.get(F.array(*[F.lit(name) for name in names]), F.col("slot"))
    return per_row.groupBy("slot").agg(F.avg(F.abs("value")).alias("mean_abs_shap")).select(
        feature.alias("feature"), "mean_abs_shap").orderBy(F.desc("mean_abs_shap"), "feature")


def tree_shapley(
    rows: DataFrame, trees: Sequence[FlatTree], names: Sequence[str], max_samples: int = DEFAULT_SAMPLES, seed: int = 42,
) -> DataFrame:
    """Exact values of a model of trees on ``max_samples`` rows ``(key, features)``, averaged over rows and outputs."""
    if max_samples < 1:
        raise ValueError("max_samples must be 1 or more")
    if not trees:
        return empty(rows.sparkSession, SHAP_SCHEMA)
    width, parallel = len(names), rows.sparkSession.sparkContext.defaultParallelism
    drawn = subsample(rows, F.col(KEY), max_samples, seed).select(KEY, FEATURES).repartition(parallel, KEY)
    values = explain(drawn, trees, KEY, FEATURES, width).select(F.posexplode("shap").alias("place", "value"))
    feature = F.get(F.array(*[F.lit(name) for name in names]), F.col("slot"))
    return values.groupBy((F.col("place") % width).alias("slot")).agg(F.avg(F.abs("value")).alias("mean_abs_shap")).select(
        feature.alias("feature"), "mean_abs_shap").orderBy(F.desc("mean_abs_shap"), "feature")


def shapley_importance(result: TrainResult, max_samples: int = DEFAULT_SAMPLES, seed: int = 42) -> DataFrame:
    """``(feature, mean_abs_shap)`` of a training result, on its test rows.

    Exact for linear models on all rows and for trees on ``max_samples`` rows; sampled for others.
    """
    model = result.model.stages[-1]
    coefficients = coefficient_rows(model)
    if coefficients is not None:
        return linear_shapley(result.test_rows, coefficients, result.feature_names)
    trees = flat_trees(model)
    if trees is not None:
        return tree_shapley(result.test_rows, trees, result.feature_names, max_samples, seed)
    return sampled_shapley(result.test_rows, model, result.feature_names, max_samples, seed=seed)
