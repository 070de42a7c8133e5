"""Decision trees as flat arrays: prediction and exact Shapley values, in Arrow batches.

A model of any kind of trees becomes a list of ``FlatTree``; its size is that of the model, which
the driver holds anyway. Shapley values are those of the tree itself ("path dependent"): where a
feature is unknown, a split sends a row both ways, in the shares of the training rows that went there.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

LEAF = -1
# leaves times rows worked on at once
CELLS = 1 << 19


@dataclass(frozen=True)
class FlatTree:
    """Nodes by number, 0 the root. A row goes left where ``x[feature] <= threshold``.

    ``value`` has a column per output; ``cover`` is the weight of the training rows in a node.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            feature = self.feature[node]
            inside = feature != LEAF
            if not inside.any():
                return node
            left = x[rows, np.maximum(feature, 0)] <= self.threshold[node]
            node = np.where(inside, np.where(left, self.left[node], self.right[node]), node)


def predict(trees: Sequence[FlatTree], x: np.ndarray, outputs: int) -> np.ndarray:
    """Sum of the trees' values, one row per row of ``x``."""
    total = np.zeros((len(x), outputs))
    for tree in trees:
        total += tree.value[tree.leaf_of(x)]
    return total


def expected(trees: Sequence[FlatTree]) -> np.ndarray:
    """The sum of the trees' values where nothing is known of a row."""
    return sum(
        (tree.value[tree.feature == LEAF] * tree.cover[tree.feature == LEAF, None]).sum(axis=0) / tree.cover[0]
        for tree in trees)


# ---------------------------------------------------------------- Shapley values


@dataclass(frozen=True)
class _Paths:
    """Leaves whose paths ask for the same number of features: bounds, shares and values of each."""

    features: np.ndarray  # leaves x features
    low: np.ndarray  # a feature agrees with the path where low < x <= high
    high: np.ndarray
    share: np.ndarray  # of the training rows that the feature's splits let through
    value: np.ndarray  # leaves x outputs


def leaf_paths(trees: Sequence[FlatTree]) -> list[_Paths]:
    """The paths of all leaves of all trees, grouped by their number of features."""
    lots: dict[int, list[tuple]] = {}
    for tree in trees:
        waiting: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while waiting:
            node, known = waiting.pop()
            feature = int(tree.feature[node])
            if feature == LEAF:
                if known:
                    parts = list(zip(*[(f, *bounds) for f, bounds in sorted(known.items())]))
                    lots.setdefault(len(known), []).append((*parts, tree.value[node]))
                continue
            low, high, share = known.get(feature, (-math.inf, math.inf, 1.0))
            cut = float(tree.threshold[node])
            for child, bounds in ((int(tree.left[node]), (low, min(high, cut))), (int(tree.right[node]), (max(low, cut), high))):
                part = float(tree.cover[child] / tree.cover[node]) if tree.cover[node] else 0.0
                if part > 0:  # a leaf that no training row reached counts for nothing
                    waiting.append((child, {**known, feature: (*bounds, share * part)}))
    return [
        _Paths(*[np.array(part) for part in zip(*[(f, low, high, share, value) for f, low, high, share, value in leaves])])
        for _, leaves in sorted(lots.items())
    ]


def shapley_values(paths: Sequence[_Paths], x: np.ndarray, width: int, outputs: int) -> np.ndarray:
    """``rows x outputs x width``.

    A leaf's value reaches a row in the game as the product, over the features of its path, of 0 or 1
    (known: the row agrees or not) or of the share (unknown). A Shapley value is the integral over t
    of a feature's difference times the product of ``t * known + (1 - t) * share`` of the others, a
    polynomial, for which a Gauss rule with half as many points as features is exact.
    """
    total = np.zeros((len(x), outputs, width))
    for lot in paths:
        depth = lot.features.shape[1]
        points, weights = np.polynomial.legendre.leggauss(depth // 2 + 1)
        points, weights = (points + 1) / 2, weights / 2
        step = max(1, CELLS // max(1, depth * len(x)))
        for start in range(0, len(lot.features), step):
            at = slice(start, start + step)
            features, share = lot.features[at], lot.share[at]
            cells = x[:, features]  # rows x leaves x depth
            agrees = ((cells > lot.low[at]) & (cells <= lot.high[at])).astype(float)
            weight = np.zeros(agrees.shape)
            for t, w in zip(points, weights):
                factor = t * agrees + (1 - t) * share
                weight += w * factor.prod(axis=2, keepdims=True) / factor
            weight *= agrees - share
            for k in range(outputs):
                part = weight * lot.value[at][:, k][None, :, None]
                np.add.at(total[:, k, :], (slice(None), features), part)
    return total


def _explained(batches: Iterator[pa.RecordBatch], paths: list[_Paths], width: int, outputs: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
        values = shapley_values(paths, x, width, outputs).reshape(-1)
        ends = pa.array(np.arange(0, len(values) + 1, outputs * width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(values))], names=["key", "shap"])


def explain(rows: DataFrame, trees: Sequence[FlatTree], key: str, features: str, width: int) -> DataFrame:
    """``key, shap``: the Shapley values of each row, all features of the first output, then of the next."""
    outputs = trees[0].value.shape[1] if trees else 1
    paths = leaf_paths(trees)
    kind = rows.schema[key].dataType.simpleString()
    arrays = rows.select(F.col(key).alias("key"), vector_to_array(features).alias("x"))
    return arrays.mapInArrow(lambda it: _explained(it, paths, width, outputs), f"key {kind}, shap array<double>")


# ---------------------------------------------------------------- Spark's forests


def _forest_value(row, outputs: int) -> list[float]:
    if outputs == 1:
        return [row["prediction"]]
    total = sum(row["impurityStats"])
    return [v / total if total else 0.0 for v in row["impurityStats"]]


def _cut(split) -> tuple[float, bool]:
    """Threshold of a split, and whether its sides are swapped. Two categories are a cut at one half."""
    if split["numCategories"] == -1:
        return split["leftCategoriesOrThreshold"][0], False
    if split["numCategories"] > 2:
        raise ValueError("a feature with more than two categories must be one-hot encoded")
    return 0.5, list(split["leftCategoriesOrThreshold"]) == [1.0]


def forest_trees(model: Model) -> list[FlatTree]:
    """Trees of a random forest, each with its share of the forest's output.

    They come from the model's own saved form: reading node by node from the JVM takes minutes.
    """
    classes = getattr(model, "numClasses", 1) if isinstance(model, RandomForestClassificationModel) else 1
    spark = SparkSession.active()
    folder = scratch_folder(spark, "forest")
    model.write().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()
    by_tree: dict[int, dict[int, object]] = {}
    for row in nodes:
        by_tree.setdefault(row["treeID"], {})[row["id"]] = row
    trees = []
    for _, members in sorted(by_tree.items()):
        n = max(members) + 1
        feature, left, right = np.full(n, LEAF), np.zeros(n, np.int64), np.zeros(n, np.int64)
        threshold, value, cover = np.zeros(n), np.zeros((n, classes)), np.zeros(n)
        for i, row in members.items():
            value[i] = _forest_value(row, classes)
            stats = row["impurityStats"]
            cover[i] = sum(stats) if classes > 1 else stats[0]
            if row["leftChild"] >= 0:
                feature[i] = row["split"]["featureIndex"]
                threshold[i], swapped = _cut(row["split"])
                sides = row["leftChild"], row["rightChild"]
                left[i], right[i] = sides[::-1] if swapped else sides
        trees.append(FlatTree(feature, threshold, left, right, value / len(by_tree), cover))
    return trees


def flat_trees(model: Model) -> list[FlatTree] | None:
    """The trees of a model whose output is the sum of theirs, or None for other models."""
    if isinstance(model, (RandomForestClassificationModel, RandomForestRegressionModel)):
        return forest_trees(model)
    return model.flatTrees() if hasattr(model, "flatTrees") else None
