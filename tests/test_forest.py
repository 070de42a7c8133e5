"""Forests against a plain tree on all rows, whatever is grown by passes and whatever inside tasks."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import forest
from tabloom.operators.models import make_model
from tabloom.operators.trees import predict


def vectors(spark, x, y):
    frame = spark.createDataFrame([(i, [float(v) for v in row], float(t)) for i, (row, t) in enumerate(zip(x, y))], "key long, x array<double>, label double")
    return frame.withColumn("features", array_to_vector("x"))


def some_data(seed=0, n=600):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 20, n), rng.integers(0, 2, n), rng.normal(size=n).round(1), rng.integers(0, 2, n), np.ones(n)]).astype(float)
    return x, 3 * (x[:, 0] > 9) * x[:, 1] + x[:, 2] + rng.normal(size=n) * 0.2


def plain_tree(x, y, min_rows, depth, rated):
    """Values of the rows' leaves, of a tree on all distinct values."""
    out = np.zeros((len(x), len(np.atleast_1d(rated(y)[1]))))

    def grow(rows, level):
        whole, value = rated(y[rows])
        found = None
        if level < depth and len(np.unique(y[rows])) > 1:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(left), len(right)) >= min_rows:
                        gain = rated(y[left])[0] + rated(y[right])[0] - whole
                        if gain > 1e-9 and (found is None or gain > found[0] * (1 + 1e-9)):
                            found = (gain, left, right)
        if found is None:
            out[rows] = value
            return
        grow(found[1], level + 1)
        grow(found[2], level + 1)

    grow(np.arange(len(x)), 0)
    return out


@pytest.mark.parametrize("rows_of_a_task", [10**6, 100, 1])
@pytest.mark.parametrize("min_rows, depth", [(1, None), (7, None), (1, 3)])
def test_numbers_equal_a_plain_tree(spark, monkeypatch, rows_of_a_task, min_rows, depth):
    monkeypatch.setattr(forest, "SUBTREE_ROWS", rows_of_a_task)
    x, y = some_data()
    y = y + 1000
    frame = vectors(spark, x, y)
    model = make_model("regression", "Random Forest Regressor", n_estimators=1, min_samples_leaf=min_rows, max_depth=depth).fit(frame.repartition(3))
    c = y.mean()
    want = plain_tree(x, y, min_rows, depth or 99, lambda t: ((t - c).sum() ** 2 / len(t), t.mean()))[:, 0]
    got = np.array([r[0] for r in model.transform(frame).orderBy("key").select("prediction").collect()])
    assert np.allclose(got, want)
    assert np.allclose(predict(model.flatTrees(), x, 1)[:, 0], want)
    shares = model.featureImportances.toArray()
    assert abs(shares.sum() - 1) < 1e-9 and shares[4] == 0 and min(shares) >= 0


@pytest.mark.parametrize("rows_of_a_task", [10**6, 60])
def test_classes_equal_a_plain_tree(spark, monkeypatch, rows_of_a_task):
    """All five features tried: classes weigh the same whatever their rows."""
    monkeypatch.setattr(forest, "SUBTREE_ROWS", rows_of_a_task)
    monkeypatch.setattr(forest.math, "sqrt", lambda width: width)
    x, y = some_data(1)
    label = np.digitize(y, [0, 3]).astype(float)
    weight = len(label) / (3 * np.bincount(label.astype(int)))

    def rated(t):
        heavy = np.bincount(t.astype(int), minlength=3) * weight
        return (heavy**2).sum() / heavy.sum(), heavy / heavy.sum()

    frame = vectors(spark, x, label)
    model = make_model("classification", "Random Forest", n_classes=3, n_estimators=1, max_depth=6).fit(frame)
    want = plain_tree(x, label, 1, 6, rated)
    rows = model.transform(frame).orderBy("key").select(vector_to_array("probability"), "prediction").collect()
    assert np.allclose(np.array([r[0] for r in rows]), want)
    assert [r[1] for r in rows] == [float(v) for v in want.argmax(axis=1)]
    assert np.allclose(predict(model.flatTrees(), x, 3), want)


def test_many_trees(spark, monkeypatch):
    """Trees differ by their rows and features, the same seed gives the same forest, and each row its own score."""
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 200)
    x, y = some_data(2)
    label = (y > 1).astype(float)
    frame = vectors(spark, np.concatenate([x, x[:50]]), np.concatenate([label, label[:50]])).coalesce(2)
    models = [make_model("classification", "Random Forest", n_estimators=9).fit(frame) for _ in range(2)]
    trees, again = (m.flatTrees() for m in models)
    assert all(np.array_equal(a.feature, b.feature) and np.allclose(a.value, b.value) for a, b in zip(trees, again))
    assert len(trees) == 9 and len({len(t.feature) for t in trees}) > 1
    rows = models[0].transform(frame).orderBy("key").select(vector_to_array("probability"), "prediction", "key").collect()
    assert [r["key"] for r in rows] == list(range(650))
    want = predict(trees, np.concatenate([x, x[:50]]), 2)
    assert np.allclose(np.array([r[0] for r in rows]), want)
    assert np.mean([r[1] for r in rows[:600]] == label) > 0.9
    # what the model itself holds are the upper nodes; the others are in its table
    assert len(models[0].getOrDefault("facts")) < 20_000


def test_unseen_and_equal_rows(spark):
    """Rows that never were trained on, a table of equal rows, and one without any."""
    x, y = some_data(3, 80)
    model = make_model("regression", "Random Forest Regressor", n_estimators=5).fit(vectors(spark, x, y))
    far = vectors(spark, x[:3] + 1e6, y[:3])
    assert np.allclose([r[0] for r in model.transform(far).orderBy("key").select("prediction").collect()], predict(model.flatTrees(), x[:3] + 1e6, 1)[:, 0])
    assert model.transform(far.where("key < 0")).count() == 0
    same = vectors(spark, np.ones((30, 2)), np.arange(30) % 2)
    flat = make_model("classification", "Random Forest", n_estimators=4).fit(same)
    found = flat.transform(same).agg(F.count("prediction"), F.countDistinct("prediction")).first()
    assert tuple(found) == (30, 1) and flat.featureImportances.toArray().tolist() == [0, 0]
    with pytest.raises(ValueError, match="no rows"):
        make_model("regression", "Random Forest Regressor").fit(same.where("key < 0"))
