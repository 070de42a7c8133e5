"""Boosting against plain numpy versions, Shapley values against their definition, folds against separate fits."""

import itertools
import math
import pickle

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabloom.operators import boosting, gram
from tabloom.operators.features import TablePreprocessor
from tabloom.operators.fold_stats import complement_categories, complement_quantiles
from tabloom.operators.models import make_model
from tabloom.operators.trees import FlatTree, expected, explain, flat_trees, leaf_paths, predict, shapley_values
from tabloom.plans.training import ModelConfig, train_model


def vectors(spark, x, y):
    frame = spark.createDataFrame([(i, [float(v) for v in row], float(t)) for i, (row, t) in enumerate(zip(x, y))], "key long, x array<double>, label double")
    return frame.withColumn("features", array_to_vector("x"))


def some_data(seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 20, n), rng.integers(0, 2, n), rng.normal(size=n).round(1), rng.integers(0, 5, n)]).astype(float)
    y = 3 * (x[:, 0] > 9) * x[:, 1] + x[:, 2] + rng.normal(size=n) * 0.2
    return x, y


# ---------------------------------------------------------------- plain boosting


def plain_boosting(x, g_of, outputs, start, rounds, rate, grow, l2, min_weight, min_rows, unit, scale=1.0):
    """Trees on all distinct values, without histograms; returns the scores of the rows."""
    scores = np.repeat(np.array(start, float)[:, None], len(x), axis=1)

    def best(rows, g, h):
        def rated(some):
            return g[some].sum() ** 2 / ((len(some) if unit else h[some].sum()) + l2)

        found = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(left), len(right)) >= min_rows and min(h[left].sum(), h[right].sum()) >= min_weight:
                    gain = rated(left) + rated(right) - rated(rows)
                    if gain > 1e-9 and (found is None or gain > found[0] * (1 + 1e-9)):
                        found = (gain, left, right)
        return found

    for _ in range(rounds):
        g_all, h_all = g_of(scores)
        for k in range(outputs):
            g, h = g_all[k], h_all[k]
            leaves = [(0, np.arange(len(x)))]
            if grow[0] == "depth":
                for _ in range(grow[1]):
                    fresh = []
                    for level, rows in leaves:
                        found = best(rows, g, h)
                        fresh += [(level, rows)] if found is None else [(level + 1, found[1]), (level + 1, found[2])]
                    leaves = fresh
            else:
                while len(leaves) < grow[1]:
                    options = [(found[0], i, found) for i, (_, rows) in enumerate(leaves) if (found := best(rows, g, h))]
                    if not options:
                        break
                    _, i, found = max(options, key=lambda o: o[0])
                    leaves[i : i + 1] = [(0, found[1]), (0, found[2])]
            for _, rows in leaves:
                scores[k, rows] -= rate * scale * g[rows].sum() / (h[rows].sum() + l2)
    return scores


def squared(y):
    return lambda s: (s - y, np.ones_like(s))


def logistic(y):
    def g_of(s):
        p = 1 / (1 + np.exp(-s))
        return p - y, p * (1 - p)

    return g_of


def multi(y, scale):
    def g_of(s):
        p = np.exp(s) / np.exp(s).sum(axis=0)
        return p - (np.arange(len(s))[:, None] == y), scale * p * (1 - p)

    return g_of


def fitted_scores(spark, model, x, y):
    return predict(model.flatTrees(), x, len(model.getOrDefault(model.start))).T + np.array(model.getOrDefault(model.start))[:, None]


def test_second_order_by_level_equals_plain(spark):
    x, y = some_data()
    model = make_model("regression", "XGBoost Regressor", n_estimators=4, subsample=1.0, colsample=1.0).fit(vectors(spark, x, y).repartition(3))
    want = plain_boosting(x, squared(y), 1, [y.mean()], 4, 0.08, ("depth", 3), 1.0, 1.0, 1, False)
    assert np.allclose(fitted_scores(spark, model, x, y), want)
    label = (y > 1).astype(float)
    model = make_model("classification", "XGBoost", n_estimators=4, subsample=1.0, colsample=1.0).fit(vectors(spark, x, label))
    p = label.mean()
    want = plain_boosting(x, logistic(label), 1, [math.log(p / (1 - p))], 4, 0.08, ("depth", 3), 1.0, 1.0, 1, False)
    assert np.allclose(fitted_scores(spark, model, x, label), want)


@pytest.mark.parametrize("leaves", [2, 3, 7, 12])
def test_best_leaf_first_equals_plain(spark, leaves):
    x, y = some_data(1)
    model = make_model("regression", "LightGBM Regressor", n_estimators=2, num_leaves=leaves).fit(vectors(spark, x, y).repartition(2))
    want = plain_boosting(x, squared(y), 1, [y.mean()], 2, 0.06, ("leaves", leaves), 0.0, 1e-3, 20, False)
    assert np.allclose(fitted_scores(spark, model, x, y), want)
    assert max(model.leafCounts) <= leaves


def test_softmax_equals_plain_and_sums_to_one(spark):
    x, y = some_data(2)
    label = np.digitize(y, [0, 2]).astype(float)
    frame = vectors(spark, x, label)
    model = make_model("classification", "Gradient Boosting", n_classes=3, n_estimators=3).fit(frame)
    start = [math.log((label == k).mean()) for k in range(3)]
    want = plain_boosting(x, multi(label, 1.0), 3, start, 3, 0.1, ("depth", 3), 0.0, 0.0, 1, True, 2 / 3)
    assert np.allclose(fitted_scores(spark, model, x, label), want)
    rows = model.transform(frame).orderBy("key").select(vector_to_array("probability").alias("p"), "prediction").collect()
    p = np.array([r["p"] for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p, boosting.softmax(want).T)
    assert [r["prediction"] for r in rows] == p.argmax(axis=1).tolist()
    assert (p.argmax(axis=1) == label).mean() > 0.6


@pytest.mark.parametrize("name", ["XGBoost", "LightGBM", "Gradient Boosting"])
def test_many_tasks_give_the_trees_of_one(spark, monkeypatch, name):
    x, y = some_data(10)
    label = np.digitize(y, [0, 2]).astype(float)
    frame = vectors(spark, x, label).repartition(6).sortWithinPartitions("key")
    settings = {} if name != "XGBoost" else {"subsample": 1.0}
    alone = make_model("classification", name, n_classes=3, n_estimators=12, **settings).fit(frame)
    monkeypatch.setattr(boosting, "CELLS_PER_TASK", 800)
    many = make_model("classification", name, n_classes=3, n_estimators=12, **settings).fit(frame)
    for one, other in zip(alone._stored(), many._stored(), strict=True):
        assert one["feature"] == other["feature"] and one["threshold"] == other["threshold"]
        assert np.allclose(one["value"], other["value"]) and one["cover"] == other["cover"]


def test_cells_of_some_tasks_are_grown_in_a_single_job(spark, monkeypatch):
    x, y = some_data(13)
    frame = vectors(spark, x, y).repartition(6).sortWithinPartitions("key")
    alone = make_model("regression", "LightGBM Regressor", n_estimators=12).fit(frame)
    monkeypatch.setattr(boosting, "CELLS_PER_TASK", 1600)  # three tasks' cells
    monkeypatch.setattr(boosting, "Spread", None)  # which takes a job for each pass
    many = make_model("regression", "LightGBM Regressor", n_estimators=12).fit(frame)
    for one, other in zip(alone._stored(), many._stored(), strict=True):
        assert one["feature"] == other["feature"] and one["threshold"] == other["threshold"]
        assert np.allclose(one["value"], other["value"]) and one["cover"] == other["cover"]


def test_few_input_partitions_are_dealt_to_more_tasks(spark, monkeypatch):
    x, y = some_data(15)
    frame = vectors(spark, x, y).coalesce(1).sortWithinPartitions("key")
    alone = make_model("regression", "LightGBM Regressor", n_estimators=2).fit(frame)
    tasks = []

    class Seen(boosting.Spread):
        def __init__(self, blocks):
            tasks.append(blocks.getNumPartitions())
            super().__init__(blocks)

    monkeypatch.setattr(boosting, "Spread", Seen)
    monkeypatch.setattr(boosting, "CELLS_PER_TASK", 1600)
    monkeypatch.setattr(boosting, "TASKS_IN_ONE", 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        many = make_model("regression", "LightGBM Regressor", n_estimators=2).fit(frame)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert tasks == [3]
    for one, other in zip(alone._stored(), many._stored(), strict=True):
        assert one["feature"] == other["feature"] and one["threshold"] == other["threshold"] and one["cover"] == other["cover"]


def test_the_rest_of_a_parents_sums_is_what_the_larger_child_has(monkeypatch):
    rng = np.random.default_rng(14)
    x, y = one_hot(14, 900)
    y = np.where(rng.random(900) < 0.05, 1e9, 1e-3 * y)  # beside such targets the rest would be rounding
    bins, sizes = x.astype(np.uint8).T.copy(), np.array([30] + [2] * 6)
    plan = boosting.Plan("squared", 1.0, 6, 0.06, 64, 12, boosting.Rules(min_rows=20, min_weight=1e-3), 1.0, 1.0, sizes, 1, 42)
    summed, grown = [], []
    of = boosting.Parted.of
    monkeypatch.setattr(boosting.Parted, "of", lambda self, nodes: summed.append(nodes) or of(self, nodes))
    for kept in (1 << 24, 0):  # none kept: all children are summed
        monkeypatch.setattr(boosting, "MOST_KEPT", kept)
        blocks = list(boosting._joined(iter([(bins, y, 0)]), np.array([y.mean()]), sizes))
        grown.append([tree for done in boosting.grow(boosting.Local(blocks), plan) for tree, _, _ in done])
        summed.append(None)
    first = summed.index(None)
    assert sum(map(len, summed[:first])) < 0.8 * sum(map(len, summed[first + 1 : -1]))
    for one, other in zip(*grown, strict=True):
        assert one.feature == other.feature and one.cut == other.cut and np.allclose(one.value, other.value, rtol=1e-9)


def one_hot(seed, n=300):
    rng = np.random.default_rng(seed)
    level = rng.integers(0, 6, n)
    x = np.column_stack([rng.integers(0, 30, n), *[level == i for i in range(6)]]).astype(float)
    return x, x[:, 0] / 10 + 2.0 * (level == 3) - (level == 5) + rng.normal(size=n) * 0.1


def test_one_hot_levels_in_many_small_pieces_equal_plain(spark):
    x, y = one_hot(11)
    frame = vectors(spark, x, y).repartition(12)
    model = make_model("regression", "LightGBM Regressor", n_estimators=3, num_leaves=6).fit(frame)
    want = plain_boosting(x, squared(y), 1, [y.mean()], 3, 0.06, ("leaves", 6), 0.0, 1e-3, 20, False)
    assert np.allclose(fitted_scores(spark, model, x, y), want)


def test_sums_take_only_the_bins_there_are_and_stay_in_the_tasks(spark):
    x, y = one_hot(12)
    bins, sizes = x.astype(np.uint8).T.copy(), np.array([30] + [2] * 6)
    layout = boosting.Layout(list(range(7)), sizes)
    assert layout.width == 30 + 2 * 6
    pieces = [(bins[:, i : i + 25], y[i : i + 25], i) for i in range(0, 300, 25)]
    blocks = list(boosting._joined(iter(pieces), np.zeros(1), sizes))
    assert len(blocks) == 1 and len(blocks[0].pieces) == 12
    args = ([(0, 0)], layout, boosting.Rules(), "squared", 1.0, [], [boosting.BinnedTree.stump()], [(0, 0)], layout, 1.0, 1, 0)
    alone = boosting.Local(blocks).splits(*args)
    parts = [b for i in range(0, 12, 4) for b in boosting._joined(iter(pieces[i : i + 4]), np.zeros(1), sizes)]
    many = boosting.Spread(spark.sparkContext.parallelize(parts, 3)).splits(*args)
    for (total, split), (other, same) in zip(alone, many, strict=True):
        assert np.allclose(total, other) and total[2] == 300 and (split.feature, split.cut) == (same.feature, same.cut)
        assert np.allclose(split.left, same.left) and len(pickle.dumps((other, same))) < 1000


def test_scores_are_kept_across_refreshes(spark):
    x, y = some_data(3, 120)
    model = make_model("regression", "Gradient Boosting Regressor", n_estimators=23, max_depth=2).fit(vectors(spark, x, y))
    want = plain_boosting(x, squared(y), 1, [y.mean()], 23, 0.1, ("depth", 2), 0.0, 0.0, 1, True)
    assert np.allclose(fitted_scores(spark, model, x, y), want)


def test_samples_are_the_same_again(spark, tmp_path):
    x, y = some_data(4)
    frame = vectors(spark, x, y)
    first, second = (make_model("regression", "XGBoost Regressor", n_estimators=5).fit(frame) for _ in range(2))
    assert first.getOrDefault(first.trees) == second.getOrDefault(second.trees)
    other = make_model("regression", "XGBoost Regressor", 7, n_estimators=5).fit(frame)
    assert first.getOrDefault(first.trees) != other.getOrDefault(other.trees)
    first.write().overwrite().save(str(tmp_path / "model"))
    loaded = boosting.HistogramBoostingModel.load(str(tmp_path / "model"))
    assert [r[0] for r in loaded.transform(frame).select("prediction").collect()] == [r[0] for r in first.transform(frame).select("prediction").collect()]


def test_nothing_to_learn(spark):
    x = np.zeros((30, 2))
    constant = make_model("regression", "LightGBM Regressor").fit(vectors(spark, x, np.full(30, 2.5)))
    assert constant.leafCounts == [1] and not constant.featureImportances.toArray().any()
    assert {r[0] for r in constant.transform(vectors(spark, x, x[:, 0])).select("prediction").collect()} == {2.5}
    one = make_model("classification", "XGBoost").fit(vectors(spark, some_data()[0][:30], np.ones(30)))
    assert one.transform(vectors(spark, some_data()[0][:30], np.ones(30))).where("prediction != 1").isEmpty()


def test_wide_quantile_bins(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 1))
    edges = boosting.bin_edges(vectors(spark, x, x[:, 0]).select("x"), 1)[0]
    counts = np.bincount(np.searchsorted(edges, x[:, 0], side="left"))
    assert len(edges) == 255 and counts.max() <= 3 * 3000 / 256


def test_several_classes_have_probabilities_in_training(spark):
    x, y = some_data(6)
    rows = [(i, float(a), float(b), "abc"[int(np.digitize(t, [0, 2]))]) for i, ((a, b, *_), t) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows, "key long, a double, b double, kind string")
    result = train_model(frame, ModelConfig("kind", "classification", "Gradient Boosting"), F.col("key"), features=["a", "b"])
    named = [f"probability_{c}" for c in "abc"]
    shares = result.predictions.select(*named).collect()
    assert shares and all(abs(sum(r) - 1) < 1e-9 for r in shares)
    assert {r["metric"]: r["value"] for r in result.metrics.collect()}["accuracy"] > 0.5


# ---------------------------------------------------------------- Shapley values


def game(tree, x, known):
    """Expected value of a tree where only some features are known."""

    def walk(node):
        f = tree.feature[node]
        if f == -1:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return walk(left if x[f] <= tree.threshold[node] else right)
        return (tree.cover[left] * walk(left) + tree.cover[right] * walk(right)) / tree.cover[node]

    return walk(0)


def by_definition(trees, x, width):
    values = []
    for f in range(width):
        others = [o for o in range(width) if o != f]
        total = 0.0
        for size in range(width):
            weight = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
            for some in itertools.combinations(others, size):
                total = total + weight * sum(game(t, x, {*some, f}) - game(t, x, set(some)) for t in trees)
        values.append(total)
    return np.array(values)


def test_tree_values_follow_the_definition(spark):
    x, y = some_data(7)
    model = make_model("regression", "LightGBM Regressor", n_estimators=3, num_leaves=9).fit(vectors(spark, x, y))
    trees = model.flatTrees()
    got = shapley_values(leaf_paths(trees), x[:12], 4, 1)[:, 0, :]
    for i in range(12):
        assert np.allclose(got[i], by_definition(trees, x[i], 4)[:, 0])
    assert np.allclose(got.sum(axis=1) + expected(trees)[0], predict(trees, x[:12], 1)[:, 0])


@pytest.mark.parametrize("depth", [1, 3, 12])
def test_forest_values_add_up(spark, depth):
    x, y = some_data(8)
    label = np.digitize(y, [0, 2]).astype(float)
    frame = vectors(spark, x, label)
    for forest, outputs, out in (
        (RandomForestClassifier(numTrees=7, maxDepth=depth, seed=3), 3, vector_to_array("probability")),
        (RandomForestRegressor(numTrees=7, maxDepth=depth, seed=3), 1, F.array("prediction")),
    ):
        model = forest.fit(frame)
        trees = flat_trees(model)
        want = np.array([r[0] for r in model.transform(frame).orderBy("key").select(out).collect()])
        assert np.allclose(predict(trees, x, outputs), want)
        rows = explain(frame, trees, "key", "features", 4).orderBy("key").collect()
        values = np.array([r["shap"] for r in rows]).reshape(len(x), outputs, 4)
        assert np.abs(values.sum(axis=2) + expected(trees) - want).max() < 1e-6
    assert np.allclose(values[0, 0], by_definition(trees, x[0], 4)[:, 0])


def test_repeated_features_and_unreached_leaves():
    tree = FlatTree(
        np.array([0, 0, -1, -1, -1]), np.array([5.0, 2.0, 0, 0, 0]), np.array([1, 3, 0, 0, 0]), np.array([2, 4, 0, 0, 0]),
        np.array([[0.0], [0], [3], [1], [9]]), np.array([10.0, 6, 4, 6, 0]))
    x = np.array([[1.0, 0], [4.0, 0], [7.0, 0]])
    got = shapley_values(leaf_paths([tree]), x, 2, 1)[:, 0, :]
    assert np.allclose(got[[0, 2], 0], [1 - 1.8, 3 - 1.8]) and not got[:, 1].any()


# ---------------------------------------------------------------- folds


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        a = None if i % 11 == 0 else float(rng.normal() * 10 ** rng.integers(0, 4))
        b = float(rng.integers(0, 3))
        c = None if i % 13 == 0 else rng.choice(["p", "q", "r", "s"], p=[0.6, 0.3, 0.08, 0.02])
        fold = int(rng.integers(0, 4)) if i % 5 else 0
        rows.append((i, a, b, c, 2.0 * (a or 1.0) + b + (c == "q") + float(rng.normal()), fold))
    return spark.createDataFrame(rows, "key long, a double, b double, c string, label double, fold int").repartition(5)


def test_complement_medians_and_moments(spark, folded):
    rows = folded.toPandas()
    got = {(r["held"], r["column"]): r for r in complement_quantiles(folded, ["a", "b"], "fold", 4, moments_only=["label"]).collect()}
    for held in range(4):
        outside = rows[rows["fold"] != held]
        for name in ("a", "b", "label"):
            r = got[held, name]
            assert (r["n"], r["n_rows"]) == (outside[name].count(), len(outside))
            assert r["mean"] == pytest.approx(outside[name].mean()) and r["variance"] == pytest.approx(outside[name].var(ddof=0))
            assert r["q"] is None if name == "label" else r["q"] == pytest.approx(outside[name].median(), rel=1e-12)


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.93, 1.0])
def test_complement_quantiles_of_odd_columns(spark, p):
    rng = np.random.default_rng(3)
    values = {
        "heavy": rng.pareto(0.7, 2600), "ties": rng.integers(0, 2, 2600).astype(float), "shifted": np.arange(2600) * 1.0,
        "rare": np.where(np.arange(2600) % 900 == 0, 1.0, np.nan),
    }
    fold = np.where(np.arange(2600) < 1500, 0, 1 + np.arange(2600) % 3)  # the shifted column differs by fold
    rows = [(int(f), *[None if np.isnan(values[c][i]) else float(values[c][i]) for c in values]) for i, f in enumerate(fold)]
    frame = spark.createDataFrame(rows, "fold int, heavy double, ties double, shifted double, rare double").repartition(3)
    got = {(r["held"], r["column"]): r["q"] for r in complement_quantiles(frame, list(values), "fold", 5, p).collect()}
    for held in range(5):
        for name, column in values.items():
            outside = column[(fold != held) & ~np.isnan(column)]
            want = np.quantile(outside, p) if len(outside) else None
            assert got[held, name] == (None if want is None else pytest.approx(want, rel=1e-12)), (held, name)


def test_complement_categories(spark, folded):
    found = complement_categories(folded.select("c", "fold"), ["c"], F.col("fold"), 4, 2)
    rows = folded.toPandas()
    for held, entry in enumerate(found):
        outside = rows[rows["fold"] != held]["c"]
        counts = outside.value_counts()
        assert entry["c"]["missing"] == outside.isna().sum() and entry["c"]["present"] == outside.count()
        assert entry["c"]["top"] == [(v, n) for v, n in counts.items()][:2]


def test_fold_preprocessors_equal_single_fits(spark, folded):
    stage = TablePreprocessor(numeric=["a", "b"], categorical=["c"], minFrequency=0.05)
    together = stage.fit_folds(folded, "fold", 4)
    for held, model in enumerate(together):
        alone = stage.fit(folded.where(F.col("fold") != held))
        for one, other in zip(model.stages[:2], alone.stages[:2]):
            for param in one.params:
                if param.name in ("medians", "means", "deviations"):
                    assert one.getOrDefault(param) == pytest.approx(other.getOrDefault(param.name), rel=1e-9)
                elif param.name in ("keep", "modes", "levels"):
                    assert one.getOrDefault(param) == other.getOrDefault(param.name)


@pytest.mark.parametrize("alpha", [0.0, 0.5, 10.0])
@pytest.mark.parametrize("scale", [True, False])
def test_products_give_the_models_of_all_folds(spark, folded, alpha, scale):
    stage = TablePreprocessor(numeric=["a", "b"], categorical=["c"], minFrequency=0.05, scale=scale)
    fitted = stage.fit_folds(folded, "fold", 4)
    base = gram.common_base(fitted, (0.0, 1.0))
    products = gram.fold_products(folded, base, "fold")
    models = {f: gram.solve(sum(products.values()) - products[f], base, gram.feature_map(base, fitted[f]), alpha) for f in products}
    errors = gram.absolute_errors(folded, base, "fold", models)
    for f in range(4):
        def arrays(rows):
            pairs = fitted[f].transform(rows).select(vector_to_array("features").alias("x"), "label").collect()
            return np.array([p["x"] for p in pairs]), np.array([p["label"] for p in pairs])

        (x, y), (hx, hy) = arrays(folded.where(F.col("fold") != f)), arrays(folded.where(F.col("fold") == f))
        xc, yc = x - x.mean(axis=0), y - y.mean()
        w = np.linalg.lstsq(np.vstack([xc, math.sqrt(alpha) * np.eye(x.shape[1])]), np.append(yc, np.zeros(x.shape[1])), rcond=1e-9)[0]
        guess = y.mean() + (hx - x.mean(axis=0)) @ w
        assert gram.r_squared(products[f], models[f]) == pytest.approx(1 - ((hy - guess) ** 2).sum() / ((hy - hy.mean()) ** 2).sum(), rel=1e-7)
        assert errors[f] == pytest.approx(np.abs(hy - guess).sum(), rel=1e-6)
        assert hx @ models[f].coefficients + models[f].intercept == pytest.approx(guess, rel=1e-6, abs=1e-6)
