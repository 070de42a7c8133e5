import json

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import evaluate, splits
from tabloom.operators.features import (
    CategoryEncoder, ModeImputer, NumericEncoder, RareCategoryGrouper, TablePreprocessor, class_weights,
    encode_labels, feature_slots, label_classes,
)
from tabloom.operators.models import (
    available_models, candidates, coefficient_rows, make_model, param_grid,
)
from tabloom.plans.explanation import sampled_shapley, shapley_importance
from tabloom.plans.training import KEY, ModelConfig, prepare, split, train_model


@pytest.fixture(scope="module")
def demo(spark):
    """A small table with every kind of column and a target that can be learned."""
    n = 240
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        x, site = float(rng.normal()), ["a", "b", "c"][int(rng.integers(3))]
        z = 2 * x + (1.5 if site == "a" else 0) + float(rng.normal()) * 0.3
        rows.append((
            i, "2024-01-%02d" % (i % 28 + 1), x if i % 11 else None, site if i % 13 else None, float(rng.normal()),
            "yes" if z > 0.4 else "no", z, ["u", "v", "w"][int(z > 0) + int(z > 1)]))
    return spark.createDataFrame(
        rows, "id int, day string, x double, site string, noise double, outcome string, response double, grade string").cache()


def dense(df):
    return np.array([r["v"] for r in df.select(vector_to_array("features").alias("v")).collect()])


def test_numeric_encoder_matches_numpy(spark):
    values = [1.0, 2.0, None, 4.0, 8.0, float("nan"), 3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["o"] for r in NumericEncoder(inputCols=["x"], outputCols=["o"]).fit(df).transform(df).select("o").collect()]
    filled = np.array([3.0 if v is None or v != v else v for v in values])
    assert got == pytest.approx(list((filled - filled.mean()) / filled.std()))


def test_constant_and_all_missing_numbers(spark):
    df = spark.createDataFrame([(5.0, None)] * 4, "c double, n double")
    got = NumericEncoder(inputCols=["c", "n"], outputCols=["a", "b"]).fit(df).transform(df).select("a", "b").first()
    assert tuple(got) == (0.0, 0.0)


def test_rare_grouping_rules(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 6 + ["b"] * 3 + ["c"] + [None] * 2], "s string")

    def grouped(**settings):
        model = RareCategoryGrouper(inputCols=["s"], outputCols=["g"], **settings).fit(df)
        seen = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("new",)], "s string")
        return [r["g"] for r in model.transform(seen).select("g").collect()]

    assert grouped(minFrequency=0.2) == ["a", "b", "__OTHER__", "__OTHER__", "__OTHER__"]
    assert grouped(minFrequency=0.1) == ["a", "b", "__OTHER__", "__MISSING__", "__OTHER__"]
    assert grouped(minFrequency=0.0, maxCategories=2) == ["a", "b", "__OTHER__", "__OTHER__", "__OTHER__"]
    # nothing is frequent enough: the most frequent values are kept instead
    assert grouped(minFrequency=0.9, maxCategories=1) == ["a", "__OTHER__", "__OTHER__", "__OTHER__", "__OTHER__"]


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert ModeImputer(inputCols=["s"], outputCols=["o"]).fit(df).getOrDefault("modes") == ["a"]


def test_one_hot_has_all_levels_and_zeros_for_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "s string")
    model = TablePreprocessor(categorical=["s"], minFrequency=0.0).fit(df)
    assert [slot[1] for slot in feature_slots(model)] == ["s_a", "s_b", "s_c"]
    seen = spark.createDataFrame([("a",), ("c",), ("zzz",)], "s string")
    assert dense(model.transform(seen)).tolist() == [[1, 0, 0], [0, 0, 1], [0, 0, 0]]
    with pytest.raises(ValueError):
        TablePreprocessor().fit(df)


def test_preprocessor_saves_and_loads(spark, demo, tmp_path):
    from pyspark.ml import PipelineModel

    model = TablePreprocessor(numeric=["x", "noise"], categorical=["site"]).fit(demo)
    model.write().overwrite().save(str(tmp_path / "prep"))
    again = PipelineModel.load(str(tmp_path / "prep"))
    np.testing.assert_allclose(dense(again.transform(demo)), dense(model.transform(demo)))


def test_fit_only_sees_training_rows(spark, demo):
    config = ModelConfig("outcome", "classification", "Logistic Regression")
    rows = split(prepare(demo, config, F.col("id")), config)
    train = rows.where(~F.col("is_test"))
    base = TablePreprocessor(numeric=["x"], categorical=["site"]).fit(train)
    changed = rows.withColumn("x", F.when(F.col("is_test"), 1e9).otherwise(F.col("x")))
    again = TablePreprocessor(numeric=["x"], categorical=["site"]).fit(changed.where(~F.col("is_test")))
    assert base.stages[0].getOrDefault("means") == again.stages[0].getOrDefault("means")


def test_label_encoding_and_weights(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "y string")
    classes = label_classes(df, "y")
    assert classes == ["a", "b"]
    assert [r["label"] for r in encode_labels(df, "y", classes).collect()] == [1.0, 0.0, 1.0, None]
    assert {r["label"]: r["weight"] for r in class_weights(df, "y").collect()} == {"a": 1.5, "b": 0.75}


def test_exact_split_sizes_and_hot_class(spark):
    df = spark.range(3000).withColumn("y", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 4).cast("string")))
    sizes = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = splits.stratified_split(df, "y", F.col("id"), 0.2)
    assert parts.count() == 3000
    test = {r["y"]: r["n"] for r in parts.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert test == {y: int(n * 0.2 + 0.5) for y, n in sizes.items()}
    folds = splits.stratified_folds(df, "y", F.col("id"), 5).groupBy("y", "fold").count()
    spread = folds.groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).agg(F.max("d")).first()[0]
    assert spread <= 1


@pytest.mark.parametrize("slices", [1, 4096])
def test_copies_stay_together(spark, slices):
    df = spark.range(40).crossJoin(spark.range(10).select(F.col("id").alias("copy"))).withColumn("y", (F.col("id") % 2).cast("string"))
    df = df.union(df.where("id = 3").limit(1).crossJoin(spark.range(150).toDF("more")).select("id", "copy", "y"))
    for part, name in ((splits.stratified_folds(df, "y", F.col("id"), 5, slices=slices), "fold"),
                       (splits.stratified_split(df, "y", F.col("id"), 0.25, slices=slices), "is_test")):
        assert part.count() == df.count() and part.columns == [*df.columns, name]
        assert part.groupBy("id").agg(F.countDistinct(name).alias("n")).where("n > 1").count() == 0


CLASHES = ["label", "features", "fold", "is_test", "score", "y_true", "y_pred", "weight"]


def test_names_of_features_do_not_matter(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, len(CLASHES)))
    target = (x @ np.arange(1, len(CLASHES) + 1) + rng.normal(size=300) * 4 > 0).astype(int)
    rows = [(i, *map(float, r), f"c{t}") for i, (r, t) in enumerate(zip(x, target))]
    found = []
    for names in (CLASHES, [f"n{i}" for i in range(len(CLASHES))]):
        schema = "id int, " + ", ".join(f"{n} double" for n in names) + ", outcome string"
        result = train_model(
            spark.createDataFrame(rows, schema), ModelConfig("outcome", "classification", "Logistic Regression", use_cv=True, cv_folds=2), F.col("id"))
        metrics = {r["metric"]: round(r["value"], 6) for r in result.metrics.collect()}
        cv = sorted((r["metric"], round(r["mean"], 6)) for r in result.cv_summary.collect())
        found.append((metrics, cv, [round(r["importance"], 5) for r in result.importance.collect()]))
        assert result.numeric_features == ["id", *names]
        assert set(shapley_importance(result).toPandas()["feature"]) == {"id", *names}
        result.release()
    assert found[0] == found[1] and 0.6 < found[0][0]["accuracy"] < 1


def test_a_random_feature_called_label_tells_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), int(b)) for i, (a, b) in enumerate(zip(rng.normal(size=400), rng.integers(0, 2, 400)))]
    df = spark.createDataFrame(rows, "id int, label double, outcome int")
    result = train_model(df, ModelConfig("outcome", "classification", "Logistic Regression"), F.col("id"))
    assert {r["metric"]: r["value"] for r in result.metrics.collect()}["accuracy"] < 0.75


def test_split_does_not_depend_on_partitions(spark, demo):
    config = ModelConfig("outcome", "classification", "Logistic Regression")
    one = split(prepare(demo.repartition(1), config), config).where("is_test").select("id").collect()
    many = split(prepare(demo.repartition(16), config), config).where("is_test").select("id").collect()
    assert sorted(one) == sorted(many)


def test_auc_matches_the_evaluator(spark):
    rng = np.random.default_rng(5)
    rows = [(str(int(rng.random() < s)), float(round(s, 3) if s < 0.7 else 0.9)) for s in rng.random(4000)]
    df = spark.createDataFrame(rows, "y_true string, score double").repartition(9)
    got = evaluate.roc_auc(df, "1").first()["value"]
    want = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(
        df.withColumn("label", F.col("y_true").cast("double")))
    assert got == pytest.approx(want, abs=1e-12)
    assert evaluate.roc_auc(df.where("y_true = '1'"), "1").first()["value"] is None


def test_metrics_edges(spark):
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y_true double, y_pred double")
    assert {r["metric"]: r["value"] for r in evaluate.regression_metrics(flat).collect()}["r2"] == 0.0
    odd = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "b")], "y_true string, y_pred string")
    got = {r["metric"]: r["value"] for r in evaluate.classification_metrics(odd).collect()}
    assert got["accuracy"] == pytest.approx(1 / 3) and got["precision_weighted"] == pytest.approx(2 / 3)
    cells = {(r["y_true"], r["y_pred"]): r["count"] for r in evaluate.confusion(odd, ["a", "b", "c"]).collect()}
    assert len(cells) == 9 and cells[("c", "b")] == 1 and cells[("b", "b")] == 0


def _linear_data(spark, n=200):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=n)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, label double")
    return x, y, VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


@pytest.mark.parametrize("alpha", [0.1, 1.0, 50.0])
def test_ridge_matches_closed_form(spark, alpha):
    x, y, df = _linear_data(spark)
    centred = x - x.mean(axis=0)
    want = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ (y - y.mean()))
    model = make_model("regression", "Ridge Regression", alpha=alpha).fit(df)
    assert coefficient_rows(model)[0] == pytest.approx(list(want), rel=1e-8)


def test_logistic_matches_newton(spark):
    x, y, df = _linear_data(spark)
    labels = (y > 3).astype(float)
    binary = df.withColumn("label", (F.col("label") > 3).cast("double"))
    C, design = 0.5, np.c_[x, np.ones(len(x))]
    penalty, w = np.diag([1, 1, 1, 0]), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = C * design.T @ (p - labels) + penalty @ w
        w -= np.linalg.solve(C * (design.T * (p * (1 - p))) @ design + penalty, gradient)
    model = make_model("classification", "Logistic Regression", C=C).fit(binary)
    assert coefficient_rows(model)[0] == pytest.approx(list(w[:3]), rel=1e-3)


def test_names_grids_and_sampling():
    assert len(available_models("classification")) == 5 and len(available_models("regression")) == 6
    assert len(candidates("Random Forest", "grid", 12, 1)) == 36
    drawn = candidates("XGBoost", "random", 12, 7)
    assert len(drawn) == 12 == len({json.dumps(c) for c in drawn})
    assert drawn == candidates("XGBoost", "random", 12, 7)
    assert len(candidates("Ridge Regression", "random", 40, 7)) == 4
    assert param_grid("Linear Regression") == {}
    with pytest.raises(ValueError):
        make_model("regression", "Logistic Regression")
    with pytest.raises(ValueError):
        ModelConfig("y", "classification", "Ridge Regression")


def test_training_flow(spark, demo):
    config = ModelConfig(
        "outcome", "classification", "Logistic Regression", use_search=True, search_type="grid", use_cv=True, cv_folds=2)
    result = train_model(demo.drop("response", "grade"), config, F.col("id"))
    assert result.numeric_features == ["id", "x", "noise"] and result.categorical_features == ["site"]
    metrics = {r["metric"]: r["value"] for r in result.metrics.collect()}
    assert metrics["accuracy"] > 0.8 and metrics["roc_auc"] > 0.9
    assert sorted(result.predictions.columns[:3]) == ["positive_class_probability", "y_pred", "y_true"]
    assert result.predictions.columns == ["y_true", "y_pred", "positive_class_probability", "id", "x", "noise", "site"]
    assert result.search_summary.count() == 5 and set(result.best_params) == {"C"}
    assert {r["metric"] for r in result.cv_summary.collect()} == {"accuracy", "f1_weighted"}
    assert result.importance.first()["feature"] == "x"
    assert shapley_importance(result).first()["feature"] == "x"
    assert result.confusion.agg(F.sum("count")).first()[0] == result.predictions.count()
    result.release()


def test_three_classes_with_boosting(spark, demo):
    model = make_model("classification", "Gradient Boosting", 1, 3, n_estimators=2)
    prep = TablePreprocessor(numeric=["x"], categorical=["site"]).fit(demo)
    rows = encode_labels(demo, "grade", ["u", "v", "w"])
    fitted = model.fit(prep.transform(rows).select("features", "label"))
    accuracy = fitted.transform(prep.transform(rows)).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert accuracy > 0.6


def test_sampled_shapley_adds_up_for_a_linear_model(spark):
    x, _, df = _linear_data(spark, 60)
    model = make_model("regression", "Linear Regression").fit(df)
    keyed = df.withColumn(KEY, F.monotonically_increasing_id().cast("string")).select(KEY, "features")
    got = {r["feature"]: r["mean_abs_shap"] for r in sampled_shapley(keyed, model, ["a", "b", "c"], 60, 16).collect()}
    assert sorted(got, key=got.get, reverse=True) == ["b", "a", "c"]
    weights = np.abs(coefficient_rows(model)[0])
    exact = weights * np.abs(x - x.mean(axis=0)).mean(axis=0)
    assert [got[c] for c in "abc"] == pytest.approx(list(exact), rel=0.35)


def test_bad_targets_are_refused(spark, demo):
    with pytest.raises(ValueError):
        train_model(demo, ModelConfig("nope", "classification", "Logistic Regression"))
    with pytest.raises(ValueError):
        train_model(demo.limit(5), ModelConfig("outcome", "classification", "Logistic Regression"))
    with pytest.raises(ValueError):
        prepare(demo, ModelConfig("site", "regression", "Linear Regression"))
