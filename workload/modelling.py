"""Model queries.

Linear models on one feature have a closed form, so their metrics, predictions, cross-validation and
search are recomputed in SQL on the same md5 split. Boosting on one or two features is recomputed
round by round: second-order trees, a tree of three leaves, softmax, and the Shapley values and
importances of a tree of two levels. Of whole training runs of other models the SQL checks what must
hold whatever the fit: the rows tested of each class, totals and ranges. That forests' Shapley values
add up to the forest's own probabilities is checked row by row.
"""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators.charts import importance_bar
from tabloom.operators.models import feature_importance, make_model
from tabloom.operators.features import encode_labels, label_classes
from tabloom.operators.lanes import local_table
from tabloom.operators.arrays import subsample
from tabloom.operators.trees import expected, explain, flat_trees
from tabloom.plans.explanation import linear_shapley, shapley_importance
from tabloom.plans.training import KEY, ModelConfig, prepare, split, train_model
from workload.fixtures import GAPPY_ORDERS_SQL, gappy_orders
from workload.registry import query, rounded, table


def document_quality(spark, sf_dir):
    """Labelled documents: two classes, numeric and categorical features."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(documents, "doc_id").select(
        F.col("doc_id").alias("key"), "toxic", "lang", "source", "n_chars",
        (F.col("n_chars") / 100).cast("int").alias("hundreds"), F.col("quality"))


def order_status(spark, sf_dir):
    """Orders: three classes."""
    return gappy_orders(spark, sf_dir).drop("o_custkey", "o_orderdate").withColumnRenamed("o_orderkey", "key")


def part_price(spark, sf_dir):
    """Parts: a numeric target."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


def line_price(spark, sf_dir):
    """Order lines: a numeric target."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice")


FEATURES_OF = {
    document_quality: ["toxic", "lang", "source", "n_chars", "hundreds"],
    order_status: ["o_orderstatus", "o_totalprice", "o_orderpriority"],
    part_price: ["p_partkey", "p_brand", "p_type", "p_size"],
    line_price: ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"],
}
TARGETS_SQL = {
    document_quality: "SELECT doc_id AS key, quality AS y FROM labels JOIN documents USING (doc_id)",
    order_status: "SELECT o_orderkey AS key, o_orderstatus AS y FROM orders",
    part_price: "SELECT p_partkey AS key, p_retailprice AS y FROM part",
    line_price: "SELECT l_orderkey * 10 + l_linenumber AS key, l_extendedprice AS y FROM lineitem",
}


def _hash_sql(seed, key="key"):
    return f"('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 8))::BIGINT"


TEST_SQL = f"{_hash_sql(42)} < 858993459"


def _train(spark, sf_dir, source, target, task, model, features=None, **settings):
    config = ModelConfig(target, task, model, **settings)
    return train_model(source(spark, sf_dir), config, F.col("key"), features=features or FEATURES_OF[source])


CLASSIFIER_QUERIES = {
    "train_logistic": (document_quality, "quality", "Logistic Regression"),
    "train_logistic_multiclass": (order_status, "o_orderstatus", "Logistic Regression"),
    "train_random_forest": (document_quality, "quality", "Random Forest"),
    "train_gradient_boosting": (document_quality, "quality", "Gradient Boosting"),
    "train_xgboost_preset": (document_quality, "quality", "XGBoost"),
    "train_lightgbm_preset": (document_quality, "quality", "LightGBM"),
}
REGRESSOR_QUERIES = {
    "train_linear": (line_price, "l_extendedprice", "Linear Regression"),
    "train_ridge": (line_price, "l_extendedprice", "Ridge Regression"),
    "train_forest_regressor": (part_price, "p_retailprice", "Random Forest Regressor"),
    "train_boosting_regressor": (part_price, "p_retailprice", "Gradient Boosting Regressor"),
    "train_xgboost_regressor_preset": (part_price, "p_retailprice", "XGBoost Regressor"),
    "train_lightgbm_regressor_preset": (part_price, "p_retailprice", "LightGBM Regressor"),
}
NO_TREES = ("Logistic Regression", "Linear Regression", "Ridge Regression")


def _facts(spark, rows):
    return local_table(spark, [(item, str(value).lower() if isinstance(value, bool) else str(value)) for item, value in rows], "item string, value string")


def _metrics(result):
    return {row["metric"]: row["value"] for row in result.metrics.collect()}


def _importance_holds(result):
    """Tree importances are shares of one; coefficients are not."""
    values = [row["importance"] for row in result.importance.collect()]
    total = sum(values)
    return len(values) == len(result.feature_names) and min(values) >= 0 and (result.model_name in NO_TREES or abs(total - 1) < 1e-6)


def _classifier_facts(spark, sf_dir, source, target, model):
    result = _train(spark, sf_dir, source, target, "classification", model)
    metrics = _metrics(result)
    truth = {r["y_true"]: r["n"] for r in result.predictions.groupBy("y_true").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = result.predictions.where(~F.col("y_pred").isin(*result.label_classes)).isEmpty()
    score = metrics["roc_auc"]
    facts = [(f"test_rows {label}", n) for label, n in truth.items()] + [
        ("classes", " ".join(result.label_classes)), ("confusion_total", result.confusion.agg(F.sum("count")).first()[0]),
        ("recall_is_accuracy", abs(metrics["recall_weighted"] - metrics["accuracy"]) < 1e-9), ("guesses_are_classes", known),
        ("in_range", all(0 <= metrics[m] <= 1 for m in ("accuracy", "precision_weighted", "f1_weighted"))),
        ("auc_for_two_classes", (score is not None and 0 <= score <= 1) == (len(result.label_classes) == 2)),
        ("importance_holds", _importance_holds(result)),
    ]
    result.release()
    return _facts(spark, facts)


def _classifier_sql(source):
    return f"""WITH t AS (SELECT y::VARCHAR AS y, {TEST_SQL} AS is_test FROM ({TARGETS_SQL[source]}))
SELECT 'test_rows ' || y AS item, count(*)::VARCHAR AS value FROM t WHERE is_test GROUP BY y
UNION ALL SELECT 'classes', string_agg(DISTINCT y, ' ' ORDER BY y) FROM t
UNION ALL SELECT 'confusion_total', count(*)::VARCHAR FROM t WHERE is_test
UNION ALL SELECT unnest(['recall_is_accuracy', 'guesses_are_classes', 'in_range', 'auc_for_two_classes', 'importance_holds']), 'true'"""


def _regressor_facts(spark, sf_dir, source, target, model):
    result = _train(spark, sf_dir, source, target, "regression", model)
    metrics = _metrics(result)
    seen = result.predictions.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("y_true") * 100).cast("bigint")).alias("cents"), F.min("y_pred").alias("low"), F.max("y_pred").alias("high")).first()
    span = table(spark, sf_dir, "part").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high")).first()
    slack = 0.25 * (span["high"] - span["low"])  # boosting may step a little beyond the targets
    facts = [
        ("test_rows", seen["n"]), ("test_cents", seen["cents"]), ("mae_under_rmse", metrics["mae"] <= metrics["rmse"] + 1e-9),
        ("importance_holds", _importance_holds(result)),
        ("plausible", -0.1 < metrics["r2"] <= 1 if source is line_price else span["low"] - slack <= seen["low"] and seen["high"] <= span["high"] + slack),
    ]
    result.release()
    return _facts(spark, facts)


def _regressor_sql(source):
    return f"""WITH t AS (SELECT y, {TEST_SQL} AS is_test FROM ({TARGETS_SQL[source]}))
SELECT 'test_rows' AS item, count(*)::VARCHAR AS value FROM t WHERE is_test
UNION ALL SELECT 'test_cents', sum(round(y * 100)::BIGINT)::VARCHAR FROM t WHERE is_test
UNION ALL SELECT unnest(['mae_under_rmse', 'importance_holds', 'plausible']), 'true'"""


def _register(name, make, source, target, model, sql):
    @query(name, sql)
    def run(spark, sf_dir):
        return make(spark, sf_dir, source, target, model)


for _name, (_source, _target, _model) in CLASSIFIER_QUERIES.items():
    _register(_name, _classifier_facts, _source, _target, _model, _classifier_sql(_source))
for _name, (_source, _target, _model) in REGRESSOR_QUERIES.items():
    _register(_name, _regressor_facts, _source, _target, _model, _regressor_sql(_source))


# ---------------------------------------------------------------- one feature: the closed form

ONE_SQL = f"""b AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_quantity AS x, l_extendedprice AS y FROM lineitem),
d AS (SELECT *, {TEST_SQL} AS is_test, ({_hash_sql(43)} % 5)::INTEGER AS fold FROM b)"""


def _fit_sql(rows, alpha, by=""):
    """Means, deviation and the slope on the scaled feature; the scaled feature's squares sum to n."""
    part = f"{by}, " if by else ""
    return f"""SELECT {part}avg(x) AS m, stddev_pop(x) AS s, avg(y) AS c,
  covar_pop(x, y) / stddev_pop(x) * count(*) / (count(*) + {alpha}) AS slope FROM {rows} {'GROUP BY ALL' if by else ''}"""


def _one(spark, sf_dir, model, **settings):
    return _train(spark, sf_dir, line_price, "l_extendedprice", "regression", model, ["l_quantity"], **settings)


R2 = "1 - avg(pow(y - p, 2)) / var_pop(y)"


def _one_metrics_sql(alpha):
    return f"""WITH {ONE_SQL}, f AS ({_fit_sql('d WHERE NOT is_test', alpha)}),
p AS (SELECT y, c + slope * (x - m) / s AS p FROM d, f WHERE is_test),
w AS (SELECT {R2} AS r2, avg(abs(y - p)) AS mae, sqrt(avg(pow(y - p, 2))) AS rmse FROM p)
SELECT 'r2' AS metric, round(r2, 6) AS value FROM w UNION ALL SELECT 'mae', round(mae, 4) FROM w UNION ALL SELECT 'rmse', round(rmse, 4) FROM w"""


def _one_metrics(spark, sf_dir, model):
    metrics = _one(spark, sf_dir, model).metrics
    return metrics.select("metric", F.when(F.col("metric") == "r2", F.round("value", 6)).otherwise(F.round("value", 4)).alias("value"))


@query("train_linear_one_feature", _one_metrics_sql("0"))
def q_train_linear_one_feature(spark, sf_dir):
    return _one_metrics(spark, sf_dir, "Linear Regression")


@query("train_ridge_one_feature", _one_metrics_sql("1.0::DOUBLE"))
def q_train_ridge_one_feature(spark, sf_dir):
    return _one_metrics(spark, sf_dir, "Ridge Regression")


@query("predictions", f"""WITH {ONE_SQL}, f AS ({_fit_sql('d WHERE NOT is_test', '1.0::DOUBLE')})
SELECT round(y, 4) AS y_true, round(c + slope * (x - m) / s, 4) AS y_pred, x AS l_quantity FROM d, f WHERE is_test""")
def q_predictions(spark, sf_dir):
    return rounded(_one(spark, sf_dir, "Ridge Regression").predictions, 4, ["y_true", "y_pred"])


@query("train_confusion", f"""WITH t AS (SELECT y, {TEST_SQL} AS is_test FROM ({TARGETS_SQL[order_status]}))
SELECT y AS y_true, count(*)::BIGINT AS n FROM t WHERE is_test GROUP BY y""")
def q_train_confusion(spark, sf_dir):
    confusion = _train(spark, sf_dir, order_status, "o_orderstatus", "classification", "Logistic Regression").confusion
    return confusion.groupBy("y_true").agg(F.sum("count").alias("n")).where("n > 0")


CV_SQL = f"""f AS (SELECT held, alpha, avg(x) AS m, stddev_pop(x) AS s, avg(y) AS c,
  covar_pop(x, y) / stddev_pop(x) * count(*) / (count(*) + alpha) AS slope
  FROM {{rows}} JOIN (SELECT unnest(range(5))::INTEGER AS held) ON fold <> held, (SELECT unnest({{alphas}}) AS alpha) GROUP BY held, alpha),
s AS (SELECT held, alpha, {R2} AS r2, avg(abs(y - p)) AS mae FROM (
  SELECT held, alpha, y, c + slope * (x - m) / s AS p FROM {{rows}} JOIN f ON fold = held) GROUP BY held, alpha)"""


@query("cv_summary", f"""WITH {ONE_SQL}, {CV_SQL.format(rows='d', alphas='[1.0::DOUBLE]')}
SELECT 'r2' AS metric, round(avg(r2), 6) AS mean, round(stddev_pop(r2), 6) AS std FROM s
UNION ALL SELECT 'mean_absolute_error', round(avg(mae), 4), round(stddev_pop(mae), 4) FROM s""")
def q_cv_summary(spark, sf_dir):
    summary = _one(spark, sf_dir, "Ridge Regression", use_cv=True).cv_summary
    digits = lambda c: F.when(F.col("metric") == "r2", F.round(c, 6)).otherwise(F.round(c, 4)).alias(c)
    return summary.select("metric", digits("mean"), digits("std"))


def _search_sql(alphas):
    return f"""WITH {ONE_SQL}, t AS (SELECT * FROM d WHERE NOT is_test), {CV_SQL.format(rows='t', alphas=alphas)},
a AS (SELECT alpha, avg(r2) AS mean, stddev_pop(r2) AS std FROM s GROUP BY alpha)
SELECT rank() OVER (ORDER BY mean DESC)::INTEGER AS rank_test_score, round(mean, 6) AS mean_test_score, round(std, 6) AS std_test_score,
  '{{"alpha": ' || alpha::VARCHAR || '}}' AS params FROM a"""


@query("search", _search_sql("[0.1::DOUBLE, 1.0::DOUBLE, 5.0::DOUBLE, 10.0::DOUBLE]"))
def q_search(spark, sf_dir):
    return rounded(_one(spark, sf_dir, "Ridge Regression", use_search=True, search_type="grid").search_summary, 6)


# two of the four settings, as drawn with seed 42
@query("search_random", _search_sql("[0.1::DOUBLE, 10.0::DOUBLE]"))
def q_search_random(spark, sf_dir):
    return rounded(_one(spark, sf_dir, "Ridge Regression", use_search=True, n_iter=2).search_summary, 6)


@query("search_logistic", """
SELECT '{"C": ' || c::VARCHAR || '}' AS params, true AS in_range, true AS ranked FROM (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE, 5.0::DOUBLE]) AS c)""")
def q_search_logistic(spark, sf_dir):
    summary = _train(
        spark, sf_dir, document_quality, "quality", "classification", "Logistic Regression",
        use_search=True, search_type="grid", cv_folds=3).search_summary
    return summary.select(
        "params", F.col("mean_test_score").between(0, 1).alias("in_range"), F.col("rank_test_score").between(1, 5).alias("ranked"))


@query("shap_sampled", """
SELECT 'additive' AS item, 'true' AS value UNION ALL SELECT 'same_as_forest', 'true' UNION ALL SELECT 'descending', 'true'
UNION ALL SELECT 'features', (count(DISTINCT lang) + count(DISTINCT source))::VARCHAR FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT 'rows', least(120, count(*))::VARCHAR FROM (
  SELECT doc_id AS key FROM labels JOIN documents USING (doc_id)) WHERE """ + TEST_SQL)
def q_shap_sampled(spark, sf_dir):
    """A forest's values: with the forest's mean they add up to its own probabilities, row by row."""
    result = _train(
        spark, sf_dir, document_quality, "quality", "classification", "Random Forest", ["lang", "source"], rare_min_frequency=0.0)
    forest = result.model.stages[-1]
    trees, width = flat_trees(forest), len(result.feature_names)
    rows = subsample(result.test_rows, F.col(KEY), 120, 42)
    mean = expected(trees)
    added = [F.aggregate(F.slice("shap", k * width + 1, width), F.lit(float(mean[k])), lambda a, b: a + b) for k in (0, 1)]
    own = vector_to_array("probability")
    off = explain(rows, trees, KEY, "features", width).join(forest.transform(rows), F.col("key") == F.col(KEY)).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs(added[0] + added[1] - 1)).alias("total"),
        F.max(F.abs(added[1] - F.get(own, F.lit(1)))).alias("off")).first()
    bar = [row["mean_abs_shap"] for row in shapley_importance(result).collect()]
    result.release()
    return _facts(spark, [
        ("additive", off["total"] < 1e-6), ("same_as_forest", off["off"] < 1e-6), ("descending", bar == sorted(bar, reverse=True)),
        ("features", width), ("rows", off["n"])])


def _shap_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_quantity", "l_tax", F.col("l_extendedprice").alias("label"))
    return VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol="features").transform(rows)


# one tree of two levels on two features: its splits, its leaves, and the expectation for each set of known features
TREE_SQL = """b AS (SELECT row_number() OVER () AS r, l_orderkey * 10 + l_linenumber AS key, l_quantity AS x0, l_tax AS x1,
  (SELECT avg(l_extendedprice) FROM lineitem) - l_extendedprice AS g FROM lineitem),
long AS (SELECT key, g, 0 AS f, x0 AS x FROM b UNION ALL SELECT key, g, 1, x1 FROM b),
root AS (SELECT f AS rf, x AS rc, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS rate FROM (
  SELECT f, x, sum(sum(g)) OVER w AS gl, sum(count(*)) OVER w AS hl, sum(sum(g)) OVER p AS gt, sum(count(*)) OVER p AS ht
  FROM long GROUP BY f, x WINDOW w AS (PARTITION BY f ORDER BY x), p AS (PARTITION BY f))
  WHERE hl < ht ORDER BY gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) DESC, f, x LIMIT 1),
sided AS (SELECT b.*, rf, rc, CASE WHEN CASE rf WHEN 0 THEN x0 ELSE x1 END <= rc THEN 0 ELSE 1 END AS side FROM b, root),
slong AS (SELECT side, g, 0 AS f, x0 AS x FROM sided UNION ALL SELECT side, g, 1, x1 FROM sided),
child AS (SELECT side, f AS cf, x AS cc, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS rate FROM (
  SELECT side, f, x, sum(sum(g)) OVER w AS gl, sum(count(*)) OVER w AS hl, sum(sum(g)) OVER p AS gt, sum(count(*)) OVER p AS ht
  FROM slong GROUP BY side, f, x WINDOW w AS (PARTITION BY side, f ORDER BY x), p AS (PARTITION BY side, f))
  WHERE hl < ht QUALIFY row_number() OVER (PARTITION BY side ORDER BY gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) DESC, f, x) = 1)"""
SHAP_SQL = f"""WITH {TREE_SQL},
leaves AS (
  SELECT side, CASE WHEN CASE cf WHEN 0 THEN x0 ELSE x1 END <= cc THEN 0 ELSE 1 END AS leaf, -0.5::DOUBLE * sum(g) / (count(*) + 1) AS v, count(*) AS n
  FROM sided JOIN child USING (side) GROUP BY ALL),
tree AS (
  SELECT max(rf) AS rf, max(rc) AS rc,
    max(cf) FILTER (child.side = 0) AS cf0, max(cc) FILTER (child.side = 0) AS cc0, max(cf) FILTER (child.side = 1) AS cf1, max(cc) FILTER (child.side = 1) AS cc1,
    max(v) FILTER (leaves.side = 0 AND leaf = 0) AS v00, max(v) FILTER (leaves.side = 0 AND leaf = 1) AS v01,
    max(v) FILTER (leaves.side = 1 AND leaf = 0) AS v10, max(v) FILTER (leaves.side = 1 AND leaf = 1) AS v11,
    max(n) FILTER (leaves.side = 0 AND leaf = 0) AS n00, max(n) FILTER (leaves.side = 0 AND leaf = 1) AS n01,
    max(n) FILTER (leaves.side = 1 AND leaf = 0) AS n10, max(n) FILTER (leaves.side = 1 AND leaf = 1) AS n11
  FROM root, child, leaves),
cases AS (SELECT r, key, x0, x1, s0, s1, tree.* FROM b, tree, (SELECT unnest([false, true]) AS s0), (SELECT unnest([false, true]) AS s1)),
ways AS (
  SELECT r, key, s0, s1, v00, v01, v10, v11,
    CASE WHEN CASE rf WHEN 0 THEN s0 ELSE s1 END THEN (CASE rf WHEN 0 THEN x0 ELSE x1 END <= rc)::INT ELSE (n00 + n01) / (n00 + n01 + n10 + n11)::DOUBLE END AS pl,
    CASE WHEN CASE cf0 WHEN 0 THEN s0 ELSE s1 END THEN (CASE cf0 WHEN 0 THEN x0 ELSE x1 END <= cc0)::INT ELSE n00 / (n00 + n01)::DOUBLE END AS p0,
    CASE WHEN CASE cf1 WHEN 0 THEN s0 ELSE s1 END THEN (CASE cf1 WHEN 0 THEN x0 ELSE x1 END <= cc1)::INT ELSE n10 / (n10 + n11)::DOUBLE END AS p1
  FROM cases),
games AS (SELECT r, key, s0, s1, pl * (p0 * v00 + (1 - p0) * v01) + (1 - pl) * (p1 * v10 + (1 - p1) * v11) AS v FROM ways),
sums AS (
  SELECT key, max(v) FILTER (NOT s0 AND NOT s1) AS v, max(v) FILTER (s0 AND NOT s1) AS va, max(v) FILTER (NOT s0 AND s1) AS vb, max(v) FILTER (s0 AND s1) AS vab
  FROM games GROUP BY r, key)
SELECT key, round((va - v + vab - vb) / 2, 3) AS quantity, round((vb - v + vab - va) / 2, 3) AS tax, round(vab - v, 3) AS together FROM sums"""


def _two_levels(rows):
    return make_model(
        "regression", "XGBoost Regressor", n_estimators=1, max_depth=2, learning_rate=0.5, subsample=1.0, colsample=1.0).fit(rows)


@query("importance", f"""WITH {TREE_SQL},
gains AS (SELECT rf AS f, rate FROM root UNION ALL SELECT cf, rate FROM child)
SELECT CASE f WHEN 0 THEN 'l_quantity' ELSE 'l_tax' END AS feature, round(coalesce(sum(rate), 0) / (SELECT sum(rate) FROM gains), 6) AS importance
FROM (SELECT unnest([0, 1]) AS f) LEFT JOIN gains USING (f) GROUP BY f""")
def q_importance(spark, sf_dir):
    rows = _shap_rows(spark, sf_dir)
    return rounded(importance_bar(feature_importance(rows, _two_levels(rows), ["l_quantity", "l_tax"])), 6)


@query("shap_two_levels", SHAP_SQL)
def q_shap_two_levels(spark, sf_dir):
    rows = _shap_rows(spark, sf_dir)
    model = _two_levels(rows)
    values = explain(rows, model.flatTrees(), "key", "features", 2)
    quantity, tax = F.get("shap", F.lit(0)), F.get("shap", F.lit(1))
    return rounded(values.select("key", quantity.alias("quantity"), tax.alias("tax"), (quantity + tax).alias("together")), 3)


@query("shap_linear_model", f"""WITH {ONE_SQL}, f AS ({_fit_sql('d WHERE NOT is_test', '0')}),
z AS (SELECT (x - m) / s AS z, slope FROM d, f WHERE is_test)
SELECT 'l_quantity' AS feature, round(abs(any_value(slope)) * avg(abs(z - (SELECT avg(z) FROM z))), 4) AS mean_abs_shap FROM z""")
def q_shap_linear_model(spark, sf_dir):
    return rounded(shapley_importance(_one(spark, sf_dir, "Linear Regression")), 4)


@query("prepared_rows", f"""WITH d AS ({GAPPY_ORDERS_SQL}),
r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || o_orderkey::VARCHAR), 1, 8))::BIGINT, o_orderkey::VARCHAR) - 1 AS r,
 count(*) OVER () AS n FROM d WHERE o_totalprice IS NOT NULL)
SELECT o_orderkey, round(o_totalprice, 4) AS label, r < floor(n * 0.3::DOUBLE + 0.5) AS is_test,
 (SELECT count(*) FROM d WHERE o_totalprice IS NULL)::BIGINT AS dropped_rows FROM r""")
def q_prepared_rows(spark, sf_dir):
    config = ModelConfig("o_totalprice", "regression", "Linear Regression", test_size=0.3)
    prepared = prepare(gappy_orders(spark, sf_dir), config, F.col("o_orderkey"))
    rows = split(prepared, config, exact=True)
    return rounded(rows.select(
        "o_orderkey", "label", "is_test", F.lit(prepared.dropped_rows).cast("bigint").alias("dropped_rows")), 4)


@query("prepared_clashing_names", """
SELECT vec_id, label::DOUBLE AS label_value, (vec_id % 10)::DOUBLE AS fold_value, (vec_id % 97)::DOUBLE AS target FROM embeddings""")
def q_prepared_clashing_names(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", (F.col("vec_id") % 10).alias("fold"), (F.col("vec_id") % 97).alias("t"))
    prepared = prepare(rows, ModelConfig("t", "regression", "Linear Regression"), F.col("vec_id"))
    renamed = {old: new for new, old in prepared.original.items()}
    return prepared.rows.select(
        "vec_id", F.col(renamed["label"]).cast("double").alias("label_value"),
        F.col(renamed["fold"]).cast("double").alias("fold_value"), F.col("label").alias("target"))


@query("used_features", """
SELECT unnest(['numeric', 'numeric', 'numeric', 'categorical']) AS kind, unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderpriority']) AS feature,
  count(*)::BIGINT AS usable_rows FROM orders""")
def q_used_features(spark, sf_dir):
    # o_orderdate is a date, and dates are left out
    prepared = prepare(gappy_orders(spark, sf_dir), ModelConfig("o_orderstatus", "classification", "Logistic Regression"))
    rows = [("numeric", name) for name in prepared.numeric] + [("categorical", name) for name in prepared.categorical]
    return local_table(spark, [(*row, prepared.usable_rows) for row in rows], "kind string, feature string, usable_rows bigint")


def _one_feature(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    rows = lineitem.select("l_quantity", F.col("l_extendedprice").alias("label"))
    return VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(rows)


@query("ols_one_feature", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept FROM lineitem""")
def q_ols_one_feature(spark, sf_dir):
    model = make_model("regression", "Linear Regression").fit(_one_feature(spark, sf_dir))
    return rounded(local_table(
        spark, [(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double"), 5)


@query("linear_shap", """
SELECT 'l_quantity' AS feature, round(abs(regr_slope(l_extendedprice, l_quantity)) * (SELECT avg(abs(l_quantity - (SELECT avg(l_quantity) FROM lineitem))) FROM lineitem), 4)
 AS mean_abs_shap FROM lineitem""")
def q_linear_shap(spark, sf_dir):
    rows = _one_feature(spark, sf_dir)
    model = make_model("regression", "Linear Regression").fit(rows)
    return rounded(linear_shapley(rows, [list(model.coefficients)], ["l_quantity"]), 4)


# ---------------------------------------------------------------- boosting on one feature: every round in SQL


def _rated(g, h):
    return f"{g} * {g} / ({h})"


def _cuts_sql(rows, by, g, h, l2, least=1):
    """The best cut of ``x`` in each group ``by``: one row each with the sums of both sides."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {by + ', ' if by else ''}x AS cut, gl, hl, gt - gl AS gr, ht - hl AS hr, rate FROM (
  SELECT *, {_rated('gl', f'hl + {l2}')} + {_rated('(gt - gl)', f'ht - hl + {l2}')} - {_rated('gt', f'ht + {l2}')} AS rate FROM (
    SELECT {by + ', ' if by else ''}x, sum(sum({g})) OVER w AS gl, sum(sum({h})) OVER w AS hl, sum(sum({g})) OVER p AS gt, sum(sum({h})) OVER p AS ht,
      sum(count(*)) OVER w AS nl, sum(count(*)) OVER p AS nt
    FROM {rows} GROUP BY {by + ', ' if by else ''}x WINDOW w AS ({part} ORDER BY x), p AS ({part}))
  WHERE nl >= {least} AND nt - nl >= {least}) QUALIFY row_number() OVER ({part} ORDER BY rate DESC, x) = 1"""


def _boosted(spark, sf_dir, name, **settings):
    rows = _one_feature(spark, sf_dir)
    model = make_model("regression", name, **settings).fit(rows)
    scored = model.transform(rows).groupBy("l_quantity").agg(F.min("prediction").alias("prediction"), F.count(F.lit(1)).alias("n"))
    return model, scored


QUANTITIES = "b AS (SELECT l_quantity AS x, l_extendedprice AS y, (SELECT avg(l_extendedprice) FROM lineitem) AS p FROM lineitem)"


@query("boost_second_order", f"""WITH {QUANTITIES},
s1 AS ({_cuts_sql('b', '', '(p - y)', '1', '1')}),
r1 AS (SELECT b.x, y, p - 0.3::DOUBLE * CASE WHEN b.x <= cut THEN gl / (hl + 1) ELSE gr / (hr + 1) END AS p FROM b, s1),
s2 AS ({_cuts_sql('r1', '', '(p - y)', '1', '1')}),
r2 AS (SELECT r1.x, y, p - 0.3::DOUBLE * CASE WHEN r1.x <= cut THEN gl / (hl + 1) ELSE gr / (hr + 1) END AS p FROM r1, s2)
SELECT x AS l_quantity, round(min(p), 4) AS prediction, count(*)::BIGINT AS n FROM r2 GROUP BY x""")
def q_boost_second_order(spark, sf_dir):
    _, scored = _boosted(
        spark, sf_dir, "XGBoost Regressor", n_estimators=2, max_depth=1, learning_rate=0.3, subsample=1.0, colsample=1.0)
    return rounded(scored, 4)


@query("boost_three_leaves", f"""WITH {QUANTITIES},
s1 AS ({_cuts_sql('b', '', '(p - y)', '1', '0', 20)}),
r1 AS (SELECT b.x, y, p, CASE WHEN b.x <= cut THEN 0 ELSE 1 END AS side FROM b, s1),
s2 AS ({_cuts_sql('r1', 'side', '(p - y)', '1', '0', 20)}),
best AS (SELECT * FROM s2 ORDER BY rate DESC, side LIMIT 1),
leaves AS (SELECT r1.*, CASE WHEN r1.side <> best.side THEN 0 WHEN r1.x <= best.cut THEN 1 ELSE 2 END AS leaf FROM r1, best),
v AS (SELECT leaf, -0.5::DOUBLE * sum(p - y) / count(*) AS v FROM leaves GROUP BY leaf)
SELECT x AS l_quantity, round(min(p + v), 4) AS prediction, count(*)::BIGINT AS n, (SELECT count(*) FROM v)::INTEGER AS leaves
FROM leaves JOIN v USING (leaf) GROUP BY x""")
def q_boost_three_leaves(spark, sf_dir):
    model, scored = _boosted(spark, sf_dir, "LightGBM Regressor", n_estimators=1, num_leaves=3, learning_rate=0.5)
    return rounded(scored, 4).withColumn("leaves", F.lit(max(model.leafCounts)))


@query("boost_softmax", f"""WITH b AS (SELECT l_linenumber::DOUBLE AS x, l_returnflag AS y FROM lineitem),
priors AS (SELECT y AS k, count(*) / (SELECT count(*) FROM b)::DOUBLE AS p FROM b GROUP BY y),
g AS (SELECT b.x, k, p - (y = k)::INT AS g, p * (1 - p) AS h, p FROM b, priors),
s AS ({_cuts_sql('g', 'k', 'g', '1', '0')}),
v AS (SELECT g.x, g.k, min(ln(p)) AS start, any_value(CASE WHEN g.x <= cut THEN gl / (hl * p * (1 - p)) ELSE gr / (hr * p * (1 - p)) END) AS step
  FROM g JOIN s USING (k) GROUP BY ALL),
e AS (SELECT x, k, exp(start - 0.5::DOUBLE * 2 / 3 * step) AS e FROM v)
SELECT x::INT AS l_linenumber, k AS class, round(e / sum(e) OVER (PARTITION BY x), 6) AS probability FROM e""")
def q_boost_softmax(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag")
    classes = label_classes(lineitem, "l_returnflag")
    rows = VectorAssembler(inputCols=["l_linenumber"], outputCol="features").transform(encode_labels(lineitem, "l_returnflag", classes))
    model = make_model(
        "classification", "Gradient Boosting", n_classes=len(classes), n_estimators=1, max_depth=1, learning_rate=0.5).fit(rows)
    scored = model.transform(rows).select("l_linenumber", F.posexplode(vector_to_array("probability")).alias("k", "p"))
    name = F.get(F.array(*[F.lit(c) for c in classes]), F.col("k"))
    return rounded(scored.groupBy("l_linenumber", name.alias("class")).agg(F.min("p").alias("probability")), 6)
