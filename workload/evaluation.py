"""Metric queries on predictions made by fixed rules."""

from pyspark.sql import functions as F

from tabloom.operators import charts, evaluate
from workload.fixtures import RULE_PREDICTIONS_SQL, rule_predictions
from workload.registry import query, rounded, table

RULES = f"WITH p AS ({RULE_PREDICTIONS_SQL})"

# line status guessed from the ship date, with the discount as score
LINE_SQL = """SELECT l_returnflag AS y_true, CASE WHEN l_extendedprice > 60000 THEN 'A' WHEN l_quantity > 20 THEN 'N' ELSE 'Z' END AS y_pred,
  l_extendedprice AS score, (l_orderkey % 5)::INTEGER AS fold FROM lineitem"""


def line_predictions(spark, sf_dir):
    guess = F.when(F.col("l_extendedprice") > 60000, "A").when(F.col("l_quantity") > 20, "N").otherwise("Z")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("y_true"), guess.alias("y_pred"), F.col("l_extendedprice").alias("score"),
        (F.col("l_orderkey") % 5).cast("int").alias("fold"))


# order prices guessed by a linear rule
PRICE_SQL = "SELECT o_orderkey, o_totalprice AS y_true, o_totalprice * 0.9 + (o_custkey % 100) * 300 AS y_pred, (o_orderkey % 3)::INTEGER AS fold FROM orders"


def price_predictions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("y_true"),
        (F.col("o_totalprice") * 0.9 + (F.col("o_custkey") % 100) * 300).alias("y_pred"),
        (F.col("o_orderkey") % 3).cast("int").alias("fold"))


CONFUSION_SQL = f"""WITH p AS ({LINE_SQL}), l AS (SELECT y_true AS v FROM p UNION SELECT y_pred FROM p)
SELECT a.v AS y_true, b.v AS y_pred, (SELECT count(*) FROM p WHERE p.y_true = a.v AND p.y_pred = b.v)::BIGINT AS count FROM l a, l b"""


@query("confusion", CONFUSION_SQL)
def q_confusion(spark, sf_dir):
    predictions = line_predictions(spark, sf_dir)
    labels = sorted(row["label"] for row in evaluate.class_labels(predictions).collect())
    return evaluate.confusion(predictions, labels)


# every seventh truth and every fifth guess is missing
GAPPY_LINE_SQL = f"""SELECT CASE WHEN k % 7 = 0 THEN NULL ELSE y_true END AS y_true, CASE WHEN k % 5 = 0 THEN NULL ELSE y_pred END AS y_pred
  FROM (SELECT *, l_orderkey + l_linenumber AS k FROM ({LINE_SQL.replace('SELECT ', 'SELECT l_orderkey, l_linenumber, ', 1)}))"""


def gappy_predictions(spark, sf_dir):
    k = F.col("l_orderkey") + F.col("l_linenumber")
    guess = F.when(F.col("l_extendedprice") > 60000, "A").when(F.col("l_quantity") > 20, "N").otherwise("Z")
    return table(spark, sf_dir, "lineitem").select(
        F.when(k % 7 != 0, F.col("l_returnflag")).alias("y_true"), F.when(k % 5 != 0, guess).alias("y_pred"))


@query("confusion_missing_labels", f"""WITH p AS ({GAPPY_LINE_SQL})
SELECT coalesce(y_true, '__MISSING__') AS y_true, coalesce(y_pred, '__MISSING__') AS y_pred, count(*)::BIGINT AS count FROM p GROUP BY 1, 2""")
def q_confusion_missing_labels(spark, sf_dir):
    return evaluate.confusion(gappy_predictions(spark, sf_dir))


@query("accuracy_missing_labels", f"""WITH p AS ({GAPPY_LINE_SQL})
SELECT round(avg((y_true IS NOT DISTINCT FROM y_pred)::INTEGER), 9) AS accuracy, count(*)::BIGINT AS n FROM p""")
def q_accuracy_missing_labels(spark, sf_dir):
    predictions = gappy_predictions(spark, sf_dir)
    accuracy = evaluate.classification_metrics(predictions).where("metric = 'accuracy'")
    total = evaluate.confusion(predictions).agg(F.sum("count").alias("n"))
    return rounded(accuracy.select(F.col("value").alias("accuracy")).crossJoin(F.broadcast(total)), 9)


@query("confusion_wide", RULES + """
SELECT y_true, count(*) FILTER (y_pred = '0')::BIGINT AS "0", count(*) FILTER (y_pred = '1')::BIGINT AS "1" FROM p GROUP BY 1""")
def q_confusion_wide(spark, sf_dir):
    return evaluate.confusion_wide(rule_predictions(spark, sf_dir), ["0", "1"])


def _weighted_sql(source, by=""):
    part = f"{by}, " if by else ""
    on = f" AND {{0}}.{by} = l.{by}" if by else ""
    return f"""l AS (SELECT DISTINCT {part}y_true AS v FROM {source} UNION SELECT DISTINCT {part}y_pred FROM {source}),
s AS (SELECT {'l.' + part if by else ''}v, (SELECT count(*) FROM {source} q WHERE q.y_true = v{on.format('q')})::DOUBLE AS support,
  (SELECT count(*) FROM {source} q WHERE q.y_pred = v{on.format('q')})::DOUBLE AS guessed,
  (SELECT count(*) FROM {source} q WHERE q.y_pred = v AND q.y_true = v{on.format('q')})::DOUBLE AS hits FROM l),
w AS (SELECT {part}sum(hits) / sum(support) AS accuracy,
  sum(support * CASE WHEN guessed = 0 THEN 0 ELSE hits / guessed END) / sum(support) AS precision_weighted,
  sum(support * CASE WHEN support = 0 THEN 0 ELSE hits / support END) / sum(support) AS recall_weighted,
  sum(support * CASE WHEN support + guessed = 0 THEN 0 ELSE 2 * hits / (support + guessed) END) / sum(support) AS f1_weighted
  FROM s {'GROUP BY ' + by if by else ''})"""


LONG_CLASS = " UNION ALL ".join(f"SELECT {{by}}'{m}' AS metric, round({m}, 9) AS value FROM w" for m in (
    "accuracy", "precision_weighted", "recall_weighted", "f1_weighted"))


@query("weighted_metrics", f"WITH p AS ({LINE_SQL}), {_weighted_sql('p')} {LONG_CLASS.format(by='')}")
def q_weighted_metrics(spark, sf_dir):
    return rounded(evaluate.classification_metrics(line_predictions(spark, sf_dir)), 9)


@query("weighted_metrics_by_fold", f"WITH p AS ({LINE_SQL}), {_weighted_sql('p', 'fold')} {LONG_CLASS.format(by='fold, ')}")
def q_weighted_metrics_by_fold(spark, sf_dir):
    return rounded(evaluate.classification_metrics(line_predictions(spark, sf_dir), ["fold"]), 9)


@query("fold_summary", f"""WITH p AS ({LINE_SQL}), {_weighted_sql('p', 'fold')},
a AS ({LONG_CLASS.format(by='fold, ').replace(', 9)', ', 15)')})
SELECT metric, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std FROM a GROUP BY 1""")
def q_fold_summary(spark, sf_dir):
    folds = evaluate.classification_metrics(line_predictions(spark, sf_dir), ["fold"])
    return rounded(evaluate.summarize_folds(folds), 8)


def _auc_sql(source, positive):
    return f"""g AS (SELECT score, sum((y_true = '{positive}')::INT)::DOUBLE AS pos, sum((y_true <> '{positive}')::INT)::DOUBLE AS neg FROM {source} GROUP BY 1),
b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT 'roc_auc' AS metric, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS value FROM b"""


@query("auc", f"{RULES}, {_auc_sql('p', '1')}")
def q_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(rule_predictions(spark, sf_dir), "1"), 9)


@query("auc_many_scores", f"WITH p AS ({LINE_SQL}), {_auc_sql('p', 'R')}")
def q_auc_many_scores(spark, sf_dir):
    return rounded(evaluate.roc_auc(line_predictions(spark, sf_dir), "R"), 9)


def _regression_sql(by=""):
    group = f"GROUP BY {by}" if by else ""
    part = f"{by}, " if by else ""
    return f"""w AS (SELECT {part}1 - avg(pow(y_true - y_pred, 2)) / var_pop(y_true) AS r2, avg(abs(y_true - y_pred)) AS mae,
  sqrt(avg(pow(y_true - y_pred, 2))) AS rmse FROM p {group})
""" + " UNION ALL ".join(f"SELECT {part}'{m}' AS metric, round({m}, 6) AS value FROM w" for m in ("r2", "mae", "rmse"))


@query("regression_metrics", f"WITH p AS ({PRICE_SQL}), {_regression_sql()}")
def q_regression_metrics(spark, sf_dir):
    return rounded(evaluate.regression_metrics(price_predictions(spark, sf_dir)), 6)


@query("regression_metrics_by_fold", f"WITH p AS ({PRICE_SQL}), {_regression_sql('fold')}")
def q_regression_metrics_by_fold(spark, sf_dir):
    return rounded(evaluate.regression_metrics(price_predictions(spark, sf_dir), ["fold"]), 6)


@query("ideal_line", f"""WITH p AS ({PRICE_SQL})
SELECT round(least(min(y_true), min(y_pred)), 6) AS low, round(greatest(max(y_true), max(y_pred)), 6) AS high FROM p""")
def q_ideal_line(spark, sf_dir):
    return rounded(charts.ideal_line(price_predictions(spark, sf_dir)), 6)


@query("prediction_points", f"""WITH p AS ({PRICE_SQL})
SELECT y_true, round(y_pred, 6) AS y_pred FROM p
ORDER BY ('0x' || substr(md5('42:' || o_orderkey::VARCHAR), 1, 8))::BIGINT, y_true LIMIT 200""")
def q_prediction_points(spark, sf_dir):
    return rounded(charts.prediction_points(price_predictions(spark, sf_dir), F.col("o_orderkey"), 200), 6)
