"""Report queries."""

from pyspark.sql import functions as F

from tabloom.plans.report import (
    conclusions, metric_facts, report_facts, report_lines, target_summary,
)
from tabloom.operators import evaluate
from tabloom.operators.lanes import union_all
from tabloom.plans.training import ModelConfig, train_model
from tabloom.session import scratch_folder
from tabloom.sources.sinks import write_report
from workload.evaluation import LINE_SQL, LONG_CLASS, _weighted_sql, line_predictions
from workload.fixtures import GAPPY_ORDERS_SQL, gappy_orders
from workload.modelling import FEATURES_OF, document_quality
from workload.profile import GAPPY_TYPES
from workload.registry import ORACLES, query

NAMES = [name for name, _ in GAPPY_TYPES]
OTHERS = [name for name in NAMES if name != "o_orderpriority"]
PCT = "printf('%.2f%%', {0} * 100)"

STATS = " UNION ALL ".join(
    f"SELECT '{n}' AS c, '{t}' AS dtype, (count(*) - count({n}))::BIGINT AS miss, (count(*) - count({n}))::DOUBLE / count(*) AS ratio, count(DISTINCT {n}) AS uniq FROM d"
    for n, t in GAPPY_TYPES)
TOTALS = """SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS dup,
  2 * count(*) - count(o_totalprice) - count(o_orderpriority) AS miss FROM d"""


def _fences(column):
    return f"""SELECT '{column}' AS c, (SELECT count(*) FROM d WHERE {column} < lo OR {column} > hi) AS n,
  (SELECT avg(CASE WHEN {column} < lo OR {column} > hi THEN 1.0 ELSE 0.0 END) FROM d WHERE {column} IS NOT NULL) AS ratio, lo, hi
  FROM (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM d))"""


PURE = " UNION ALL ".join(
    f"SELECT '{c}' AS c FROM (SELECT {c}, count(DISTINCT o_orderpriority) AS k FROM d WHERE {c} IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1) HAVING count(*) >= 10 AND avg((k <= 1)::INT) > 0.95"
    for c in OTHERS)

CONCLUSIONS_SQL = f"""
SELECT 1 AS ord, 'shape' AS code, 'The table has ' || n_rows || ' rows and 6 columns; ' || dup || ' rows are duplicates.' AS sentence FROM t
UNION ALL SELECT 2, 'missing', 'Overall ' || {PCT.format('miss::DOUBLE / (6 * n_rows)')} || ' of the cells are missing; look at the sparse columns first.' FROM t
UNION ALL SELECT 3, 'target', '`o_orderpriority` is the target of a classification task.'
UNION ALL (SELECT 4, 'worst_column', '`' || c || '` misses the most cells: ' || {PCT.format('ratio')} || '.' FROM s WHERE ratio > 0 ORDER BY ratio DESC, c LIMIT 1)"""


@query("conclusions", f"WITH d AS ({GAPPY_ORDERS_SQL}), t AS ({TOTALS}), s AS ({STATS}) {CONCLUSIONS_SQL}")
def q_conclusions(spark, sf_dir):
    return conclusions(gappy_orders(spark, sf_dir), "o_orderpriority", "classification")


@query("report_facts", f"""WITH d AS ({GAPPY_ORDERS_SQL}), t AS ({TOTALS}), s AS ({STATS}),
o AS ({' UNION ALL '.join(_fences(c) for c in ('o_orderkey', 'o_custkey', 'o_totalprice'))}),
p AS ({PURE}), f AS (SELECT coalesce(o_orderpriority, '<missing>') AS v, count(*) AS n FROM d GROUP BY 1)
SELECT 'overview' AS section, 1 AS ord, 'n_rows' AS item, n_rows::VARCHAR AS value FROM t
UNION ALL SELECT 'overview', 2, 'n_columns', '6' FROM t UNION ALL SELECT 'overview', 3, 'duplicate_rows', dup::VARCHAR FROM t
UNION ALL SELECT 'overview', 4, 'total_missing_cells', miss::VARCHAR FROM t
UNION ALL SELECT 'overview', 5, 'missing_cell_ratio', {PCT.format('miss::DOUBLE / (6 * n_rows)')} FROM t
UNION ALL SELECT 'roles', 1, 'numeric', 'o_orderkey, o_custkey, o_totalprice'
UNION ALL SELECT 'roles', 2, 'categorical', 'o_orderstatus, o_orderpriority'
UNION ALL SELECT 'roles', 3, 'high_cardinality', 'none' UNION ALL SELECT 'roles', 4, 'datetime', 'o_orderdate'
UNION ALL SELECT 'missing', (row_number() OVER (ORDER BY ratio DESC, miss DESC, c))::INTEGER, c,
  dtype || '; ' || miss || '; ' || {PCT.format('ratio')} || '; ' || uniq FROM s
UNION ALL SELECT 'outliers', (row_number() OVER (ORDER BY ratio DESC, c))::INTEGER, c,
  n || '; ' || {PCT.format('ratio')} || '; ' || printf('%.4f', lo) || '; ' || printf('%.4f', hi) FROM o
UNION ALL SELECT 'leakage', (row_number() OVER (ORDER BY c))::INTEGER, c, '3; most values determine the target: an id or a leak' FROM p
UNION ALL SELECT 'target', 1, 'source', 'orders' UNION ALL SELECT 'target', 2, 'column', 'o_orderpriority'
UNION ALL SELECT 'target', 3, 'task', 'classification'
UNION ALL SELECT 'target_summary', (row_number() OVER (ORDER BY n DESC, v))::INTEGER, v, n::VARCHAR FROM f
UNION ALL SELECT 'conclusions', ord, code, sentence FROM ({CONCLUSIONS_SQL})""")
def q_report_facts(spark, sf_dir):
    return report_facts(gappy_orders(spark, sf_dir), "orders", "o_orderpriority", "classification")


HEADINGS_SQL = """SELECT * FROM (VALUES (0, 'overview', '1. Overview'), (1, 'roles', '2. Column roles'), (2, 'missing', '3. Missing values'),
  (3, 'outliers', '4.1 Outliers (IQR)'), (4, 'leakage', '4.2 Leakage risk'), (5, 'high_cardinality', '4.3 High-cardinality categories'),
  (6, 'target', '5. Target'), (7, 'target_summary', '5.1 Target summary'), (8, 'model', '6. Model settings'), (9, 'metrics', '7. Model metrics'),
  (10, 'cv', '7.1 Cross-validation'), (11, 'best_params', '7.2 Best parameters'), (12, 'conclusions', '8. Conclusions')) AS h(place, section, title)"""


@query("report_lines", f"""WITH facts AS ({ORACLES['report_facts']}), h AS ({HEADINGS_SQL}),
l AS (SELECT place, ord AS row, CASE WHEN section = 'conclusions' THEN '- ' || value ELSE '| ' || item || ' | ' || coalesce(value, '') || ' |' END AS line
  FROM facts JOIN h USING (section)
 UNION ALL SELECT place, unnest(range(len(head))) - 10, unnest(head) FROM (SELECT place,
  CASE WHEN section = 'conclusions' THEN ['', '## ' || title, ''] ELSE ['', '## ' || title, '', '| item | value |', '|---|---|'] END AS head FROM h))
SELECT (row_number() OVER (ORDER BY place, row, line))::INTEGER AS ord, line FROM l""")
def q_report_lines(spark, sf_dir):
    return report_lines(report_facts(gappy_orders(spark, sf_dir), "orders", "o_orderpriority", "classification"))


@query("report_sink", f"SELECT line, count(*)::BIGINT AS n FROM ({ORACLES['report_lines']}) GROUP BY 1")
def q_report_sink(spark, sf_dir):
    folder = scratch_folder(spark, "report")
    facts = report_facts(gappy_orders(spark, sf_dir), "orders", "o_orderpriority", "classification")
    write_report(facts, report_lines(facts), folder)
    return spark.read.text(f"{folder}/report").groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


# facts per section; which columns look like leaks depends on the data and is left out
@query("report_with_model", """SELECT section, n FROM (VALUES ('overview', 5), ('roles', 4), ('missing', 6), ('outliers', 4), ('target', 3),
  ('target_summary', 2), ('model', 10), ('metrics', 5), ('cv', 2), ('conclusions', 6)) AS f(section, n)""")
def q_report_with_model(spark, sf_dir):
    df = document_quality(spark, sf_dir)
    config = ModelConfig("quality", "classification", "Logistic Regression", use_cv=True)
    result = train_model(df, config, F.col("key"), features=FEATURES_OF[document_quality])
    facts = report_facts(df.drop("key"), "documents", "quality", "classification", config, result)
    return facts.where("section != 'leakage'").groupBy("section").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("report_metrics", f"""WITH p AS ({LINE_SQL}), {_weighted_sql('p')},
m AS ({LONG_CLASS.format(by='')} UNION ALL SELECT 'roc_auc', NULL)
SELECT 'metrics' AS section, (row_number() OVER (ORDER BY metric))::INTEGER AS ord, metric AS item,
  CASE WHEN value IS NULL THEN 'n/a' ELSE printf('%.4f', value) END AS value FROM m""")
def q_report_metrics(spark, sf_dir):
    return metric_facts(evaluate.metrics_table(line_predictions(spark, sf_dir), "classification"))


@query("target_summary", f"""WITH d AS ({GAPPY_ORDERS_SQL}), m AS (SELECT count(o_totalprice)::DOUBLE AS count, avg(o_totalprice) AS mean,
  stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS p25,
  quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75, max(o_totalprice) AS max FROM d)
""" + " UNION ALL ".join(
    f"SELECT 'price' AS target, {i + 1} AS ord, '{c}' AS item, printf('%.4f', {c}) AS value FROM m"
    for i, c in enumerate(("count", "mean", "std", "min", "p25", "p50", "p75", "max"))) + """
UNION ALL SELECT 'priority', (row_number() OVER (ORDER BY n DESC, v))::INTEGER, v, n::VARCHAR FROM (
  SELECT coalesce(o_orderpriority, '<missing>') AS v, count(*) AS n FROM d GROUP BY 1)""")
def q_target_summary(spark, sf_dir):
    df = gappy_orders(spark, sf_dir)
    return union_all([
        target_summary(df, name, task).select(F.lit(label).alias("target"), "ord", "item", "value")
        for label, name, task in (("price", "o_totalprice", "regression"), ("priority", "o_orderpriority", "classification"))])
