"""Quality queries: gates, warnings, outliers, correlation, leakage, chart data."""

from pyspark.sql import functions as F

from tabloom.operators import charts
from tabloom.operators.correlation import correlation, upper_triangle
from tabloom.operators.lanes import union_all
from tabloom.operators.leakage import class_purity, equality_ratio, leakage_report, target_correlation
from tabloom.operators.quality import (
    dataset_warnings, high_cardinality_report, iqr_outliers, needs_grouping, target_gate,
)
from workload.fixtures import (
    GAPPY_ORDERS_SQL, LEAKY_ORDERS_SQL, STRETCHED_SQL, gappy_orders, leaky_orders, stretched_lineitem,
)
from workload.registry import query, rounded, table

GAPPY = f"WITH d AS ({GAPPY_ORDERS_SQL})"
STRETCHED = f"WITH s AS ({STRETCHED_SQL})"
LEAKY = f"WITH k AS ({LEAKY_ORDERS_SQL})"
STRETCHED_COLUMNS = ["quantity4", "price3", "l_discount", "l_tax"]


def _gate_sql(source, column):
    return f"""SELECT '{column}' AS target, CASE WHEN missing_ratio > 0.5 THEN false WHEN unique_count < 2 THEN false
   WHEN usable_rows < 10 THEN false ELSE true END AS ok,
  CASE WHEN missing_ratio > 0.5 THEN 'too_many_missing' WHEN unique_count < 2 THEN 'too_few_values'
   WHEN usable_rows < 10 THEN 'too_few_rows' WHEN missing_ratio > 0 THEN 'some_missing' ELSE 'ok' END AS code,
  CASE WHEN missing_ratio > 0.5 THEN 'target is missing in ' || printf('%.1f%%', 100 * missing_ratio) || ' of the rows: clean it first'
   WHEN unique_count < 2 THEN 'target has fewer than 2 distinct values' WHEN usable_rows < 10 THEN 'fewer than 10 rows are left without missing targets'
   WHEN missing_ratio > 0 THEN 'target is missing in ' || printf('%.1f%%', 100 * missing_ratio) || ' of the rows: they are dropped' ELSE '' END AS message,
  round(missing_ratio, 9) AS missing_ratio, unique_count, usable_rows, n_rows FROM (
  SELECT count(*)::BIGINT AS n_rows, (count(*) - count({column}))::DOUBLE / count(*) AS missing_ratio,
   count(DISTINCT {column})::BIGINT AS unique_count, count({column})::BIGINT AS usable_rows FROM {source})"""


@query("target_gate", f"""WITH d AS ({GAPPY_ORDERS_SQL}),
h AS (SELECT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS mostly_missing, 'one' AS constant FROM orders)
{_gate_sql('d', 'o_totalprice')} UNION ALL {_gate_sql('d', 'o_orderstatus')}
UNION ALL {_gate_sql('h', 'mostly_missing')} UNION ALL {_gate_sql('h', 'constant')}
UNION ALL {_gate_sql('region', 'r_name')}""")
def q_target_gate(spark, sf_dir):
    gappy = gappy_orders(spark, sf_dir)
    hard = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("mostly_missing"),
        F.lit("one").alias("constant"))
    wanted = [(gappy, "o_totalprice"), (gappy, "o_orderstatus"), (hard, "mostly_missing"), (hard, "constant"),
              (table(spark, sf_dir, "region"), "r_name")]
    return rounded(union_all([
        target_gate(df, name).withColumn("target", F.lit(name)) for df, name in wanted]), 9)


def _high_sql(column):
    share = f"count(DISTINCT {column}) >= 0.5 * count({column})"
    return f"CASE WHEN count(DISTINCT {column}) >= 50 OR (count(DISTINCT {column}) >= 15 AND {share}) THEN '{column}' END"


NATION_COLUMNS = 60


@query("dataset_warnings", f"""
WITH few AS (SELECT 'few_rows' AS code, 'fewer than 30 rows: results only show that the flow works' AS message),
h AS (SELECT list_filter([{', '.join(_high_sql(c) for c in ('p_name', 'p_brand', 'p_type'))}], lambda x: x IS NOT NULL) AS names FROM part)
SELECT 'orders' AS source, 'high_missing' AS code, 'some columns miss at least half of their cells: drop or complete them' AS message FROM orders
 HAVING count(CASE WHEN o_orderstatus = 'P' THEN 1 END) <= count(*) / 2
UNION ALL SELECT 'part', 'high_cardinality', 'high-cardinality columns: ' || array_to_string(names[1:5], ', ') || '; rare values are grouped before modelling'
 FROM h WHERE len(names) > 0
UNION ALL SELECT 'region', code, message FROM few WHERE (SELECT count(*) FROM region) < 30
UNION ALL SELECT 'nation', code, message FROM few WHERE (SELECT count(*) FROM nation) < 30
UNION ALL SELECT 'nation', 'many_columns', 'many columns for the number of rows: a baseline model may overfit'
 WHERE {NATION_COLUMNS} > (SELECT greatest(50, 2 * count(*)) FROM nation)""")
def q_dataset_warnings(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("partial_price"))
    nation = table(spark, sf_dir, "nation").select(*[(F.col("n_nationkey") + i).alias(f"n{i}") for i in range(NATION_COLUMNS)])
    sources = {"orders": orders, "part": table(spark, sf_dir, "part"), "region": table(spark, sf_dir, "region"), "nation": nation}
    return union_all([
        dataset_warnings(df).select(F.lit(name).alias("source"), "code", "message") for name, df in sources.items()])


@query("high_cardinality", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c})::BIGINT AS unique_count,
  round(count(DISTINCT {c})::DOUBLE / greatest(count({c}), 1), 9) AS unique_ratio,
  CASE WHEN count(DISTINCT {c}) >= 50 OR (count(DISTINCT {c}) >= 15 AND count(DISTINCT {c})::DOUBLE / greatest(count({c}), 1) >= 0.5)
   THEN 'Rare category grouping + OneHot' ELSE 'OneHot' END AS recommended_action FROM part"""
    for c in ("p_name", "p_brand", "p_type")))
def q_high_cardinality(spark, sf_dir):
    return rounded(high_cardinality_report(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"]), 9)


@query("needs_grouping", """
SELECT "column", unique_count FROM (
  SELECT 'text' AS "column", count(DISTINCT text)::BIGINT AS unique_count, count(*) AS n FROM documents
  UNION ALL SELECT 'lang', count(DISTINCT lang), count(*) FROM documents
  UNION ALL SELECT 'source', count(DISTINCT source), count(*) FROM documents)
WHERE unique_count >= 50 OR (unique_count >= 15 AND unique_count >= 0.5 * n)""")
def q_needs_grouping(spark, sf_dir):
    report = high_cardinality_report(table(spark, sf_dir, "documents"), ["text", "lang", "source"])
    return needs_grouping(report).select("column", "unique_count")


def _outlier_sql(column, source):
    return f"""SELECT '{column}' AS "column",
  sum(CASE WHEN iqr <> 0 AND (x < q1 - 1.5 * iqr OR x > q3 + 1.5 * iqr) THEN 1 ELSE 0 END)::BIGINT AS outlier_count,
  round(avg(CASE WHEN iqr <> 0 AND (x < q1 - 1.5 * iqr OR x > q3 + 1.5 * iqr) THEN 1.0 ELSE 0.0 END), 9) AS outlier_ratio,
  round(any_value(q1 - 1.5 * iqr), 4) AS lower_bound, round(any_value(q3 + 1.5 * iqr), 4) AS upper_bound
FROM (SELECT {column}::DOUBLE AS x FROM {source} WHERE {column} IS NOT NULL),
  (SELECT q1, q3, q3 - q1 AS iqr FROM (SELECT quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {source}))"""


OUTLIER_SQL = STRETCHED + "\nUNION ALL\n".join(_outlier_sql(c, "s") for c in STRETCHED_COLUMNS)


def _outliers(spark, sf_dir):
    report = iqr_outliers(stretched_lineitem(spark, sf_dir), STRETCHED_COLUMNS)
    return rounded(rounded(report, 9, ["outlier_ratio"]), 4, ["lower_bound", "upper_bound"])


@query("iqr_outliers", OUTLIER_SQL)
def q_iqr_outliers(spark, sf_dir):
    return _outliers(spark, sf_dir)


@query("outlier_bar", f'SELECT "column", outlier_ratio FROM ({OUTLIER_SQL})')
def q_outlier_bar(spark, sf_dir):
    return rounded(charts.outlier_bar(stretched_lineitem(spark, sf_dir), STRETCHED_COLUMNS), 9)


def _corr_sql(columns, source, round_to=8):
    pairs = [(a, b) for a in columns for b in columns]
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, {round_to}) AS corr FROM {source}"
        for a, b in pairs)


@query("correlation_long", _corr_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], "lineitem"))
def q_correlation_long(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    return rounded(correlation(table(spark, sf_dir, "lineitem"), names), 8)


@query("correlation_with_nulls", GAPPY + f"""
SELECT * FROM ({_corr_sql(['o_orderkey', 'o_custkey', 'o_totalprice'], 'd')}) WHERE x < y""")
def q_correlation_with_nulls(spark, sf_dir):
    return rounded(upper_triangle(correlation(
        gappy_orders(spark, sf_dir), ["o_orderkey", "o_custkey", "o_totalprice"])), 8)


def _histogram_sql(column, source, bins=30):
    return f"""SELECT '{column}' AS "column", b.bucket::INTEGER AS bucket,
  round(lo + (b.bucket - 1) * (hi - lo) / {bins}, 6) AS lo,
  round(CASE WHEN b.bucket = {bins} THEN hi ELSE lo + b.bucket * ((hi - lo) / {bins}) END, 6) AS hi,
  coalesce(c.n, 0)::BIGINT AS count
FROM (SELECT unnest(range(1, {bins} + 1)) AS bucket) b
CROSS JOIN (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {source}) m
LEFT JOIN (SELECT least(floor({bins} * ({column} - lo) / (hi - lo))::INTEGER + 1, {bins}) AS bucket, count(*) AS n
  FROM {source}, (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {source}) GROUP BY 1) c
  ON c.bucket = b.bucket"""


@query("histogram", _histogram_sql("l_extendedprice", "lineitem") + "\nUNION ALL\n" + _histogram_sql("l_partkey", "lineitem"))
def q_histogram(spark, sf_dir):
    return rounded(charts.histogram(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_partkey"]), 6)


@query("target_distribution_regression", _histogram_sql("o_totalprice", "orders"))
def q_target_distribution_regression(spark, sf_dir):
    return rounded(charts.target_distribution(table(spark, sf_dir, "orders"), "o_totalprice", "regression"), 6)


@query("target_distribution_classification", """
SELECT 'p_brand' AS "column", value, cnt, rank FROM (
 SELECT p_brand AS value, count(*)::BIGINT AS cnt, (row_number() OVER (ORDER BY count(*) DESC, p_brand))::INTEGER AS rank
 FROM part GROUP BY 1) WHERE rank <= 30""")
def q_target_distribution_classification(spark, sf_dir):
    return charts.target_distribution(table(spark, sf_dir, "part"), "p_brand", "classification")


@query("box_summary", STRETCHED + "\nUNION ALL\n".join(
    f"""SELECT o."column", round(m.lo, 4) AS min, round(m.p25, 4) AS p25, round(m.p50, 4) AS p50, round(m.p75, 4) AS p75,
  round(m.hi, 4) AS max, o.lower_bound, o.upper_bound, o.outlier_count FROM ({_outlier_sql(c, 's')}) o,
  (SELECT min({c}) AS lo, max({c}) AS hi, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
   quantile_cont({c}, 0.75) AS p75 FROM s) m""" for c in ("quantity4", "price3")))
def q_box_summary(spark, sf_dir):
    return rounded(charts.box_summary(stretched_lineitem(spark, sf_dir), ["quantity4", "price3"]), 4)


@query("missing_bar", GAPPY + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", round((count(*) - count({c}))::DOUBLE / count(*), 9) AS missing_ratio FROM d"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def q_missing_bar(spark, sf_dir):
    return rounded(charts.missing_bar(gappy_orders(spark, sf_dir)), 9)


@query("correlation_cells", _corr_sql(["c_custkey", "c_nationkey", "c_acctbal"], "customer"))
def q_correlation_cells(spark, sf_dir):
    return rounded(charts.correlation_cells(
        table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey", "c_acctbal"]), 8)


def _purity_sql(source, target, columns):
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count(*)::BIGINT AS distinct_values, round(avg(CASE WHEN k <= 1 THEN 1.0 ELSE 0.0 END), 9) AS purity
FROM (SELECT {c}, count(DISTINCT {target}) AS k FROM {source} WHERE {c} IS NOT NULL AND {target} IS NOT NULL GROUP BY 1)"""
        for c in columns)


@query("purity", _purity_sql("lineitem", "l_returnflag", ["l_orderkey", "l_extendedprice", "l_shipdate", "l_tax", "l_linestatus"]))
def q_purity(spark, sf_dir):
    names = ["l_orderkey", "l_extendedprice", "l_shipdate", "l_tax", "l_linestatus"]
    return rounded(class_purity(table(spark, sf_dir, "lineitem"), "l_returnflag", names), 9)


@query("equality_ratio", LEAKY + """
SELECT 'final_result' AS "column", round(avg((final_result IS NOT DISTINCT FROM o_orderstatus)::INT), 9) AS equal_ratio FROM k
UNION ALL SELECT 'o_orderpriority', round(avg((o_orderpriority IS NOT DISTINCT FROM o_orderstatus)::INT), 9) FROM k
UNION ALL SELECT 'o_custkey', round(avg((o_custkey::VARCHAR IS NOT DISTINCT FROM o_orderstatus)::INT), 9) FROM k""")
def q_equality_ratio(spark, sf_dir):
    return rounded(equality_ratio(
        leaky_orders(spark, sf_dir), "o_orderstatus", ["final_result", "o_orderpriority", "o_custkey"]), 9)


@query("target_correlation", """
SELECT 'l_quantity' AS "column", round(corr(l_quantity, l_extendedprice), 8) AS corr FROM lineitem
UNION ALL SELECT 'l_tax', round(corr(l_tax, l_extendedprice), 8) FROM lineitem""")
def q_target_correlation(spark, sf_dir):
    return rounded(target_correlation(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"]), 8)


def _codes_text(report):
    return report.select("column", "risk_score", F.array_join("reason_codes", ",").alias("codes"))


@query("leakage_classification", LEAKY + f""", p AS ({_purity_sql('k', 'o_orderstatus', ['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderpriority', 'final_result'])}),
e AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, avg(({c}::VARCHAR IS NOT DISTINCT FROM o_orderstatus)::INT) AS eq FROM k" for c in ('o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderpriority', 'final_result'))}),
r AS (SELECT p."column", p."column" = 'final_result' AS risky, e.eq > 0.95 AS same, p.distinct_values >= 10 AND p.purity > 0.95 AS pure
  FROM p JOIN e ON e.col = p."column")
SELECT "column", (CASE WHEN risky THEN 2 ELSE 0 END + CASE WHEN same THEN 5 ELSE 0 END + CASE WHEN pure THEN 3 ELSE 0 END)::INTEGER AS risk_score,
  concat_ws(',', CASE WHEN risky THEN 'risky_keyword' END, CASE WHEN same THEN 'equal_values' END, CASE WHEN pure THEN 'pure_values' END) AS codes
FROM r WHERE risky OR same OR pure""")
def q_leakage_classification(spark, sf_dir):
    return _codes_text(leakage_report(leaky_orders(spark, sf_dir), "o_orderstatus"))


@query("leakage_reasons", LEAKY + f""", c AS (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS orderstatus, final_result, o_orderstatus FROM k),
p AS ({_purity_sql('c', 'o_orderstatus', ['o_orderkey', 'orderstatus', 'final_result'])}),
e AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, avg(({c}::VARCHAR IS NOT DISTINCT FROM o_orderstatus)::INT) AS eq FROM c" for c in ('o_orderkey', 'orderstatus', 'final_result'))}),
r AS (SELECT p."column", p."column" = 'orderstatus' AS near, p."column" = 'final_result' AS risky, e.eq > 0.95 AS same, eq,
  p.distinct_values >= 10 AND p.purity > 0.95 AS pure FROM p JOIN e ON e.col = p."column")
SELECT "column", (CASE WHEN near THEN 3 ELSE 0 END + CASE WHEN risky THEN 2 ELSE 0 END + CASE WHEN same THEN 5 ELSE 0 END + CASE WHEN pure THEN 3 ELSE 0 END)::INTEGER AS risk_score,
  concat_ws(',', CASE WHEN near THEN 'name_overlap' END, CASE WHEN risky THEN 'risky_keyword' END, CASE WHEN same THEN 'equal_values' END, CASE WHEN pure THEN 'pure_values' END) AS codes,
  concat_ws('; ', CASE WHEN near THEN 'column name is very close to the target name' END,
   CASE WHEN risky THEN 'column name holds a risky word such as label or outcome' END,
   CASE WHEN same THEN 'equal to the target in ' || printf('%.1f%%', 100 * eq) || ' of the rows' END,
   CASE WHEN pure THEN 'most values determine the target: an id or a leak' END) AS reasons
FROM r WHERE near OR risky OR same OR pure""")
def q_leakage_reasons(spark, sf_dir):
    leaky = leaky_orders(spark, sf_dir).select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("orderstatus"), "final_result", "o_orderstatus")
    report = leakage_report(leaky, "o_orderstatus")
    return report.select("column", "risk_score", F.array_join("reason_codes", ",").alias("codes"), "reasons")


LEAKY_PRICE_SQL = """SELECT l_quantity, l_tax, l_discount, l_extendedprice * (1 - l_discount / 100) AS net,
  l_extendedprice AS price_copy, l_extendedprice FROM lineitem"""


@query("leakage_regression", f"""WITH k AS ({LEAKY_PRICE_SQL}),
c AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, abs(corr({c}, l_extendedprice)) > 0.98 AS high, avg(({c} = l_extendedprice)::INT) > 0.95 AS same FROM k" for c in ('l_quantity', 'l_tax', 'l_discount', 'net', 'price_copy'))})
SELECT col AS "column", (CASE WHEN same THEN 5 ELSE 0 END + CASE WHEN high THEN 4 ELSE 0 END)::INTEGER AS risk_score,
  concat_ws(',', CASE WHEN same THEN 'equal_values' END, CASE WHEN high THEN 'high_correlation' END) AS codes
FROM c WHERE high OR same""")
def q_leakage_regression(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    leaky = lineitem.select(
        "l_quantity", "l_tax", "l_discount",
        (F.col("l_extendedprice") * (1 - F.col("l_discount") / 100)).alias("net"),
        F.col("l_extendedprice").alias("price_copy"), "l_extendedprice")
    return _codes_text(leakage_report(leaky, "l_extendedprice"))


# thirty columns made of two, a third of their cells missing
WIDE = [f"w{i}" for i in range(30)]
WIDE_SQL = "SELECT " + ", ".join(
    f"CASE WHEN (l_orderkey + {i}) % 3 = 0 THEN NULL ELSE l_quantity * {i + 1} + l_extendedprice / {i + 7} END AS w{i}" for i in range(30)) + " FROM lineitem"


@query("correlation_wide", f"WITH w AS ({WIDE_SQL}), m AS (SELECT " + ", ".join(
    f"corr({a}, {b}) AS {a}_{b}" for a in WIDE for b in WIDE) + """ FROM w)
SELECT split_part(pair, '_', 1) AS x, split_part(pair, '_', 2) AS y, round(corr, 6) AS corr FROM (UNPIVOT m ON COLUMNS(*) INTO NAME pair VALUE corr)""")
def q_correlation_wide(spark, sf_dir):
    cells = [
        F.when((F.col("l_orderkey") + i) % 3 != 0, F.col("l_quantity") * (i + 1) + F.col("l_extendedprice") / (i + 7)).alias(name)
        for i, name in enumerate(WIDE)]
    return rounded(correlation(table(spark, sf_dir, "lineitem").select(*cells), WIDE), 6)
