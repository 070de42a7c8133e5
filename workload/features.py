"""Feature preparation queries: imputation, scaling, grouping, encoding, splits, folds."""

from pyspark.sql import functions as F

from tabloom.operators import splits
from tabloom.operators.features import (
    CategoryEncoder, ModeImputer, NumericEncoder, RareCategoryGrouper, TablePreprocessor, class_weights,
    encode_labels, feature_names, label_classes, one_hot_long,
)
from tabloom.operators.fold_stats import complement_categories, complement_quantiles
from tabloom.operators.lanes import local_table, union_all
from workload.fixtures import GAPPY_ORDERS_SQL, gappy_orders
from workload.registry import query, rounded, table

GAPPY = f"WITH d AS ({GAPPY_ORDERS_SQL})"
HASH = "('0x' || substr(md5('42:' || {k}::VARCHAR), 1, 8))::BIGINT"


@query("median_impute", GAPPY + """
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM d)), 4) AS price FROM d""")
def q_median_impute(spark, sf_dir):
    df = gappy_orders(spark, sf_dir)
    model = NumericEncoder(inputCols=["o_totalprice"], outputCols=["price"], scale=False).fit(df)
    return rounded(model.transform(df).select("o_orderkey", "price"), 4)


FOLDED = GAPPY + """,
b AS (SELECT *, (('0x' || substr(md5('43:' || o_orderkey::VARCHAR), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM d),
h AS (SELECT * FROM b JOIN (SELECT unnest(range(5))::INTEGER AS held) ON fold <> held)"""


def _folded(spark, sf_dir):
    return splits.hash_folds(gappy_orders(spark, sf_dir), F.col("o_orderkey"), 5, 43)


@query("median_impute_by_fold", FOLDED + """
SELECT held, 'o_totalprice' AS "column", count(o_totalprice)::BIGINT AS n, count(*)::BIGINT AS n_rows, round(avg(o_totalprice), 4) AS mean,
  round(sqrt(var_pop(o_totalprice)), 4) AS deviation, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM h GROUP BY held
UNION ALL SELECT held, 'o_custkey', count(o_custkey), count(*), round(avg(o_custkey), 4), round(sqrt(var_pop(o_custkey)), 4),
  round(quantile_cont(o_custkey::DOUBLE, 0.5), 4) FROM h GROUP BY held""")
def q_median_impute_by_fold(spark, sf_dir):
    found = complement_quantiles(_folded(spark, sf_dir), ["o_totalprice", "o_custkey"], "fold", 5)
    return rounded(found.select(
        "held", "column", "n", "n_rows", "mean", F.sqrt("variance").alias("deviation"), F.col("q").alias("median")), 4)


@query("categories_by_fold", FOLDED + """,
c AS (SELECT held, o_orderpriority AS value, count(*) AS cnt FROM h WHERE o_orderpriority IS NOT NULL GROUP BY ALL),
m AS (SELECT held, count(*) FILTER (o_orderpriority IS NULL) AS missing FROM h GROUP BY held)
SELECT held, value, cnt::BIGINT AS cnt, row_number() OVER (PARTITION BY held ORDER BY cnt DESC, value)::INTEGER AS rank, missing::BIGINT AS missing
FROM c JOIN m USING (held) QUALIFY rank <= 3""")
def q_categories_by_fold(spark, sf_dir):
    found = complement_categories(_folded(spark, sf_dir), ["o_orderpriority"], F.col("fold"), 5, 3)
    rows = [
        (held, value, cnt, rank + 1, entry["o_orderpriority"]["missing"])
        for held, entry in enumerate(found) for rank, (value, cnt) in enumerate(entry["o_orderpriority"]["top"])
    ]
    return local_table(spark, rows, "held int, value string, cnt bigint, rank int, missing bigint")


@query("scale", GAPPY + """,
i AS (SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM d)) AS price, o_custkey FROM d)
SELECT o_orderkey, round((price - (SELECT avg(price) FROM i)) / (SELECT stddev_pop(price) FROM i), 6) AS price,
  round((o_custkey - (SELECT avg(o_custkey) FROM i)) / (SELECT stddev_pop(o_custkey) FROM i), 6) AS cust FROM i""")
def q_scale(spark, sf_dir):
    df = gappy_orders(spark, sf_dir)
    model = NumericEncoder(inputCols=["o_totalprice", "o_custkey"], outputCols=["price", "cust"]).fit(df)
    return rounded(model.transform(df).select("o_orderkey", "price", "cust"), 6)


@query("mode_impute", GAPPY + """
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM d WHERE o_orderpriority IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM d""")
def q_mode_impute(spark, sf_dir):
    df = gappy_orders(spark, sf_dir)
    model = ModeImputer(inputCols=["o_orderpriority"], outputCols=["priority"]).fit(df)
    return model.transform(df).select("o_orderkey", "priority")


def _keep_sql(column, source, share, k):
    """Kept values of one column, with the fallback when nothing is frequent enough."""
    return f"""(SELECT value FROM (SELECT coalesce({column}::VARCHAR, '__MISSING__') AS value, count(*) AS n,
    row_number() OVER (ORDER BY count(*) DESC, coalesce({column}::VARCHAR, '__MISSING__')) AS rn FROM {source} GROUP BY 1)
   WHERE rn <= {k} AND (n >= greatest(1, ceil({share}::DOUBLE * (SELECT count(*) FROM {source})))
    OR NOT EXISTS (SELECT 1 FROM (SELECT count(*) AS m FROM {source} GROUP BY {column})
      WHERE m >= greatest(1, ceil({share}::DOUBLE * (SELECT count(*) FROM {source}))))))"""


def _grouped_sql(column, source, share, k):
    text = f"coalesce({column}::VARCHAR, '__MISSING__')"
    return f"CASE WHEN {text} IN {_keep_sql(column, source, share, k)} THEN {text} ELSE '__OTHER__' END"


@query("rare_group", f"""
SELECT p_partkey, {_grouped_sql('p_name', 'part', 0.017, 30)} AS name, {_grouped_sql('p_brand', 'part', 0.017, 10)} AS brand,
  {_grouped_sql('p_size', 'part', 0.9, 7)} AS size FROM part""")
def q_rare_group(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    named = RareCategoryGrouper(inputCols=["p_name"], outputCols=["name"], minFrequency=0.017).fit(part)
    branded = RareCategoryGrouper(inputCols=["p_brand"], outputCols=["brand"], minFrequency=0.017, maxCategories=10).fit(part)
    sized = RareCategoryGrouper(inputCols=["p_size"], outputCols=["size"], minFrequency=0.9, maxCategories=7).fit(part)
    return sized.transform(branded.transform(named.transform(part))).select("p_partkey", "name", "brand", "size")


@query("rare_group_with_nulls", GAPPY + f"""
SELECT o_orderkey, {_grouped_sql('o_orderpriority', 'd', 0.1605, 30)} AS priority FROM d""")
def q_rare_group_with_nulls(spark, sf_dir):
    df = gappy_orders(spark, sf_dir)
    model = RareCategoryGrouper(inputCols=["o_orderpriority"], outputCols=["priority"], minFrequency=0.1605).fit(df)
    return model.transform(df).select("o_orderkey", "priority")


ENCODED_SQL = GAPPY + f""",
m AS (SELECT o_orderkey, o_orderstatus, coalesce(o_orderpriority, (SELECT o_orderpriority FROM d WHERE o_orderpriority IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM d),
g AS (SELECT o_orderkey, o_orderstatus, {_grouped_sql('priority', 'm', 0.1605, 30)} AS priority FROM m)"""


@query("onehot_long", ENCODED_SQL + """
SELECT o_orderkey, 'priority' AS "column", priority AS level FROM g
UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM g""")
def q_onehot_long(spark, sf_dir):
    df = gappy_orders(spark, sf_dir)
    model = CategoryEncoder(
        inputCols=["o_orderpriority", "o_orderstatus"], outputCols=["priority", "status"], minFrequency=0.1605).fit(df)
    return one_hot_long(model.transform(df), ["o_orderkey"], ["priority", "status"])


@query("onehot_slots", ENCODED_SQL + """,
l AS (SELECT priority AS level, row_number() OVER (ORDER BY priority) - 1 AS slot FROM g GROUP BY 1)
SELECT o_orderkey, slot::INTEGER AS slot FROM g JOIN l ON l.level = g.priority""")
def q_onehot_slots(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    df = gappy_orders(spark, sf_dir)
    model = TablePreprocessor(categorical=["o_orderpriority"], minFrequency=0.1605).fit(df)
    dense = model.transform(df).select("o_orderkey", vector_to_array("features").alias("v"))
    return dense.select("o_orderkey", (F.array_position("v", F.lit(1.0)) - 1).cast("int").alias("slot"))


@query("feature_names", ENCODED_SQL + """,
l AS (SELECT priority AS level FROM g GROUP BY 1 ORDER BY 1)
SELECT 0 AS slot, 'o_totalprice' AS feature, 'o_totalprice' AS source_column, NULL AS level
UNION ALL SELECT (row_number() OVER (ORDER BY level))::INTEGER, 'o_orderpriority_' || level, 'o_orderpriority', level FROM l""")
def q_feature_names(spark, sf_dir):
    df = gappy_orders(spark, sf_dir)
    model = TablePreprocessor(numeric=["o_totalprice"], categorical=["o_orderpriority"], minFrequency=0.1605).fit(df)
    return feature_names(df, model)


@query("label_encode", """
SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS label FROM orders""")
def q_label_encode(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    classes = label_classes(orders, "o_orderpriority")
    return encode_labels(orders, "o_orderpriority", classes).select("o_orderkey", "label")


@query("class_weights", GAPPY + """, c AS (SELECT o_orderpriority AS label, count(*)::BIGINT AS cnt FROM d WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT label, cnt, round((SELECT sum(cnt) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * cnt::DOUBLE), 9) AS weight FROM c""")
def q_class_weights(spark, sf_dir):
    return rounded(class_weights(gappy_orders(spark, sf_dir), "o_orderpriority"), 9)


@query("hash_split", f"SELECT o_orderkey, {HASH.format(k='o_orderkey')} < 858993459 AS is_test FROM orders")
def q_hash_split(spark, sf_dir):
    return splits.hash_split(table(spark, sf_dir, "orders"), F.col("o_orderkey"), 0.2).select("o_orderkey", "is_test")


@query("fold_assign", f"SELECT o_orderkey, ({HASH.format(k='o_orderkey')} % 5)::INTEGER AS fold FROM orders")
def q_fold_assign(spark, sf_dir):
    return splits.hash_folds(table(spark, sf_dir, "orders"), F.col("o_orderkey"), 5).select("o_orderkey", "fold")


RANKED = f"""SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH.format(k='o_orderkey')}, o_orderkey::VARCHAR) - 1 AS r FROM orders"""


@query("stratified_split", f"SELECT o_orderkey, r < floor(n * 0.25::DOUBLE + 0.5) AS is_test FROM ({RANKED})")
def q_stratified_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return splits.stratified_split(orders, "o_orderstatus", F.col("o_orderkey"), 0.25).select("o_orderkey", "is_test")


@query("stratified_folds", f"SELECT o_orderkey, (r % 4)::INTEGER AS fold FROM ({RANKED})")
def q_stratified_folds(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return splits.stratified_folds(orders, "o_orderstatus", F.col("o_orderkey"), 4).select("o_orderkey", "fold")


# keys with copies: all lines of a part, which belongs to its smallest return flag
COPIES = f"""k AS (SELECT l_partkey, min(l_returnflag) AS y, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT *, sum(n) OVER (PARTITION BY y) AS size, row_number() OVER w - 1 AS r, sum(n) OVER w - n AS before FROM k
  WINDOW w AS (PARTITION BY y ORDER BY {HASH.format(k='l_partkey')}, l_partkey::VARCHAR ROWS UNBOUNDED PRECEDING))"""


@query("stratified_folds_copies", f"WITH {COPIES} SELECT l_orderkey, l_linenumber, (r % 4)::INTEGER AS fold FROM lineitem JOIN r USING (l_partkey)")
def q_stratified_folds_copies(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return splits.stratified_folds(lines, "l_returnflag", F.col("l_partkey"), 4).select("l_orderkey", "l_linenumber", "fold")


@query("stratified_split_copies", f"""WITH {COPIES}
SELECT l_orderkey, l_linenumber, before + n / 2.0 <= floor(size * 0.25::DOUBLE + 0.5) AS is_test FROM lineitem JOIN r USING (l_partkey)""")
def q_stratified_split_copies(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return splits.stratified_split(lines, "l_returnflag", F.col("l_partkey"), 0.25).select("l_orderkey", "l_linenumber", "is_test")


@query("safe_folds", """
SELECT 'status' AS target, greatest(2, least(10, min(n)))::INTEGER AS folds FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)
UNION ALL SELECT 'region', greatest(2, least(7, min(n)))::INTEGER FROM (SELECT count(*) AS n FROM region GROUP BY r_name)
UNION ALL SELECT 'acctbal', greatest(2, least(10, floor(count(*) / 5)))::INTEGER FROM supplier""")
def q_safe_folds(spark, sf_dir):
    rows = [
        ("status", splits.safe_folds(table(spark, sf_dir, "orders"), "o_orderstatus", 12, "classification")),
        ("region", splits.safe_folds(table(spark, sf_dir, "region"), "r_name", 7, "classification")),
        ("acctbal", splits.safe_folds(table(spark, sf_dir, "supplier"), "s_acctbal", 10, "regression")),
    ]
    return union_all([df.select(F.lit(name).alias("target"), "folds") for name, df in rows])
