"""Derived inputs, written once for each engine. They keep every row of their table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.registry import table

# orders with missing prices and priorities
GAPPY_ORDERS_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders"""


def gappy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


# lineitem quantities and prices stretched so that they have outliers
STRETCHED_SQL = """
SELECT pow(l_quantity / 10, 4) AS quantity4, pow(l_extendedprice / 1000, 3) AS price3,
       l_discount, l_tax
FROM lineitem"""


def stretched_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(
        F.pow(F.col("l_quantity") / 10, F.lit(4.0)).alias("quantity4"),
        F.pow(F.col("l_extendedprice") / 1000, F.lit(3.0)).alias("price3"),
        "l_discount", "l_tax",
    )


# orders with one column that repeats the status almost everywhere
LEAKY_ORDERS_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority,
       CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS final_result,
       o_orderstatus
FROM orders"""


def leaky_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("final_result"),
        "o_orderstatus",
    )


# predictions made by a rule: truth is the quality label
RULE_PREDICTIONS_SQL = """
SELECT doc_id, quality::VARCHAR AS y_true,
       CASE WHEN (doc_id % 7) / 7.0::DOUBLE >= 0.5 THEN '1' ELSE '0' END AS y_pred,
       (doc_id % 7)::DOUBLE / 7.0::DOUBLE AS score
FROM labels"""


def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    score = (F.col("doc_id") % 7).cast("double") / F.lit(7.0)
    return labels.select(
        "doc_id", F.col("quality").cast("string").alias("y_true"),
        F.when(score >= 0.5, "1").otherwise("0").alias("y_pred"), score.alias("score"),
    )
