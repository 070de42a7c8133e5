"""Rule-based quality checks: target gate, dataset warnings, cardinality, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.numbers import ratio
from tabloom.operators.frequencies import distinct_counts
from tabloom.operators.lanes import empty, local_table
from tabloom.operators.profile import missing_ratios
from tabloom.operators.quantiles import ACCURACY, quartile_outliers
from tabloom.operators.roles import _value_totals, column_roles, high_cardinality_rule

# The thresholds of the rules.
TARGET_MISSING_LIMIT = 0.5
MIN_USABLE_ROWS = 10
SMALL_TABLE_ROWS = 30
WIDE_TABLE_COLUMNS = 50
HIGH_MISSING = 0.5
IQR_FACTOR = 1.5

GATE_SCHEMA = "ok boolean, code string, message string, missing_ratio double, unique_count bigint, usable_rows bigint, n_rows bigint"
OUTLIER_SCHEMA = "column string, outlier_count bigint, outlier_ratio double, lower_bound double, upper_bound double"
CARDINALITY_SCHEMA = "column string, unique_count bigint, unique_ratio double, recommended_action string"


def _percent(share) -> F.Column:
    return F.format_string("%.1f%%", share * F.lit(100.0))


def target_gate(df: DataFrame, target: str) -> DataFrame:
    """One row telling whether ``target`` can be modelled; the first failing rule is named."""
    if target not in df.columns:
        row = [(False, "no_such_column", f"target column {target} does not exist", None, None, None, None)]
        return local_table(df.sparkSession, row, GATE_SCHEMA)
    totals = _value_totals(df, target)
    share = ratio(F.col("n_rows") - F.col("usable_rows"), F.col("n_rows"))
    facts = totals.select(share.alias("missing_ratio"), "unique_count", "usable_rows", "n_rows")
    code = (
        F.when(F.col("missing_ratio") > TARGET_MISSING_LIMIT, "too_many_missing")
        .when(F.col("unique_count") < 2, "too_few_values")
        .when(F.col("usable_rows") < MIN_USABLE_ROWS, "too_few_rows")
        .when(F.col("missing_ratio") > 0, "some_missing")
        .otherwise("ok")
    )
    message = (
        F.when(F.col("code") == "too_many_missing", F.concat(
            F.lit("target is missing in "), _percent(F.col("missing_ratio")), F.lit(" of the rows: clean it first")))
        .when(F.col("code") == "too_few_values", "target has fewer than 2 distinct values")
        .when(F.col("code") == "too_few_rows", "fewer than 10 rows are left without missing targets")
        .when(F.col("code") == "some_missing", F.concat(
            F.lit("target is missing in "), _percent(F.col("missing_ratio")), F.lit(" of the rows: they are dropped")))
        .otherwise("")
    )
    return facts.withColumn("code", code).select(
        F.col("code").isin("ok", "some_missing").alias("ok"), "code", message.alias("message"),
        "missing_ratio", "unique_count", "usable_rows", "n_rows",
    )


def dataset_warnings(df: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """``(code, message)`` of the table-level rules that fire; no row means no warning."""
    n_columns = len(df.columns)
    size = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.array(
            F.struct(
                F.lit(1).alias("ord"), (F.col("n_rows") < SMALL_TABLE_ROWS).alias("fires"),
                F.lit("few_rows").alias("code"),
                F.lit("fewer than 30 rows: results only show that the flow works").alias("message"),
            ),
            F.struct(
                F.lit(2).alias("ord"),
                (F.lit(n_columns) > F.greatest(F.lit(WIDE_TABLE_COLUMNS), F.col("n_rows") * 2)).alias("fires"),
                F.lit("many_columns").alias("code"),
                F.lit("many columns for the number of rows: a baseline model may overfit").alias("message"),
            ),
        ).alias("rules")
    ).select(F.inline("rules"))
    sparse = missing_ratios(df).agg(F.max("missing_ratio").alias("worst")).select(
        F.lit(3).alias("ord"), F.coalesce(F.col("worst") >= HIGH_MISSING, F.lit(False)).alias("fires"),
        F.lit("high_missing").alias("code"),
        F.lit("some columns miss at least half of their cells: drop or complete them").alias("message"),
    )
    roles = column_roles(df) if roles is None else roles
    position = {name: i for i, name in enumerate(df.columns)}
    order = F.create_map(*[F.lit(x) for pair in position.items() for x in pair])
    # one row per column: the list is bounded by the schema
    names = F.array_sort(F.collect_list(F.when(
        F.col("is_high_cardinality"), F.struct(order[F.col("column")].alias("p"), F.col("column").alias("name")))))
    wide = roles.agg(names.alias("names")).select(
        F.lit(4).alias("ord"), (F.size("names") > 0).alias("fires"),
        F.lit("high_cardinality").alias("code"),
        F.concat(
            F.lit("high-cardinality columns: "), F.array_join(F.slice("names.name", 1, 5), ", "),
            F.lit("; rare values are grouped before modelling"),
        ).alias("message"),
    )
    return (
        size.unionByName(sparse).unionByName(wide)
        .where("fires").orderBy("ord").select("code", "message")
    )


def high_cardinality_report(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Per categorical column: distinct values and the recommended encoding.

    ``counts`` may hand in ``distinct_counts(df)`` if it is there.
    """
    if not columns:
        return empty(df.sparkSession, CARDINALITY_SCHEMA)
    unique, present = F.col("unique_count"), F.col("present_count")
    action = F.when(high_cardinality_rule(unique, present), "Rare category grouping + OneHot").otherwise("OneHot")
    counts = distinct_counts(df, columns) if counts is None else counts.where(F.col("column").isin(list(columns)))
    return counts.select(
        "column", "unique_count",
        ratio(unique, F.greatest(present, F.lit(1))).alias("unique_ratio"),
        action.alias("recommended_action"),
    ).orderBy(F.desc("unique_count"), F.desc("unique_ratio"), "column")


def needs_grouping(report: DataFrame) -> DataFrame:
    return report.where(F.col("recommended_action") != "OneHot")


def iqr_outliers(df: DataFrame, columns: Sequence[str], accuracy: int = ACCURACY) -> DataFrame:
    """Per numeric column: cells outside the interquartile fences.

    A zero interquartile range gives the quartiles as bounds and no outliers; columns without
    numbers are left out.
    """
    if not columns:
        return empty(df.sparkSession, OUTLIER_SCHEMA)
    return quartile_outliers(df, columns, IQR_FACTOR, accuracy).select(
        "column", "outlier_count", "outlier_ratio", "lower_bound", "upper_bound").orderBy(F.desc("outlier_ratio"), "column")
