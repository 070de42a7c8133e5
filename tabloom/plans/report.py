"""The report as a table of facts, and its Markdown lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.names import column
from tabloom.functions.text import format_percent, safe_round
from tabloom.operators.frequencies import distinct_counts, top_k
from tabloom.operators.lanes import empty, held, local_table, together, union_all
from tabloom.operators.leakage import leakage_report
from tabloom.operators.profile import missing_summary, numeric_summary, overview
from tabloom.operators.quality import high_cardinality_report, iqr_outliers, needs_grouping
from tabloom.operators.roles import column_roles, roles_by_kind
from tabloom.plans.training import ModelConfig, TrainResult

FACT_SCHEMA = "section string, ord int, item string, value string"
# Rows shown per table by default, and sections in order with their headings.
TOP_ROWS, TARGET_VALUES = 10, 20
SECTIONS = {
    "overview": "1. Overview",
    "roles": "2. Column roles",
    "missing": "3. Missing values",
    "outliers": "4.1 Outliers (IQR)",
    "leakage": "4.2 Leakage risk",
    "high_cardinality": "4.3 High-cardinality categories",
    "target": "5. Target",
    "target_summary": "5.1 Target summary",
    "model": "6. Model settings",
    "metrics": "7. Model metrics",
    "cv": "7.1 Cross-validation",
    "best_params": "7.2 Best parameters",
    "conclusions": "8. Conclusions",
}
SKIPPED_METRICS = ("confusion_matrix", "labels")


def _facts(rows: DataFrame, section: str, order: list[Column], item: Column, value: Column, top: int | None) -> DataFrame:
    """Rank a small result table and keep its first rows as facts."""
    ranked = rows.withColumn("ord", F.row_number().over(Window.orderBy(*order)))
    if top:
        ranked = ranked.where(F.col("ord") <= top)
    return ranked.select(
        F.lit(section).alias("section"), "ord", item.alias("item"), value.cast("string").alias("value"))


def overview_facts(df: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    facts = overview(df) if shape is None else shape
    names = ["n_rows", "n_columns", "duplicate_rows", "total_missing_cells"]
    rows = [F.struct(F.lit(i + 1).alias("ord"), F.lit(name).alias("item"), F.col(name).cast("string").alias("value"))
            for i, name in enumerate(names)]
    rows.append(F.struct(
        F.lit(len(names) + 1).alias("ord"), F.lit("missing_cell_ratio").alias("item"),
        format_percent(F.col("missing_cell_ratio")).alias("value")))
    return facts.select(F.inline(F.array(*rows))).select(F.lit("overview").alias("section"), "ord", "item", "value")


def role_facts(df: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    shown = [(k, ", ".join(kinds[k]) or "none") for k in ("numeric", "categorical", "high_cardinality", "datetime")]
    return local_table(
        df.sparkSession, [("roles", i + 1, kind, names) for i, (kind, names) in enumerate(shown)], FACT_SCHEMA)


def missing_facts(df: DataFrame, top_rows: int = TOP_ROWS, counts: DataFrame | None = None) -> DataFrame:
    value = F.concat_ws(
        "; ", "dtype", F.col("missing_count").cast("string"), format_percent(F.col("missing_ratio")),
        F.col("unique_count").cast("string"))
    order = [F.desc("missing_ratio"), F.desc("missing_count"), F.asc("column")]
    return _facts(missing_summary(df, counts=counts), "missing", order, F.col("column"), value, top_rows)


def outlier_facts(df: DataFrame, numeric: list[str], top_rows: int = TOP_ROWS) -> DataFrame:
    value = F.concat_ws(
        "; ", F.col("outlier_count").cast("string"), format_percent(F.col("outlier_ratio")),
        F.format_string("%.4f", "lower_bound"), F.format_string("%.4f", "upper_bound"))
    order = [F.desc("outlier_ratio"), F.asc("column")]
    return _facts(iqr_outliers(df, numeric), "outliers", order, F.col("column"), value, top_rows)


def leakage_facts(df: DataFrame, target: str, top_rows: int = TOP_ROWS) -> DataFrame:
    value = F.concat_ws("; ", F.col("risk_score").cast("string"), "reasons")
    order = [F.desc("risk_score"), F.asc("column")]
    return _facts(leakage_report(df, target), "leakage", order, F.col("column"), value, top_rows)


def cardinality_facts(
    df: DataFrame, categorical: list[str], top_rows: int = TOP_ROWS, counts: DataFrame | None = None
) -> DataFrame:
    value = F.concat_ws(
        "; ", F.col("unique_count").cast("string"), format_percent(F.col("unique_ratio")), "recommended_action")
    order = [F.desc("unique_count"), F.desc("unique_ratio"), F.asc("column")]
    report = needs_grouping(high_cardinality_report(df, categorical, counts))
    return _facts(report, "high_cardinality", order, F.col("column"), value, top_rows)


def target_summary(df: DataFrame, target: str, task: str, values: int = TARGET_VALUES) -> DataFrame:
    """``(ord, item, value)``: the ``values`` most frequent classes, or the numeric description."""
    if task == "classification":
        return top_k(df, [target], values).select(
            F.col("rank").alias("ord"), F.col("value").alias("item"), F.col("cnt").cast("string").alias("value"))
    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    rows = [F.struct(F.lit(i + 1).alias("ord"), F.lit(name).alias("item"),
                     F.format_string("%.4f", column(name).cast("double")).alias("value")) for i, name in enumerate(names)]
    return numeric_summary(df, [target]).select(F.inline(F.array(*rows)))


def metric_facts(metrics: DataFrame) -> DataFrame:
    """Metrics to four digits; a missing value reads n/a; tables are left out."""
    shown = F.coalesce(F.format_string("%.4f", safe_round(F.col("value"))), F.lit("n/a"))
    text = F.when(F.col("value").isNull(), F.lit("n/a")).otherwise(shown)
    return _facts(
        metrics.where(~F.col("metric").isin(*SKIPPED_METRICS)), "metrics", [F.asc("metric")], F.col("metric"), text, None)


def conclusions(
    df: DataFrame, target: str | None = None, task: str | None = None,
    metrics: DataFrame | None = None, importance: DataFrame | None = None,
    shape: DataFrame | None = None, missing: DataFrame | None = None,
) -> DataFrame:
    """``(ord, code, sentence)``: each sentence only where it applies.

    ``shape`` and ``missing`` may hand in the overview and the missing summary if they are there.
    """
    shape = (overview(df) if shape is None else shape).select(F.inline(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("shape").alias("code"), F.format_string(
            "The table has %d rows and %d columns; %d rows are duplicates.",
            "n_rows", "n_columns", "duplicate_rows").alias("sentence")),
        F.struct(F.lit(2).alias("ord"), F.lit("missing").alias("code"), F.concat(
            F.lit("Overall "), format_percent(F.col("missing_cell_ratio")),
            F.lit(" of the cells are missing; look at the sparse columns first.")).alias("sentence")),
    )))
    parts = [shape]
    spark = df.sparkSession
    if target:
        parts.append(local_table(
            spark, [(3, "target", f"`{target}` is the target of a {task} task.")], "ord int, code string, sentence string"))
    worst = (missing_summary(df) if missing is None else missing).orderBy(F.desc("missing_ratio"), F.desc("missing_count"), "column").limit(1)
    parts.append(worst.where(F.col("missing_ratio") > 0).select(
        F.lit(4).alias("ord"), F.lit("worst_column").alias("code"),
        F.concat(F.lit("`"), "column", F.lit("` misses the most cells: "), format_percent(F.col("missing_ratio")), F.lit(".")).alias("sentence")))
    if metrics is not None:
        wanted = {"f1_weighted": "weighted F1", "roc_auc": "ROC-AUC"} if task == "classification" else {"r2": "R2", "rmse": "RMSE"}
        for i, (metric, label) in enumerate(wanted.items()):
            parts.append(metrics.where((F.col("metric") == metric) & F.col("value").isNotNull()).select(
                F.lit(5 + i).alias("ord"), F.col("metric").alias("code"),
                F.format_string(f"The baseline model reaches a {label} of %.4f.", "value").alias("sentence")))
    if importance is not None:
        parts.append(importance.orderBy(F.desc("importance"), "feature").limit(1).select(
            F.lit(7).alias("ord"), F.lit("top_feature").alias("code"),
            F.concat(F.lit("`"), "feature", F.lit("` contributes the most to the model.")).alias("sentence")))
    return union_all(parts)


def _model_facts(df: DataFrame, config: ModelConfig, result: TrainResult | None) -> DataFrame:
    rows = [
        ("model", config.model_name), ("test_size", str(config.test_size)), ("seed", str(config.random_state)),
        ("scale_numeric", "yes" if config.scale_numeric else "no"),
        ("cross_validation", "on" if config.use_cv else "off"),
        ("search", config.search_type if config.use_search else "off"),
        ("rare_categories", f"min_frequency={config.rare_min_frequency}, max_categories={config.rare_max_categories}"),
    ]
    if result is not None:
        rows += [
            ("used_features", str(len(result.used_features))), ("numeric_features", str(len(result.numeric_features))),
            ("categorical_features", str(len(result.categorical_features))),
        ]
    return local_table(
        df.sparkSession, [("model", i + 1, item, value) for i, (item, value) in enumerate(rows)], FACT_SCHEMA)


def report_facts(
    df: DataFrame, source: str = "unknown", target: str | None = None, task: str | None = None,
    config: ModelConfig | None = None, result: TrainResult | None = None,
    top_rows: int = TOP_ROWS, target_values: int = TARGET_VALUES,
) -> DataFrame:
    """``(section, ord, item, value)`` of the whole report.

    Row digests, value frequencies and quantiles are one pass each, run side by side; their results, a
    few rows per column, are kept and every section that needs them takes them from there. ``top_rows`` and
    ``target_values`` limit what a section shows.
    """
    spark = df.sparkSession
    kinds, shape, counts, *leaks = together(
        lambda: roles_by_kind(df, column_roles(df)), lambda: held(overview(df)), lambda: held(distinct_counts(df)),
        *([lambda: held(leakage_facts(df, target, top_rows))] if target else []))
    jobs = [lambda: held(outlier_facts(df, kinds["numeric"], top_rows)) if kinds["numeric"] else empty(spark, FACT_SCHEMA)]
    if target and task:
        jobs.append(lambda: held(target_summary(df, target, task, target_values).select(
            F.lit("target_summary").alias("section"), "ord", "item", "value")))
    outliers, *summary = together(*jobs)
    parts = [
        overview_facts(df, shape), role_facts(df, kinds), missing_facts(df, top_rows, counts), outliers,
        cardinality_facts(df, kinds["categorical"], top_rows, counts) if kinds["categorical"] else empty(spark, FACT_SCHEMA),
        local_table(spark, [("target", 1, "source", source), ("target", 2, "column", target or "none"),
                            ("target", 3, "task", task or "none")], FACT_SCHEMA),
    ]
    parts += [*leaks, *summary]
    if config is not None:
        parts.append(_model_facts(df, config, result))
    metrics = result.metrics if result else None
    if result is not None:
        parts.append(metric_facts(result.metrics))
        if result.cv_summary is not None:
            text = F.concat_ws("; ", F.format_string("%.4f", "mean"), F.format_string("%.4f", "std"))
            parts.append(_facts(result.cv_summary, "cv", [F.asc("metric")], F.col("metric"), text, None))
        if result.best_params:
            parts.append(local_table(
                spark, [("best_params", 1, "params", json.dumps(result.best_params, sort_keys=True))], FACT_SCHEMA))
    closing = conclusions(df, target, task, metrics, result.importance if result else None, shape, missing_summary(df, counts=counts))
    parts.append(closing.select(
        F.lit("conclusions").alias("section"), F.col("ord").cast("int").alias("ord"),
        F.col("code").alias("item"), F.col("sentence").alias("value")))
    return union_all([part.select("section", F.col("ord").cast("int").alias("ord"), "item", "value") for part in parts])


def report_lines(facts: DataFrame) -> DataFrame:
    """``(ord, line)``: Markdown lines of the facts, with a heading per section."""
    spark = facts.sparkSession
    headings = local_table(
        spark, [(i, name, title) for i, (name, title) in enumerate(SECTIONS.items())],
        "place int, section string, title string")
    body = facts.join(F.broadcast(headings), "section").select(
        "place", F.col("ord").alias("row"),
        F.when(F.col("section") == "conclusions", F.concat(F.lit("- "), F.col("value")))
        .otherwise(F.concat(F.lit("| "), "item", F.lit(" | "), F.coalesce("value", F.lit("")), F.lit(" |"))).alias("line"))
    heads = headings.select("place", F.posexplode(F.when(
        F.col("section") == "conclusions", F.array(F.lit(""), F.concat(F.lit("## "), "title"), F.lit(""))
    ).otherwise(F.array(
        F.lit(""), F.concat(F.lit("## "), "title"), F.lit(""), F.lit("| item | value |"), F.lit("|---|---|")
    ))).alias("i", "line")).select("place", (F.col("i") - 10).alias("row"), "line")
    lines = body.unionByName(heads)
    return lines.select(
        F.row_number().over(Window.orderBy("place", "row", "line")).alias("ord"), "line")
