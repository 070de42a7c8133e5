"""Run configurations: one typed JSON row per run, appended to a log folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.lanes import local_table
from tabloom.plans.training import ModelConfig

CONFIG_VERSION = "2.0"
MODEL_CONFIG = (
    "struct<target_col: string, task_type: string, model_name: string, test_size: double, random_state: bigint, "
    "scale_numeric: boolean, exclude_datetime: boolean, rare_min_frequency: double, rare_max_categories: bigint, "
    "use_cv: boolean, cv_folds: bigint, use_search: boolean, search_type: string, n_iter: bigint>"
)
RUN_SCHEMA = (
    "config_version string, created_at string, data_source string, sheet_name string, target_col string, "
    f"task_type string, model_config {MODEL_CONFIG}, notes string"
)


def run_record(
    spark: SparkSession, *, data_source: str | None, target_col: str | None, task_type: str | None,
    model_config: ModelConfig | None = None, sheet_name: str | None = None, notes: str = "",
) -> DataFrame:
    """One row describing a run."""
    settings = model_config.to_dict() if model_config else None
    row = (CONFIG_VERSION, None, data_source, sheet_name, target_col, task_type, settings, notes)
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return local_table(spark, [row], RUN_SCHEMA).withColumn("created_at", stamp)


def append_run(record: DataFrame, folder: str) -> None:
    record.write.mode("append").json(folder)


def parse_runs(lines: DataFrame, value: Column) -> DataFrame:
    """Typed rows of the lines whose root is a JSON object; other lines are left out."""
    is_object = F.json_object_keys(value).isNotNull()
    return lines.where(is_object).select(F.from_json(value, RUN_SCHEMA).alias("run")).select("run.*")


def rejected_runs(lines: DataFrame, value: Column) -> DataFrame:
    return lines.where(F.json_object_keys(value).isNull())


def load_runs(spark: SparkSession, folder: str) -> DataFrame:
    return parse_runs(spark.read.text(folder), F.col("value"))


def usable_targets(runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``target_col`` only where the table has such a column."""
    known = F.col("target_col").isin(list(columns))
    return runs.withColumn("target_col", F.when(known, F.col("target_col")))
