"""Heuristic target-leakage checks. They warn; a person decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.missing import value_or_null
from tabloom.functions.names import RISKY_WORDS, normalize_name
from tabloom.functions.numbers import is_numeric, pearson
from tabloom.functions.text import as_text
from tabloom.operators.lanes import empty, local_table, number_cell, per_column, typed_lanes, union_all
from tabloom.operators.roles import task_type

# Thresholds and scores of the rules.
EQUAL_LIMIT = 0.95
CORRELATION_LIMIT = 0.98
PURITY_LIMIT = 0.95
PURITY_MIN_VALUES = 10
SCORES = {
    "name_overlap": 3, "risky_keyword": 2, "equal_values": 5, "high_correlation": 4, "pure_values": 3,
}

LEAKAGE_SCHEMA = "column string, risk_score int, reason_codes array<string>, reasons string"


def equality_ratio(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """``(column, equal_ratio)``: rows whose cell reads the same as the target; missing equals missing."""
    wanted = df.schema[target].dataType

    def same(name: str) -> Column:
        ref, y = value_or_null(df, name), value_or_null(df, target)
        dtype = df.schema[name].dataType
        if dtype != wanted and not (_integral(dtype) and _integral(wanted)):
            # cells of different types are compared as printed
            ref, y = as_text(ref, dtype), as_text(y, wanted)
        return ref.eqNullSafe(y)

    return per_column(
        df, columns, same, [F.avg(F.col("value").cast("double")).alias("equal_ratio")],
        "column string, equal_ratio double")


def _integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def target_correlation(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """``(column, corr)`` of each numeric column with a numeric target."""
    cell = number_cell(df)
    return per_column(
        df, columns, cell, [pearson(F.col("value"), F.col("y")).alias("corr")],
        "column string, corr double", carry={"y": cell(target)})


def class_purity(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """``(column, distinct_values, purity)``: share of values seen with one target value only.

    A value is pure when its smallest and largest target agree, so no distinct sets are kept
    and both merge before the shuffle. Targets are compared by a hash of 128 bits in two numbers,
    which keeps the aggregate in a hash map whatever the target's type.
    """
    schema = "column string, distinct_values bigint, purity double"
    if not columns:
        return empty(df.sparkSession, schema)
    frames = []
    y = value_or_null(df, target)
    halves = {"y1": F.when(y.isNotNull(), F.xxhash64(y)), "y2": F.when(y.isNotNull(), F.xxhash64(F.lit(1), y))}
    for lane in typed_lanes(df, columns, carry=halves, identity=True):
        known = lane.where(F.col("value").isNotNull() & F.col("y1").isNotNull())
        frames.append(
            known.groupBy("column", "value")
            .agg(((F.min("y1") == F.max("y1")) & (F.min("y2") == F.max("y2"))).alias("pure"))
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("distinct_values"), F.avg(F.col("pure").cast("double")).alias("purity"))
        )
    return union_all(frames)


def leakage_report(df: DataFrame, target: str, task: str | None = None) -> DataFrame:
    """``(column, risk_score, reason_codes, reasons)`` for columns with at least one reason.

    The task is inferred from the target when not given. Name rules need no data; equality and
    correlation are one scan each; purity is one grouped pass.
    """
    spark = df.sparkSession
    others = [name for name in df.columns if name != target]
    if target not in df.columns or not others:
        return empty(spark, LEAKAGE_SCHEMA)
    task = task or task_type(df, target)
    wanted = normalize_name(target)
    named = []
    for name in others:
        short = normalize_name(name)
        overlap = bool(wanted) and (wanted in short or short in wanted)
        named.append((name, overlap, any(word in short for word in RISKY_WORDS)))
    facts = local_table(spark, named, "column string, overlap boolean, risky boolean")
    # every joined side has one row per column
    facts = facts.join(F.broadcast(equality_ratio(df, target, others)), "column", "left")
    if task == "regression" and is_numeric(df.schema[target].dataType):
        numeric = [name for name in others if is_numeric(df.schema[name].dataType)]
        facts = facts.join(F.broadcast(target_correlation(df, target, numeric)), "column", "left")
    else:
        facts = facts.withColumn("corr", F.lit(None).cast("double"))
    if task == "classification":
        facts = facts.join(F.broadcast(class_purity(df, target, others)), "column", "left")
    else:
        facts = facts.withColumn("distinct_values", F.lit(0)).withColumn("purity", F.lit(0.0))

    rules = [
        ("name_overlap", F.col("overlap"), F.lit("column name is very close to the target name")),
        ("risky_keyword", F.col("risky"), F.lit("column name holds a risky word such as label or outcome")),
        ("equal_values", F.col("equal_ratio") > EQUAL_LIMIT, F.concat(
            F.lit("equal to the target in "), F.format_string("%.1f%%", F.col("equal_ratio") * 100), F.lit(" of the rows"))),
        ("high_correlation", F.abs("corr") > CORRELATION_LIMIT, F.concat(
            F.lit("correlation with the target is "), F.format_string("%.3f", F.col("corr")))),
        ("pure_values", (F.col("distinct_values") >= PURITY_MIN_VALUES) & (F.col("purity") > PURITY_LIMIT),
         F.lit("most values determine the target: an id or a leak")),
    ]
    found = F.filter(
        F.array(*[
            F.when(fires, F.struct(F.lit(code).alias("code"), F.lit(SCORES[code]).alias("score"), text.alias("text")))
            for code, fires, text in rules
        ]),
        lambda item: item.isNotNull(),
    )
    scored = facts.select("column", found.alias("found")).where(F.size("found") > 0)
    total = F.aggregate("found.score", F.lit(0), lambda total, score: total + score)
    return scored.select(
        "column", total.cast("int").alias("risk_score"),
        F.col("found.code").alias("reason_codes"), F.array_join("found.text", "; ").alias("reasons"),
    ).orderBy(F.desc("risk_score"), "column")
