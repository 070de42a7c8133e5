import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import names
from tabloom.functions.text import format_percent, safe_round, short_text
from tabloom.operators import charts, profile, quality, roles
from tabloom.operators.correlation import correlation
from tabloom.operators.frequencies import distinct_counts, frequencies, most_frequent, top_k
from tabloom.operators.lanes import empty
from tabloom.operators.leakage import class_purity, equality_ratio, leakage_report
from tabloom.operators.quantiles import exact_quantiles

NAN = float("nan")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_nan_and_null_are_both_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, None), (None, "a"), (1.0, "b")], "x double, s string")
    found = {r["column"]: r for r in profile.missing_summary(df).collect()}
    assert (found["x"]["missing_count"], found["x"]["unique_count"]) == (2, 1)
    assert (found["s"]["missing_count"], found["s"]["unique_count"]) == (1, 2)
    assert rows(profile.missing_cells(df)) == [(4, 3)]
    approx = {r["column"]: r["missing_count"] for r in profile.missing_summary(df, "approx").collect()}
    assert approx == {"x": 2, "s": 1}


def test_duplicates_count_missing_as_equal(spark):
    df = spark.createDataFrame([(NAN, None), (None, None), (1.0, "a"), (1.0, "a"), (0.0, "b"), (-0.0, "b")], "x double, s string")
    assert rows(profile.duplicate_rows(df)) == [(3,)]
    assert profile.overview(df).first()["duplicate_rows"] == 3


def test_long_text_is_compared_whole(spark):
    base = "x" * 500
    df = spark.createDataFrame([(base + "a",), (base + "b",), (base + "a",), ("short",)], "s string")
    assert rows(profile.duplicate_rows(df)) == [(1,)]
    assert distinct_counts(df).first()["unique_count"] == 3
    assert top_k(df, ["s"], 1).first()["value"] == base + "a"


def test_maps_and_arrays_can_be_profiled(spark):
    df = spark.range(4).select(
        F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)).alias("m"), F.array(F.col("id") % 2).alias("a"))
    assert rows(profile.duplicate_rows(df)) == [(2,)]
    assert [r["unique_count"] for r in distinct_counts(df).orderBy("column").collect()] == [2, 1]


@pytest.mark.parametrize("call", [
    lambda df: profile.overview(df), lambda df: profile.missing_summary(df),
    lambda df: profile.numeric_summary(df, ["x"]), lambda df: profile.categorical_summary(df, ["s"]),
    lambda df: quality.high_cardinality_report(df, ["s"]), lambda df: quality.iqr_outliers(df, ["x"]),
    lambda df: correlation(df, ["x", "y"]), lambda df: charts.histogram(df, ["x"]),
    lambda df: leakage_report(df, "s"), lambda df: roles.column_roles(df), lambda df: quality.dataset_warnings(df),
    lambda df: quality.target_gate(df, "x"), lambda df: roles.infer_task(df, "x"), lambda df: top_k(df, ["s"], 3),
    lambda df: profile.categorical_summary(df, []), lambda df: profile.numeric_summary(df, []),
    lambda df: quality.iqr_outliers(df, []), lambda df: quality.high_cardinality_report(df, []),
    lambda df: correlation(df, ["x"]), lambda df: class_purity(df, "s", []),
])
def test_empty_input_keeps_the_schema(spark, call):
    schema = "x double, y double, s string"
    full = spark.createDataFrame([(float(i), float(i * i % 7), str(i % 3)) for i in range(40)], schema)
    hollow = call(empty(spark, schema))
    hollow.collect()
    assert hollow.dtypes == call(full).dtypes


def test_empty_table_values(spark):
    hollow = empty(spark, "x double, s string")
    assert rows(profile.overview(hollow)) == [(0, 2, 0, 0, 0.0, 0)]
    assert [r["missing_ratio"] for r in profile.missing_summary(hollow).collect()] == [0.0, 0.0]
    assert profile.numeric_summary(hollow, ["x"]).first()["count"] == 0


def test_one_row(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "x double, y double")
    row = profile.numeric_summary(df, ["x"]).first()
    assert (row["count"], row["mean"], row["std"], row["p50"]) == (1, 2.0, None, 2.0)
    assert {r["corr"] for r in correlation(df, ["x", "y"]).collect()} == {None}


def test_constant_and_all_null_columns(spark):
    df = spark.createDataFrame([(5.0, None, float(i)) for i in range(20)], "c double, n double, v double")
    assert {(r["x"], r["y"]): r["corr"] for r in correlation(df, ["c", "v"]).collect()}[("c", "v")] is None
    assert rows(charts.histogram(df, ["c", "n"])) == [("c", 1, 5.0, 5.0, 20)]
    report = {r["column"]: r for r in quality.iqr_outliers(df, ["c", "n"]).collect()}
    assert set(report) == {"c"}
    assert (report["c"]["outlier_count"], report["c"]["lower_bound"], report["c"]["upper_bound"]) == (0, 5.0, 5.0)


def test_iqr_zero_has_no_outliers(spark):
    df = spark.createDataFrame([(1.0,)] * 30 + [(100.0,)] * 3, "x double")
    assert rows(quality.iqr_outliers(df, ["x"])) == [("x", 0, 0.0, 1.0, 1.0)]


@pytest.mark.parametrize("distinct, present, expected", [
    (14, 14, False), (15, 30, True), (15, 31, False), (49, 1000, False), (50, 100000, True)])
def test_high_cardinality_limits(spark, distinct, present, expected):
    got = spark.range(1).select(roles.high_cardinality_rule(F.lit(distinct), F.lit(present)).alias("h")).first()["h"]
    assert got is expected


def test_ties_at_the_cut_go_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "ccbbaad"], "s string")
    assert [(r["value"], r["rank"]) for r in top_k(df, ["s"], 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert most_frequent(frequencies(df)).first()["value"] == "a"
    assert profile.categorical_summary(df, ["s"], 2).first()["top_values"] == "a: 2, b: 2"


def test_dates_at_the_threshold(spark):
    df = spark.createDataFrame(
        [("2024-01-%02d" % (i + 1), "2024-01-%02d" % (i + 1)) if i < 74 % 28 else ("x", "x") for i in range(28)],
        "a string, b string")
    exact = spark.createDataFrame([("2024-03-01", "2024-03-01", "12:30")] * 3 + [("x", "2024/03/01", "y")], "a string, b string, c string")
    flags = {r["column"]: r["is_datetime"] for r in roles.column_roles(exact).collect()}
    assert flags == {"a": True, "b": True, "c": False}
    assert {r["is_datetime"] for r in roles.column_roles(df).collect()} == {False}


def test_roles_follow_schema(spark):
    df = spark.sql("""SELECT 1 AS i, 1.5D AS d, 2.5BD AS m, true AS b, date'2024-01-01' AS t, 'x' AS s,
                      timestamp'2024-01-01 00:00:00' AS ts, '20240101' AS compact""")
    kinds = roles.roles_by_kind(df)
    assert kinds == {
        "numeric": ["i", "d", "m"], "categorical": ["b", "s"], "datetime": ["t", "ts", "compact"],
        "boolean": ["b"], "high_cardinality": []}


def test_task_rule(spark):
    def task(values, kind):
        return roles.task_type(spark.createDataFrame([(v,) for v in values], f"y {kind}"), "y")

    assert task([None, None], "double") == "classification"
    assert task([1, 2] * 10, "int") == "classification"
    assert task([1, 2, 3] * 9, "int") == "regression"
    assert task([1, 2, 3] * 10, "int") == "classification"
    assert task(["a", "b", "c"], "string") == "classification"
    assert task([True, False], "boolean") == "classification"
    with pytest.raises(ValueError):
        roles.infer_task(spark.range(3), "nope")


def test_gate_order_and_missing_target(spark):
    df = spark.createDataFrame([(None,)] * 6 + [("a",)] * 5, "y string")
    assert quality.target_gate(df, "y").first()["code"] == "too_many_missing"
    assert quality.target_gate(df, "z").first()["code"] == "no_such_column"
    assert quality.target_gate(df.where("y is not null"), "y").first()["code"] == "too_few_values"
    two = spark.createDataFrame([("a",), ("b",)] * 4, "y string")
    assert quality.target_gate(two, "y").first()["code"] == "too_few_rows"
    fine = spark.createDataFrame([("a",), ("b",)] * 10 + [(None,)], "y string")
    assert quality.target_gate(fine, "y").first()["code"] == "some_missing"


def test_warnings(spark):
    wide = spark.range(10).select(*[F.lit(None).cast("double").alias(f"c{i}") for i in range(60)])
    assert [r["code"] for r in quality.dataset_warnings(wide).collect()] == ["few_rows", "many_columns", "high_missing"]


def test_leakage_name_rules_and_quirk(spark):
    df = spark.createDataFrame(
        [(float(i), i % 2, "a", i * 1.0 if i % 2 else 5.0, i % 3) for i in range(40)],
        "`--` double, outcome_x int, result string, other double, outcome int")
    report = {r["column"]: r for r in leakage_report(df, "outcome").collect()}
    assert report["--"]["reason_codes"] == ["name_overlap", "pure_values"]
    assert report["outcome_x"]["reason_codes"] == ["name_overlap", "risky_keyword"]
    assert report["result"]["risk_score"] == 2
    assert "other" not in report or "pure_values" in report["other"]["reason_codes"]
    assert leakage_report(df, "nope").collect() == []


def test_equality_counts_missing_as_equal(spark):
    df = spark.createDataFrame([(1, 1, "1"), (None, None, None), (2, 3, "2")], "y int, a bigint, s string")
    got = {r["column"]: r["equal_ratio"] for r in equality_ratio(df, "y", ["a", "s"]).collect()}
    assert got["a"] == pytest.approx(2 / 3) and got["s"] == 1.0


def test_correlation_uses_pairs_only(spark):
    data = [(1.0, 2.0), (2.0, None), (3.0, 7.0), (None, 1.0), (4.0, 9.0), (5.0, NAN)]
    got = {(r["x"], r["y"]): r["corr"] for r in correlation(spark.createDataFrame(data, "a double, b double"), ["a", "b"]).collect()}
    pairs = np.array([(1, 2), (3, 7), (4, 9)], dtype=float)
    assert got[("a", "b")] == pytest.approx(np.corrcoef(pairs.T)[0, 1])
    assert got[("a", "a")] == pytest.approx(1.0)


def _quantile_data(kind, n, rng):
    if kind == "uniform":
        return [rng.random() for _ in range(n)]
    if kind == "ties":
        return [float(rng.choice([0, 0, 0, 0, 1, 2])) for _ in range(n)]
    if kind == "hot":
        return [5.0 if rng.random() < 0.34 else rng.gauss(0, 1) for _ in range(n)]
    return [math.exp(rng.gauss(0, 8)) * rng.choice([-1, 1]) for _ in range(n)]


@pytest.mark.parametrize("kind", ["uniform", "ties", "hot", "heavy"])
@pytest.mark.parametrize("n", [999, 5000])
def test_bracket_quantiles_are_exact(spark, kind, n):
    values = _quantile_data(kind, n, random.Random(7))
    df = spark.createDataFrame([(v, None if i % 3 else -v) for i, v in enumerate(values)], "x double, y double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["column"]: r["q"] for r in exact_quantiles(df, ["x", "y"], probs, accuracy=100).collect()}
    assert got["x"] == pytest.approx(list(np.quantile(values, probs)))
    assert got["y"] == pytest.approx(list(np.quantile([-v for i, v in enumerate(values) if i % 3 == 0], probs)))


def test_quantiles_with_infinities_and_empty_columns(spark):
    values = [float("inf")] * 3 + [float("-inf")] + [float(i) for i in range(400)] + [NAN]
    df = spark.createDataFrame([(v, None) for v in values], "x double, n double")
    found = {r["column"]: r for r in exact_quantiles(df, ["x", "n"], [0.5], accuracy=50).collect()}
    assert found["x"]["n"] == 404
    assert found["x"]["q"][0] == pytest.approx(np.median(values[:-1]))
    assert found["n"]["q"] is None


def test_partition_count_does_not_matter(spark):
    df = spark.range(3000).select(
        (F.col("id") % 97).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("s"))
    calls = [
        lambda d: profile.missing_summary(d), lambda d: profile.numeric_summary(d, ["x"]),
        lambda d: profile.categorical_summary(d, ["s"]), lambda d: quality.iqr_outliers(d, ["x"]),
        lambda d: profile.overview(d), lambda d: charts.histogram(d, ["x"])]
    def settled(frame):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in rows(frame)]

    for call in calls:
        assert settled(call(df.repartition(1))) == settled(call(df.repartition(64)))


def test_names(spark):
    assert names.clean_column_names(spark.createDataFrame([(1, 2)], "` a ` int, b int")).columns == ["a", "b"]
    for bad in ("`a ` int, a int", "`  ` int, b int", "A int, a int"):
        frame = spark.createDataFrame([(1, 2)], "x int, y int").toDF(*[c.strip().rsplit(" ", 1)[0].strip("`") for c in bad.split(",")])
        with pytest.raises(ValueError):
            names.clean_column_names(frame)
    assert names.looks_like_datetime_name("Created_At") and not names.looks_like_datetime_name("price")


def test_columns_with_dots(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")] * 10, "`a.b` double, `c d` string")
    assert profile.missing_summary(df).count() == 2
    assert profile.numeric_summary(df, ["a.b"]).first()["mean"] == 1.5
    assert profile.categorical_summary(df, ["c d"]).first()["unique_count"] == 2
    assert roles.roles_by_kind(df)["numeric"] == ["a.b"]
    assert leakage_report(df, "c d").count() >= 0


def test_text_helpers(spark):
    df = spark.createDataFrame([(0.12345, "x" * 70), (None, "short")], "v double, s string")
    got = df.select(format_percent(F.col("v")), short_text(F.col("s"), 10), safe_round(F.col("v"), 2)).collect()
    assert tuple(got[0]) == ("12.35%", "x" * 7 + "...", 0.12) or tuple(got[0])[0] in ("12.34%", "12.35%")
    assert tuple(got[1]) == ("-", "short", None)


@pytest.mark.parametrize("shape", ["normal", "heavy", "few", "steps", "negative", "constant"])
def test_outliers_from_the_quartile_pass(spark, shape):
    rng = np.random.default_rng(17)
    values = {
        "normal": rng.normal(size=5000), "heavy": rng.standard_cauchy(5000), "few": rng.normal(size=40), "negative": -np.exp(rng.normal(size=5000) * 2),
        "steps": np.r_[rng.integers(0, 9, 5000).astype(float), 400.0, -400.0], "constant": np.r_[np.full(3000, 7.0), rng.normal(size=300)],
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(7)
    q1, q3 = np.percentile(values, [25, 75])
    low, high = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if q3 > q1 else (q1, q3)
    want = int(((values < low) | (values > high)).sum()) if q3 > q1 else 0
    row = quality.iqr_outliers(df, ["x"], accuracy=100).first()
    assert row["outlier_count"] == want and row["outlier_ratio"] == pytest.approx(want / len(values))
    assert row["lower_bound"] == pytest.approx(low) and row["upper_bound"] == pytest.approx(high)


@pytest.mark.parametrize("tail", ["pareto", "spike", "plain"])
def test_segments_hold_alike_however_values_spread(spark, tail):
    from tabloom.operators import quantiles

    value = {"pareto": "pow(rand(3), -3)", "spike": "if(id % 3 = 0, 7, pow(10, rand(3) * 12))", "plain": "rand(3)"}[tail]
    keyed = spark.range(20_000).selectExpr("'x' AS column", f"cast({value} AS double) AS key", "0 AS gap").groupBy(
        "column", "key", "gap").agg(F.count(F.lit(1)).alias("cnt"))
    placed = quantiles._placed(keyed)
    sizes = [r["count"] for r in placed.groupBy("segment").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 3 * sum(sizes) / len(sizes)
    assert placed.groupBy("segment").agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("segment").where("a > b").isEmpty()
