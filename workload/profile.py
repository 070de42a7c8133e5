"""Profile queries: overview, missing cells, summaries, frequencies, roles."""

from pyspark.sql import functions as F

from tabloom.functions.dates import DATE_FORMATS
from tabloom.functions.names import normalized_name
from tabloom.functions.numbers import to_number
from tabloom.functions.text import format_percent, safe_round, short_text
from tabloom.operators import charts
from tabloom.operators.frequencies import distinct_counts, most_frequent, frequencies, top_k, value_counts
from tabloom.operators.lanes import union_all
from tabloom.operators.profile import (
    categorical_summary, duplicate_rows, missing_cells, missing_summary, numeric_summary, overview,
)
from tabloom.operators.quantiles import exact_quantiles
from tabloom.operators.roles import (
    can_stratify, column_roles, datetime_parse_ratio, identifier_check, infer_task,
)
from workload.fixtures import GAPPY_ORDERS_SQL, gappy_orders
from workload.registry import query, rounded, table

GAPPY = f"WITH d AS ({GAPPY_ORDERS_SQL})"

GAPPY_TYPES = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]


def _per_column_sql(columns, body, source, glue="\nUNION ALL\n"):
    """One SELECT per column; ``{c}`` stands for its name."""
    return glue.join(f"SELECT '{c}' AS \"column\", " + body.replace("{c}", c) + f" FROM {source}" for c in columns)


@query("missing_summary", GAPPY + "\nUNION ALL\n".join(
    f"""
SELECT '{name}' AS "column", '{dtype}' AS dtype, (count(*) - count({name}))::BIGINT AS missing_count,
       round((count(*) - count({name}))::DOUBLE / count(*), 9) AS missing_ratio,
       count(DISTINCT {name})::BIGINT AS unique_count FROM d""" for name, dtype in GAPPY_TYPES))
def q_missing_summary(spark, sf_dir):
    return rounded(missing_summary(gappy_orders(spark, sf_dir)), 9)


@query("overview", GAPPY + """
SELECT count(*)::BIGINT AS n_rows, 6::BIGINT AS n_columns,
       (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)))::BIGINT AS duplicate_rows,
       (2 * count(*) - count(o_totalprice) - count(o_orderpriority))::BIGINT AS total_missing_cells,
       round((2 * count(*) - count(o_totalprice) - count(o_orderpriority))::DOUBLE / (6 * count(*)), 9) AS missing_cell_ratio,
       (24 * count(*) + 8 * count(o_totalprice) + sum(strlen(o_orderstatus)) + sum(coalesce(strlen(o_orderpriority), 0)))::BIGINT AS size_bytes
FROM d""")
def q_overview(spark, sf_dir):
    return rounded(overview(gappy_orders(spark, sf_dir)), 9)


@query("missing_cells", GAPPY + """
SELECT count(*)::BIGINT AS n_rows,
       (2 * count(*) - count(o_totalprice) - count(o_orderpriority))::BIGINT AS total_missing_cells FROM d""")
def q_missing_cells(spark, sf_dir):
    return missing_cells(gappy_orders(spark, sf_dir))


@query("duplicate_rows", """
SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem)))::BIGINT
       AS duplicate_rows FROM lineitem""")
def q_duplicate_rows(spark, sf_dir):
    return duplicate_rows(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate"))


SUMMARY_SQL = """count({c})::BIGINT AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25,
  round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75,
  round(max({c})::DOUBLE, 4) AS max"""

LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("numeric_summary", _per_column_sql(LINEITEM_NUMBERS + ["l_linenumber"], SUMMARY_SQL, "lineitem"))
def q_numeric_summary(spark, sf_dir):
    return rounded(numeric_summary(table(spark, sf_dir, "lineitem"), LINEITEM_NUMBERS + ["l_linenumber"]), 4)


@query("numeric_summary_with_nulls", GAPPY + _per_column_sql(["o_custkey", "o_totalprice"], SUMMARY_SQL, "d"))
def q_numeric_summary_with_nulls(spark, sf_dir):
    return rounded(numeric_summary(gappy_orders(spark, sf_dir), ["o_custkey", "o_totalprice"]), 4)


@query("exact_quantiles", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", {p}::DOUBLE AS prob, round(quantile_cont({c}::DOUBLE, {p}), 4) AS value FROM lineitem"""
    for c in LINEITEM_NUMBERS for p in ("0.0", "0.1", "0.5", "0.99", "1.0")))
def q_exact_quantiles(spark, sf_dir):
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), LINEITEM_NUMBERS, probs)
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("prob"), F.col("q").alias("value"))
    return rounded(found.select("column", F.inline(pairs)).toDF("column", "prob", "value"), 4)


@query("distinct_counts", GAPPY + _per_column_sql(
    [name for name, _ in GAPPY_TYPES], "count(DISTINCT {c})::BIGINT AS unique_count", "d"))
def q_distinct_counts(spark, sf_dir):
    return distinct_counts(gappy_orders(spark, sf_dir)).select("column", "unique_count")


def _top_sql(column, source, k, missing=None):
    value = f"coalesce({column}::VARCHAR, '{missing}')" if missing else f"{column}::VARCHAR"
    where = "" if missing else f"WHERE {column} IS NOT NULL"
    return f"""SELECT '{column}' AS "column", value, cnt, rank FROM (
  SELECT value, cnt, (row_number() OVER (ORDER BY cnt DESC, value))::INTEGER AS rank FROM (
    SELECT {value} AS value, count(*)::BIGINT AS cnt FROM {source} {where} GROUP BY 1)) WHERE rank <= {k}"""


def _categorical_sql(column, source, k=5):
    return f"""SELECT '{column}' AS "column", count(DISTINCT {column})::BIGINT AS unique_count,
  round(count(DISTINCT {column})::DOUBLE / greatest(count({column}), 1), 9) AS unique_ratio,
  (count(DISTINCT {column}) >= 50 OR (count(DISTINCT {column}) >= 15
     AND count(DISTINCT {column})::DOUBLE / greatest(count({column}), 1) >= 0.5)) AS is_high_cardinality,
  (SELECT string_agg(value || ': ' || cnt, ', ' ORDER BY rank) FROM ({_top_sql(column, source, k)})) AS top_values
FROM {source}"""


@query("categorical_summary", "\nUNION ALL\n".join(
    _categorical_sql(c, "part") for c in ("p_name", "p_brand", "p_type")))
def q_categorical_summary(spark, sf_dir):
    return rounded(categorical_summary(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"]), 9)


@query("categorical_summary_with_nulls", GAPPY + "\nUNION ALL\n".join(
    _categorical_sql(c, "d") for c in ("o_orderstatus", "o_orderpriority")))
def q_categorical_summary_with_nulls(spark, sf_dir):
    return rounded(categorical_summary(gappy_orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority"]), 9)


@query("value_counts", "SELECT source AS value, count(*)::BIGINT AS cnt FROM documents GROUP BY 1")
def q_value_counts(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "documents"), "source")


@query("top_k", "\nUNION ALL\n".join(
    f"({_top_sql(c, t, 10)})" for c, t in (("l_orderkey", "lineitem"), ("l_partkey", "lineitem"), ("l_returnflag", "lineitem"))))
def q_top_k(spark, sf_dir):
    # ids rank by their text on ties, in both engines
    return top_k(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"], 10, None)


@query("category_frequency", GAPPY + _top_sql("o_orderpriority", "d", 20, "<missing>"))
def q_category_frequency(spark, sf_dir):
    return charts.category_frequency(gappy_orders(spark, sf_dir), "o_orderpriority")


@query("most_frequent_value", GAPPY + "\nUNION ALL\n".join(
    f"""(SELECT '{c}' AS "column", {c} AS value FROM d WHERE {c} IS NOT NULL GROUP BY {c}
ORDER BY count(*) DESC, {c} LIMIT 1)""" for c in ("o_orderstatus", "o_orderpriority")))
def q_most_frequent_value(spark, sf_dir):
    return most_frequent(frequencies(gappy_orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority"]))


def _roles_sql(source, columns):
    """``columns``: (name, dtype, kind); text columns are tested for dates and cardinality."""
    parts = []
    for name, dtype, kind in columns:
        if kind != "text":
            flags = {
                "number": "true, false, false, false, false", "date": "false, false, true, false, false",
                "bool": "false, true, false, true, false",
            }[kind]
            parts.append(f"SELECT '{name}', '{dtype}', {flags}")
            continue
        share = ", ".join(
            f"avg(CASE WHEN regexp_matches({name}, '{shape}') AND try_strptime({name}, '{strp}') IS NOT NULL THEN 1.0 ELSE 0.0 END)"
            for shape, _, strp in DATE_FORMATS)
        is_date = f"(greatest({share}) >= 0.75)"
        high = f"(count(DISTINCT {name}) >= 50 OR (count(DISTINCT {name}) >= 15 AND count(DISTINCT {name})::DOUBLE / count({name}) >= 0.5))"
        parts.append(
            f"SELECT '{name}', '{dtype}', false, NOT is_date, is_date, false, (NOT is_date) AND high "
            f"FROM (SELECT {is_date} AS is_date, {high} AS high FROM {source} WHERE {name} IS NOT NULL)")
    names = '("column", dtype, is_numeric, is_categorical, is_datetime, is_boolean, is_high_cardinality)'
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + f") AS roles{names}"


DATED_SQL = """(SELECT o_orderkey, o_totalprice > 200000 AS is_large, o_orderstatus, o_orderpriority,
  strftime(o_orderdate, '%Y-%m-%d') AS order_day, o_orderdate,
  CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS maybe_day,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%m/%d/%Y') END AS us_day
  FROM orders)"""


def _dated_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select(
        "o_orderkey", (F.col("o_totalprice") > 200000).alias("is_large"), "o_orderstatus", "o_orderpriority",
        day.alias("order_day"), "o_orderdate",
        F.when(F.col("o_orderkey") % 3 == 0, "unknown").otherwise(day).alias("maybe_day"),
        F.when(F.col("o_custkey") % 5 != 0, F.date_format("o_orderdate", "MM/dd/yyyy")).alias("us_day"),
    )


@query("column_roles", _roles_sql(DATED_SQL, [
    ("o_orderkey", "bigint", "number"), ("is_large", "boolean", "bool"), ("o_orderstatus", "string", "text"),
    ("o_orderpriority", "string", "text"), ("order_day", "string", "text"), ("o_orderdate", "timestamp_ntz", "date"),
    ("maybe_day", "string", "text"), ("us_day", "string", "text")]))
def q_column_roles(spark, sf_dir):
    return column_roles(_dated_orders(spark, sf_dir))


@query("column_roles_documents", _roles_sql("documents", [
    ("doc_id", "bigint", "number"), ("text", "string", "text"), ("lang", "string", "text"),
    ("source", "string", "text"), ("n_chars", "bigint", "number")]))
def q_column_roles_documents(spark, sf_dir):
    return column_roles(table(spark, sf_dir, "documents"))


@query("datetime_parse_ratio", f"""WITH s AS {DATED_SQL}
SELECT 'order_day' AS "column", round(avg(CASE WHEN try_strptime(order_day, '%Y-%m-%d') IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS parse_ratio FROM s
UNION ALL SELECT 'maybe_day', round(avg(CASE WHEN try_strptime(maybe_day, '%Y-%m-%d') IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) FROM s
UNION ALL SELECT 'us_day', round(avg(CASE WHEN try_strptime(us_day, '%m/%d/%Y') IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) FROM s WHERE us_day IS NOT NULL
UNION ALL SELECT 'o_orderstatus', 0.0 FROM (SELECT 1)""")
def q_datetime_parse_ratio(spark, sf_dir):
    names = ["order_day", "maybe_day", "us_day", "o_orderstatus"]
    return rounded(datetime_parse_ratio(_dated_orders(spark, sf_dir), names), 9)


def _task_sql(source, column, text=False):
    rule = "true" if text else (
        f"count({column}) = 0 OR count(DISTINCT {column}) <= least(20, greatest(2, floor(count({column}) * 0.1::DOUBLE)))")
    return f"""SELECT '{column}' AS "column", CASE WHEN {rule} THEN 'classification' ELSE 'regression' END AS task,
  count({column})::BIGINT AS usable_rows, count(DISTINCT {column})::BIGINT AS unique_count FROM {source}"""


@query("infer_task", GAPPY + "\nUNION ALL\n".join([
    _task_sql("d", "o_totalprice"), _task_sql("d", "o_orderpriority", True), _task_sql("lineitem", "l_linenumber"),
    _task_sql("lineitem", "l_quantity"), _task_sql("lineitem", "l_tax")]))
def q_infer_task(spark, sf_dir):
    gappy, lineitem = gappy_orders(spark, sf_dir), table(spark, sf_dir, "lineitem")
    wanted = [(gappy, "o_totalprice"), (gappy, "o_orderpriority")] + [
        (lineitem, c) for c in ("l_linenumber", "l_quantity", "l_tax")]
    return union_all([infer_task(df, name) for df, name in wanted])


@query("label_array_task", """
SELECT 'label' AS "column", CASE WHEN count(DISTINCT label) <= least(20, greatest(2, floor(count(label) * 0.1::DOUBLE)))
  THEN 'classification' ELSE 'regression' END AS task, count(label)::BIGINT AS usable_rows,
  count(DISTINCT label)::BIGINT AS unique_count FROM embeddings""")
def q_label_array_task(spark, sf_dir):
    return infer_task(table(spark, sf_dir, "embeddings"), "label")


@query("identifier_check", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", round(count(DISTINCT {c})::DOUBLE / count(*), 9) AS unique_ratio,
  {'count(DISTINCT ' + c + ')::DOUBLE / count(*) > 0.8' if c.endswith('id') else 'false'} AS is_identifier FROM events"""
    for c in ("event_id", "ts", "user_id", "event_type")))
def q_identifier_check(spark, sf_dir):
    return rounded(identifier_check(table(spark, sf_dir, "events"), ["event_id", "ts", "user_id", "event_type"]), 9)


@query("can_stratify", """
SELECT count(*)::BIGINT AS classes, min(n)::BIGINT AS min_count, count(*) >= 2 AND min(n) >= 2 AS can_stratify
FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def q_can_stratify(spark, sf_dir):
    return can_stratify(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("name_normalize", """
SELECT p_partkey, regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9一-龥]', '', 'g') AS name FROM part""")
def q_name_normalize(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", normalized_name(F.concat_ws(" ", "p_brand", "p_name")).alias("name"))


@query("numeric_coerce", """
WITH s AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'x' ELSE regexp_extract(props, '[0-9]+') END AS raw FROM events)
SELECT count(*)::BIGINT AS n_rows, count(TRY_CAST(raw AS DOUBLE))::BIGINT AS parsed,
       round(sum(TRY_CAST(raw AS DOUBLE)), 4) AS total FROM s""")
def q_numeric_coerce(spark, sf_dir):
    raw = F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.regexp_extract("props", "[0-9]+", 0))
    number = to_number(raw)
    return rounded(table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(number).alias("parsed"), F.sum(number).alias("total")), 4)


@query("text_helpers", """
SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS short,
       printf('%.2f%%', n_chars::DOUBLE / 400 * 100) AS share, round(n_chars::DOUBLE / 7, 4) AS rounded_value
FROM documents""")
def q_text_helpers(spark, sf_dir):
    share = F.col("n_chars").cast("double") / 400
    return table(spark, sf_dir, "documents").select(
        "doc_id", short_text(F.col("text")).alias("short"), format_percent(share).alias("share"),
        safe_round(F.col("n_chars").cast("double") / 7).alias("rounded_value"))


@query("preview_rows", "SELECT * FROM lineitem ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice LIMIT 20")
def q_preview_rows(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    return table(spark, sf_dir, "lineitem").orderBy(*keys).limit(20)
