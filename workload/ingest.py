"""Source and sink queries: tables are written out by Spark and read back by the readers."""

from __future__ import annotations

import io
import math
import sys

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tabloom.operators.arrays import feature_table
from tabloom.operators.lanes import local_table, union_all
from tabloom.session import scratch_folder
from tabloom.sources.delimited import TableError, read_table
from tabloom.sources.npz import read_npz
from tabloom.sources.run_log import append_run, load_runs, parse_runs, rejected_runs, run_record, usable_targets
from tabloom.sources.sinks import write_predictions
from workload.arrays import STATS_SQL
from workload.registry import query, rounded, table


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

@query("csv_ingest", """
SELECT l_returnflag, count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys, round(sum(l_quantity), 2) AS quantity,
  round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1""")
def q_csv_ingest(spark, sf_dir):
    folder = scratch_folder(spark, "csv")
    table(spark, sf_dir, "lineitem").write.option("header", True).csv(folder)
    df, _ = read_table(spark, f"{folder}/*.csv")
    return rounded(rounded(df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), F.sum("l_quantity").alias("quantity"),
        F.avg("l_tax").alias("tax")), 2, ["quantity"]), 6, ["tax"])


@query("tsv_ingest_missing_tokens", """
SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def q_tsv_ingest_missing_tokens(spark, sf_dir):
    folder = scratch_folder(spark, "tsv")
    orders = table(spark, sf_dir, "orders")
    cust = F.when(F.col("o_custkey") % 7 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    priority = F.when(F.col("o_custkey") % 5 == 0, "NULL").otherwise(F.col("o_orderpriority"))
    header = "o_orderkey\t o_custkey \to_orderpriority"
    lines = orders.select(F.concat_ws("\t", F.col("o_orderkey").cast("string"), cust, priority).alias("value"))
    # text parts end in .txt; a line separator before the first row puts the header into each part
    parts = lines.mapInPandas(_with_header(header), "value string")
    parts.write.text(folder)
    df, _ = read_table(spark, f"{folder}/*.txt")
    return df


def _with_header(header: str):
    def prepend(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [header]})
        yield from batches

    return prepend


def _encoder(encoding: str):
    def encode(text: pd.Series) -> pd.Series:
        return text.map(lambda value: value.encode(encoding))

    return encode


@query("multiline_ingest", "SELECT doc_id, md5(text) AS digest, n_chars FROM documents")
def q_multiline_ingest(spark, sf_dir):
    folder = scratch_folder(spark, "documents")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    documents.write.option("header", True).option("escape", '"').csv(folder)
    df, _ = read_table(spark, f"{folder}/*.csv")
    return df.select("doc_id", F.md5("text").alias("digest"), "n_chars")


def _write_npz(folder: str):
    """Each Arrow batch becomes one NPZ file named after its first key, so a retry overwrites it."""
    def write(batches):
        import pandas as pd

        system, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        for batch in batches:
            buffer = io.BytesIO()
            np.savez(buffer, X=np.stack(batch["embedding"].to_numpy()), y=batch["vec_id"].to_numpy())
            system.create_dir(base, recursive=True)
            path = f"{base}/{int(batch['vec_id'].iloc[0])}.npz"
            with system.open_output_stream(path) as out:
                out.write(buffer.getvalue())
            yield pd.DataFrame({"path": [path], "n": [len(batch)]})

    return write


@query("npz_ingest", STATS_SQL)
def q_npz_ingest(spark, sf_dir):
    folder = scratch_folder(spark, "npz")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows.mapInPandas(_write_npz(folder), "path string, n bigint").agg(F.sum("n")).first()
    features = feature_table(read_npz(spark, f"{folder}/*.npz"), "X", "y")
    return rounded(features.drop("file", "sample_index").withColumn(
        "vec_id", F.col("target").cast("bigint")).drop("target"), 6)


LINES_SQL = """SELECT p_partkey, p_type, CASE p_partkey % 4 WHEN 0 THEN '[1, 2]' WHEN 1 THEN 'not json'
  ELSE '{"config_version": "2.0", "target_col": "' || p_type || '", "task_type": "classification", "notes": "' || p_name || '"}' END AS value FROM part"""


def _run_lines(spark, sf_dir):
    record = F.to_json(F.struct(
        F.lit("2.0").alias("config_version"), F.col("p_type").alias("target_col"),
        F.lit("classification").alias("task_type"), F.col("p_name").alias("notes")))
    kind = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select(
        F.when(kind == 0, "[1, 2]").when(kind == 1, "not json").otherwise(record).alias("value"))


@query("run_log_parse", f"""
SELECT '2.0' AS config_version, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN p_type END AS target_col,
  'classification' AS task_type, json_extract_string(value, '$.notes') AS notes FROM ({LINES_SQL}) WHERE p_partkey % 4 > 1""")
def q_run_log_parse(spark, sf_dir):
    runs = parse_runs(_run_lines(spark, sf_dir), F.col("value"))
    return usable_targets(runs, ["ECONOMY", "STANDARD"]).select("config_version", "target_col", "task_type", "notes")


@query("run_log_rejected", f"SELECT value, count(*)::BIGINT AS n FROM ({LINES_SQL}) WHERE p_partkey % 4 <= 1 GROUP BY 1")
def q_run_log_rejected(spark, sf_dir):
    return rejected_runs(_run_lines(spark, sf_dir), F.col("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


LATIN1_FILE_BYTES = 1 << 26


@query("latin1_late_ingest", """
SELECT doc_id, md5(replace(replace(text, chr(10), ' '), '"', '')) AS digest FROM documents
WHERE NOT regexp_matches(text, '[^\x01-\xff]')""")
def q_latin1_late_ingest(spark, sf_dir):
    # in each file first the rows in ASCII and then the others: only its end tells the encoding. The files
    # grow in number with the text, four at least
    folder = scratch_folder(spark, "latin1")
    documents = table(spark, sf_dir, "documents").where(~F.regexp_like("text", F.lit("[^\\x01-\\xff]")))
    text = F.translate(F.translate("text", "\n", " "), '"', "")
    rows = documents.select("doc_id", text.alias("body"), F.regexp_like("text", F.lit("[^\\x01-\\x7f]")).alias("late"))
    size = rows.agg(F.sum(F.octet_length("body")).alias("size")).first()["size"] or 0
    rows.repartitionByRange(max(4, math.ceil(size / LATIN1_FILE_BYTES)), "doc_id").sortWithinPartitions("late", "doc_id").drop("late").write.option("header", True).option("encoding", "ISO-8859-1").csv(folder)
    df, _ = read_table(spark, f"{folder}/*.csv")
    return df.select("doc_id", F.md5("body").alias("digest"))


@query("ingest_metadata", """
SELECT 'csv' AS format, 'utf-8' AS encoding, 3::BIGINT AS files, true AS sized, count(*)::BIGINT AS n_rows, 100::BIGINT AS sampled FROM orders""")
def q_ingest_metadata(spark, sf_dir):
    folder = scratch_folder(spark, "orders")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").repartition(3).write.option("header", True).csv(folder)
    df, files = read_table(spark, f"{folder}/*.csv")
    sample, _ = read_table(spark, f"{folder}/*.csv", sample_rows=100)
    facts = files.groupBy("format", "encoding").agg(
        F.count(F.lit(1)).alias("files"), (F.min("size_bytes") > 0).alias("sized"))
    return facts.withColumns({"n_rows": F.lit(df.count()), "sampled": F.lit(sample.count())})


HEADERS = {"good": "a\tb", "twice": "a\ta", "blank": "a\t", "padded": " a \t b ", "empty": " ", "other": "a\tc"}


@query("mixed_encodings_ingest", """
SELECT o_orderkey, translate(o_orderkey::VARCHAR, '0123456789', CASE WHEN o_orderkey % 3 = 2 THEN 'àáâãäåæçèé' ELSE '零一二三四五六七八九' END) AS word, o_totalprice AS price
FROM orders""")
def q_mixed_encodings_ingest(spark, sf_dir):
    # a folder with files in UTF-8, GBK and Latin-1
    folder = scratch_folder(spark, "encodings")
    kind = F.col("o_orderkey") % 3
    key = F.col("o_orderkey").cast("string")
    word = F.when(kind == 2, F.translate(key, "0123456789", "àáâãäåæçèé")).otherwise(F.translate(key, "0123456789", "零一二三四五六七八九"))
    rows = table(spark, sf_dir, "orders").select(kind.alias("kind"), F.concat_ws("\t", key, word, F.col("o_totalprice").cast("string")).alias("value"))
    for number, encoding in enumerate(("utf-8", "gbk", "latin1")):
        body = rows.where(F.col("kind") == number).select("value").mapInPandas(_with_header("o_orderkey\tword\tprice"), "value string")
        raw = F.pandas_udf(_encoder(encoding), "binary")("value")
        # text is written as the bytes that it has
        body.select(raw.cast("string").alias("value")).write.text(f"{folder}/{encoding}")
    return read_table(spark, f"{folder}/*/*.txt")[0]


@query("load_checks", """
SELECT c AS checked, CASE WHEN c IN ('good', 'padded') THEN (SELECT count(*) FROM orders)::VARCHAR ELSE 'refused' END AS outcome
FROM (SELECT unnest(['good', 'twice', 'blank', 'padded', 'empty', 'other', 'few']) AS c)""")
def q_load_checks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"))
    # a row for each of three states
    few = orders.groupBy("o_orderstatus").count().select(F.concat_ws("\t", "o_orderstatus", F.col("count").cast("string")).alias("value")).coalesce(1)
    outcomes = []
    for name, header in {**HEADERS, "few": "a\tb"}.items():
        folder = scratch_folder(spark, f"load-{name}")
        body = few if name == "few" else rows
        body.mapInPandas(_with_header(header), "value string").write.text(f"{folder}/one")
        if name == "other":  # files must agree
            rows.mapInPandas(_with_header("a\tb"), "value string").write.text(f"{folder}/two")
        try:
            found = str(read_table(spark, f"{folder}/*/*.txt")[0].count())
        except TableError:
            found = "refused"
        outcomes.append((name, found))
    return local_table(spark, outcomes, "checked string, outcome string")


@query("predictions_sink", """
SELECT form, o_orderkey, round(o_totalprice, 4) AS price, o_orderpriority FROM orders, (SELECT unnest(['csv', 'parquet']) AS form)""")
def q_predictions_sink(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 4).alias("price"), "o_orderpriority")
    frames = []
    for form in ("csv", "parquet"):
        folder = scratch_folder(spark, f"sink-{form}")
        write_predictions(rows, folder, form)
        frames.append(read_table(spark, f"{folder}/*.{form}")[0].withColumn("form", F.lit(form)))
    return union_all(frames)


@query("run_log_append", """
SELECT r_name AS data_source, '2.0' AS config_version, 'y' AS target_col, 'regression' AS task_type, 'run ' || r_regionkey AS notes FROM region""")
def q_run_log_append(spark, sf_dir):
    folder = scratch_folder(spark, "runs")
    for row in table(spark, sf_dir, "region").collect():  # one run is appended at a time
        append_run(run_record(spark, data_source=row["r_name"], target_col="y", task_type="regression", notes=f"run {row['r_regionkey']}"), folder)
    return load_runs(spark, folder).select("data_source", "config_version", "target_col", "task_type", "notes")
