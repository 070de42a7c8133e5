import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators.arrays import array_slice, array_summary, feature_table, guess_arrays, sample_features
from tabloom.plans.report import report_facts, report_lines
from tabloom.plans.training import ModelConfig
from tabloom.sources.delimited import TableError, first_rows, read_csv, read_table
from tabloom.sources.npz import read_npz
from tabloom.sources.run_log import append_run, load_runs, parse_runs, run_record, usable_targets
from tabloom.sources.sinks import write_predictions, write_report
from workload import ingest

ROWS = "\n".join(f"{i},{i / 2},n{i}" for i in range(8))


def put(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(path)


def test_types_and_missing_tokens(spark, tmp_path):
    text = "a, b ,c,d,e,f\n" + "\n".join([
        "1,1.5,x,true,,2024-01-01", "NA,2,n/a,FALSE,NaN,2024-01-02", "3,null,y,true,,x", "4,1e3,z,true,,", "5,,,,,",
        '6,7,"p, q",true,NULL,w'])
    df, meta = read_table(spark, put(tmp_path, "t.csv", text))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "boolean"), ("e", "double"), ("f", "string")]
    rows = df.collect()
    assert [r["a"] for r in rows] == [1, None, 3, 4, 5, 6] and rows[5]["c"] == "p, q" and rows[1]["c"] is None
    assert meta.first()["format"] == "csv" and meta.first()["encoding"] == "utf-8" and meta.first()["size_bytes"] == len(text)


@pytest.mark.parametrize("header", ["", "  ", "a,,b", "a,b,a", "a, a"])
def test_bad_headers(spark, tmp_path, header):
    with pytest.raises(TableError):
        read_table(spark, put(tmp_path, "t.csv", f"{header}\n{ROWS}\n"))


def test_shape_checks(spark, tmp_path):
    for name, text in (("one.csv", "a\n1\n2\n3\n4\n5\n"), ("none.csv", "a,b\n"), ("few.csv", "a,b\n1,2\n"), ("zero.csv", b""), ("x.doc", "a,b\n1,2\n")):
        with pytest.raises(TableError):
            read_table(spark, put(tmp_path, name, text))
    assert read_table(spark, put(tmp_path, "tiny.csv", "a,b\n1,2\n"), allow_tiny=True)[0].count() == 1


def test_tabs_and_samples(spark, tmp_path):
    path = put(tmp_path, "t.tsv", "a\tb\tc\n" + ROWS.replace(",", "\t"))
    df, meta = read_table(spark, path, sample_rows=6)
    assert df.count() == 6 and meta.first()["sample_rows"] == 6 and df.columns == ["a", "b", "c"]
    assert read_csv(spark, path)[0].count() == 8


@pytest.mark.parametrize("encoding, word", [("utf-8", "naïve"), ("utf-8-sig", "naïve"), ("gbk", "中文数据"), ("latin1", "na\xefve\xff")])
def test_encodings(spark, tmp_path, encoding, word):
    df, _ = read_table(spark, put(tmp_path, "t.csv", f"name,{word}\n" + f"{word},1\n" * 6, encoding))
    assert df.columns == ["name", word] and df.first()["name"] == word


def test_a_late_character_decides_the_encoding(spark, tmp_path):
    rows = "".join(f"{i},plain\n" for i in range(200_000)) + "200000,中文数据\n"
    df, meta = read_table(spark, put(tmp_path, "late file.csv", "k,word\n" + rows, "gbk"))
    assert meta.first()["encoding"] == "gbk" and df.where("k = 200000").first()["word"] == "中文数据" and df.count() == 200_001


def test_a_header_longer_than_a_chunk(spark, tmp_path):
    names = [f"column_{i:06d}_{'x' * 90}" for i in range(12_000)]
    path = put(tmp_path, "wide.csv", ",".join(names) + "\n")
    from tabloom.sources.delimited import _first_line

    assert _first_line(f"file://{path}").decode() == ",".join(names)


def test_quoted_line_breaks(spark, tmp_path):
    text = "a,b\n" + "".join(f'{i},"line one\nline ""two"" {i}"\n' for i in range(6))
    df, _ = read_table(spark, put(tmp_path, "t.csv", text))
    assert df.count() == 6 and df.where("a = 3").first()["b"] == 'line one\nline "two" 3'


def test_many_files_must_agree(spark, tmp_path):
    put(tmp_path, "a.csv", "a,b,c\n" + ROWS)
    put(tmp_path, "b.csv", "a,b,c\n" + ROWS.replace("n", "é"), "latin1")
    df, meta = read_table(spark, str(tmp_path / "*.csv"))
    assert df.count() == 16 and meta.count() == 2 and df.where("c = 'é3'").count() == 1
    put(tmp_path, "c.csv", "a,b,z\n" + ROWS)
    with pytest.raises(TableError):
        read_table(spark, str(tmp_path / "*.csv"))


def test_many_header_spellings(spark, tmp_path):
    for i in range(103):
        put(tmp_path, f"a{i:03}.csv", f"a{' ' * i},b\n{i},x\n")
    put(tmp_path, "z.csv", "a,b  \n200,caf\u00e9\n201,\u00e9 \n", "latin1")
    df, meta = read_table(spark, str(tmp_path))
    rows = {r["a"]: r["b"] for r in df.collect()}
    assert len(rows) == df.count() == 105 and rows[200] == "caf\u00e9" and meta.where("encoding = 'latin1'").count() == 1
    put(tmp_path, "zz.csv", "a,c\n1,x\n")
    with pytest.raises(TableError, match=r"zz\.csv differs"):
        read_table(spark, str(tmp_path))


def test_parquet_is_read_as_it_is(spark, tmp_path):
    spark.range(9).select("id", (F.col("id") * 2).alias("b")).write.parquet(str(tmp_path / "p"))
    df, meta = read_table(spark, str(tmp_path / "p/*.parquet"))
    assert df.count() == 9 and meta.first()["format"] == "parquet"


def test_npz_with_and_without_labels(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4, 3))
    x[0, 0, 0] = np.nan
    np.savez(tmp_path / "a.npz", X=x, y=np.arange(600) % 3, note=np.array(["hello"]))
    np.savez(tmp_path / "b.npz", stack=x[:5].astype("float32"))
    bundle = read_npz(spark, str(tmp_path / "*.npz")).cache()
    summary = {(r["file"].rsplit("/")[-1], r["name"]): r for r in array_summary(bundle).collect()}
    assert summary[("a.npz", "X")]["shape"] == "600 × 4 × 3" and summary[("a.npz", "X")]["ndim"] == 3
    assert summary[("a.npz", "X")]["mean"] == pytest.approx(np.nanmean(x))
    assert summary[("a.npz", "note")]["min"] is None
    guess = {r["file"].rsplit("/")[-1]: (r["x_name"], r["y_name"]) for r in guess_arrays(array_summary(bundle)).collect()}
    assert guess == {"a.npz": ("X", "y"), "b.npz": ("stack", None)}
    one = bundle.where(F.col("file").endswith("a.npz"))
    table = feature_table(one, "X", "y").orderBy("sample_index").collect()
    flat = x.reshape(600, -1)
    assert table[0]["img_mean"] == pytest.approx(np.nanmean(flat[0]))
    assert table[7]["img_p10"] == pytest.approx(np.percentile(flat[7], 10)) and table[7]["target"] == 1.0
    assert table[7]["img_std"] == pytest.approx(flat[7].std()) and table[7]["img_energy"] == pytest.approx((flat[7] ** 2).mean())
    cut = array_slice(one, "X", index=2).first()
    assert cut["sample_index"] == 2 and cut["values"] == pytest.approx(list(flat[2]))
    for bad in (("missing", None), ("y", None), ("X", "note")):
        with pytest.raises(ValueError):
            feature_table(one, *bad)


def test_empty_samples_give_nulls(spark):
    df = spark.createDataFrame([(1, []), (2, [float("nan")]), (3, [4.0])], "k int, values array<double>")
    got = {r["k"]: r for r in sample_features(df, ["k"]).collect()}
    assert got[1]["img_mean"] is None and got[2]["img_p50"] is None and got[3]["img_p90"] == 4.0


def test_run_log(spark, tmp_path):
    folder = str(tmp_path / "runs")
    config = ModelConfig("y", "regression", "Ridge Regression")
    append_run(run_record(spark, data_source="t.csv", target_col="y", task_type="regression", model_config=config), folder)
    append_run(run_record(spark, data_source="u.csv", target_col="gone", task_type=None, notes="second"), folder)
    runs = {r["data_source"]: r for r in load_runs(spark, folder).collect()}
    assert runs["t.csv"]["model_config"]["cv_folds"] == 5 and runs["t.csv"]["config_version"] == "2.0"
    known = {r["data_source"]: r["target_col"] for r in usable_targets(load_runs(spark, folder), ["y"]).collect()}
    assert known == {"t.csv": "y", "u.csv": None}
    lines = spark.createDataFrame([("[1]",), ("{",), ('{"target_col": "y"}',)], "value string")
    assert parse_runs(lines, F.col("value")).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(40)], "x double, y string")
    write_predictions(df, str(tmp_path / "csv"), "csv")
    assert read_table(spark, str(tmp_path / "csv/*.csv"))[0].count() == 40
    write_predictions(df, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 40
    facts = report_facts(df, "demo", "y", "classification")
    write_report(facts, report_lines(facts), str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out/report")).collect()]
    assert "## 1. Overview" in lines and "| n_rows | 40 |" in lines
    assert any(line.startswith("- `y` is the target") for line in lines)


def test_files_of_many_encodings_are_read_once(spark, tmp_path):
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    words = {"utf-8": "中文é", "utf-8-sig": "中é", "gbk": "数据文", "gb18030": "𠀀数", "latin1": "na\xefve\xff"}
    for encoding, word in words.items():
        put(tmp_path, f"{encoding}.csv", "name,n\n" + "".join(f"{word},{i}\n" for i in range(7)), encoding)
    df, files = read_table(spark, str(tmp_path / "*.csv"))
    assert {r["name"] for r in df.collect()} == set(words.values()) and df.count() == 35 and df.where("n = 3").count() == 5
    assert {r["encoding"] for r in files.collect()} == {"utf-8", "gbk", "gb18030", "latin1"}
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before
    assert df._jdf.queryExecution().sparkPlan().toString().count("FileScan csv") == 1


def test_files_of_many_encodings_with_cells_over_lines(spark, tmp_path):
    put(tmp_path, "a.csv", "name,n\n" + "".join(f'"中\n文",{i}\n' for i in range(6)), "gbk")
    put(tmp_path, "b.csv", "name,n\n" + "".join(f"é,{i}\n" for i in range(6)), "utf-8")
    df, _ = read_table(spark, str(tmp_path / "*.csv"))
    assert sorted(r["name"] for r in df.collect()) == ["中\n文"] * 6 + ["é"] * 6 or sorted(r["name"] for r in df.collect()) == ["é"] * 6 + ["中\n文"] * 6


@pytest.mark.parametrize("size", [1, 30, 31, 99, 100, 1000])
def test_first_rows(spark, size):
    df = spark.range(0, 100, 1, 7).selectExpr("id", "id * 2 AS x")
    assert [r["id"] for r in first_rows(df, size).orderBy("id").collect()] == list(range(min(size, 100)))
    assert first_rows(df.where("id < 0"), size).count() == 0


def test_latin1_files_grow_in_number_with_the_text(spark, tmp_path, monkeypatch):
    rows = [(i, f"row {i} " + ("caf\u00e9 " if i % 2 else "") + "x" * 100) for i in range(400)] + [(400, None), (401, "\u4e2d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(ingest, "LATIN1_FILE_BYTES", 5000)
    found = ingest.q_latin1_late_ingest(spark, str(tmp_path))
    assert len(found.inputFiles()) >= 8
    want = {(i, hashlib.md5(text.encode()).hexdigest()) for i, text in rows[:400]}
    assert {tuple(r) for r in found.collect()} == want
