"""Delimited tables: encoding and header checks per file, pandas-like types, then one Spark read.

One pass over all bytes finds each file's encoding and whether a quoted cell spans lines; it is
split over tasks like any read. Only the header line is fetched by opening a file. What is known of
the files stays a table; the driver sees one row for each kind of file.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.names import check_names, clean_column_names, column
from tabloom.operators.lanes import local_table, per_column, union_all
from tabloom.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

# Encodings in the order they are tried, and what Spark's reader calls them.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb18030", "latin1")
SPARK_ENCODINGS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin1": "ISO-8859-1"}
PYTHON_ENCODINGS = {"gbk", "gb18030"}
# Delimiter by file suffix, and other formats read as they are.
DELIMITERS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}
OTHER_FORMATS = {".parquet": "parquet", ".json": "json", ".orc": "orc"}
# Cells that read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CHUNK_BYTES = 1 << 20
KINDS_SHOWN = 100
MIN_ROWS, MIN_COLUMNS = 5, 2
INTEGER_SHAPE = r"^\s*[+-]?\d+\s*$"
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|Inf|INF|infinity|Infinity)\s*$"
HEAD_SCHEMA = "path string, length bigint, head binary"
FITS_SCHEMA = "path string, gbk boolean, gb18030 boolean"


class TableError(ValueError):
    """The input cannot be read as a table."""


def list_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, length)`` of the files behind a path, folder or pattern; contents are not read."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"))


def _first_line(path: str) -> bytes:
    """Bytes up to the first line break, however far that is."""
    if path.startswith("file:"):
        system, inner = pyarrow.fs.LocalFileSystem(), "/" + unquote(path).removeprefix("file:").lstrip("/")
    else:
        system, inner = pyarrow.fs.FileSystem.from_uri(path)
    head = b""
    with system.open_input_stream(inner) as handle:
        while chunk := handle.read(CHUNK_BYTES):
            head += chunk
            if b"\n" in chunk or b"\r" in chunk:
                break
    return head.splitlines()[0] if head else b""


def _read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(head=[_first_line(path) for path in batch["path"]])


def _fitting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whether the lines of each file decode, for every batch of them."""
    for batch in batches:
        rows = []
        for path, lines in batch.groupby("path")["value"]:
            raw = b"\n".join(lines)
            rows.append((path, *[detect_fit(raw, name) for name in ("gbk", "gb18030")]))
        yield pd.DataFrame(rows, columns=["path", "gbk", "gb18030"])


def detect_fit(raw: bytes, encoding: str) -> bool:
    try:
        raw.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def file_facts(spark: SparkSession, path: str | Sequence[str], text: bool = True) -> DataFrame:
    """``(path, length, encoding, header, open_quotes)`` per file; ``encoding`` is NULL for an empty file.

    All lines are read, so a late character of another encoding counts like an early one. The
    Python part sees only files that are not UTF-8. ``text=False`` lists the files only.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = list_files(spark, paths)
    if not text:
        return cut_lineage(files.select("path", "length", F.lit("binary").alias("encoding")))
    # the text source gives the bytes of a line as they are
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    scanned = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(F.expr("regexp_count(value, '\"') % 2 = 1")).alias("open_quotes"),
        F.bool_or(F.trim("value") != "").alias("filled"),
    )
    heads = files.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(_read_heads, HEAD_SCHEMA)
    facts = cut_lineage(heads.join(scanned, "path", "left"))
    others = facts.where(~F.col("utf8")).select("path")
    if not others.isEmpty():
        fits = lines.join(others, "path", "left_semi").select("path", F.col("value").cast("binary")).mapInPandas(_fitting, FITS_SCHEMA).groupBy("path").agg(
            F.bool_and("gbk").alias("gbk"), F.bool_and("gb18030").alias("gb18030"))
        facts = cut_lineage(facts.join(fits, "path", "left"))
    else:
        facts = facts.withColumns({"gbk": F.lit(False), "gb18030": F.lit(False)})
    encoding = F.when(F.coalesce("filled", F.lit(False)), F.when(F.col("utf8"), "utf-8").when(F.col("gbk"), "gbk").when(
        F.col("gb18030"), "gb18030").otherwise(ENCODINGS[-1]))
    return facts.select("path", "length", encoding.alias("encoding"), "head", F.coalesce("open_quotes", F.lit(False)).alias("open_quotes"))


def parse_header(line: str, delimiter: str) -> list[str]:
    """Column names of a header line, stripped; refuses blank, empty and duplicate names."""
    if not line.strip():
        raise TableError("no header: the first line must hold the column names")
    names = _split_header(line, delimiter)
    try:
        check_names(names)
    except ValueError as error:
        raise TableError(str(error)) from error
    return names


def _split_header(line: str, delimiter: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([line], delimiter=delimiter))]


def _header(encoding: str, head: bytes) -> str:
    return bytes(head).decode(encoding).lstrip("\ufeff")


def _other_headers(batches: Iterator[pd.DataFrame], names: list[str], delimiter: str) -> Iterator[pd.DataFrame]:
    """Paths of the files that have other names."""
    for batch in batches:
        rows = zip(batch["path"], batch["encoding"], batch["head"])
        yield pd.DataFrame({"path": [p for p, encoding, head in rows if _split_header(_header(encoding, head), delimiter) != names]}, dtype=object)


def _null_tokens(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    return df.select(*[
        F.when(~column(name).isin(list(tokens)), column(name)).alias(name) for name in df.columns])


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type per text column from one scan of all rows: bigint, double, boolean or string."""
    ref = F.col("value")

    def all_cells(test: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(ref.isNotNull(), F.coalesce(test, F.lit(False)))), F.lit(True))

    measures = [
        F.count(ref).alias("n"),
        all_cells(ref.rlike(INTEGER_SHAPE) & F.trim(ref).try_cast("bigint").isNotNull()).alias("integers"),
        all_cells(ref.rlike(NUMBER_SHAPE)).alias("numbers"),
        all_cells(F.lower(ref).isin("true", "false")).alias("booleans"),
    ]
    rows = per_column(
        df, df.columns, column, measures, "column string, n bigint, integers boolean, numbers boolean, booleans boolean"
    ).collect()
    types = dict.fromkeys(df.columns, "double")
    for row in rows:
        if row["n"] == 0:
            types[row["column"]] = "double"
        elif row["integers"]:
            types[row["column"]] = "bigint"
        elif row["numbers"]:
            types[row["column"]] = "double"
        else:
            types[row["column"]] = "boolean" if row["booleans"] else "string"
    return types


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    refs = []
    for name in df.columns:
        wanted = types[name]
        ref = column(name)
        refs.append((ref if wanted == "string" else F.trim(ref).try_cast(wanted)).alias(name))
    return df.select(*refs)


def validate_table(df: DataFrame, allow_tiny: bool = False) -> None:
    """Refuse tables without rows, with fewer than two columns or (unless tiny is fine) five rows."""
    check_names(df.columns)
    if len(df.columns) < MIN_COLUMNS:
        raise TableError("a table needs at least two columns: features and a target")
    seen = df.limit(MIN_ROWS).count()
    if seen == 0:
        raise TableError("no data rows")
    if seen < MIN_ROWS and not allow_tiny:
        raise TableError("fewer than 5 rows")


def first_rows(df: DataFrame, size: int) -> DataFrame:
    """The first ``size`` rows in the order of the parts that ``df`` is read in, kept for all later passes.

    The parts are counted first, one row for each of them; so every task knows how many rows to keep
    and none gets the rows of others.
    """
    number, part, row = "__number", "__part", "__row"
    shift = 33  # the number of a row is that of its part, then 33 bits for its place there
    numbered = df.withColumn(number, F.monotonically_increasing_id())
    placed = numbered.withColumns({part: F.shiftright(number, shift), row: F.col(number).bitwiseAND((1 << shift) - 1)})
    # the first column is read too, as a reader that needs no cell might count lines otherwise
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.count(column(df.columns[0])).alias("cells")).collect()
    taken, left = [], size
    for found in sorted(counts, key=lambda r: r[part]):
        if left > 0:
            taken.append((found[part], min(found["n"], left)))
            left -= found["n"]
    limits = local_table(df.sparkSession, taken, "__of bigint, __upto bigint")
    kept = placed.join(F.broadcast(limits), F.col(part) == F.col("__of")).where(F.col(row) < F.col("__upto"))
    return cut_lineage(kept.select(*[column(c) for c in df.columns]))


def read_table(
    spark: SparkSession, path: str | Sequence[str], *, schema: T.StructType | str | None = None,
    sample_rows: int | None = None, multi_line: bool | None = None, allow_tiny: bool = False,
    na_tokens: Sequence[str] = NA_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """Read and check a table; returns it with a metadata table, one row per file.

    Files are delimited by their suffix (comma for .csv, tab for .tsv and .txt) and may differ in
    encoding but not in header. ``schema`` saves the type-inference scan. ``multi_line=None``
    looks for quoted line breaks first; with none found the files stay splittable.
    """
    files = list_files(spark, path).select(F.regexp_extract(F.lower("path"), r"\.[^./]*$", 0).alias("suffix"))
    suffixes = {row["suffix"] for row in files.distinct().limit(KINDS_SHOWN).collect()}
    if not suffixes:
        raise TableError(f"no files behind {path}")
    unknown = suffixes - DELIMITERS.keys() - OTHER_FORMATS.keys()
    if unknown:
        raise TableError(f"unsupported file type: {', '.join(sorted(unknown)) or 'none'}")
    if len(suffixes) > 1:
        raise TableError("files of different types: read them one type at a time")
    suffix = suffixes.pop()
    facts = file_facts(spark, path, suffix in DELIMITERS)
    if suffix in OTHER_FORMATS:
        df, form = spark.read.format(OTHER_FORMATS[suffix]).load(path), OTHER_FORMATS[suffix]
    else:
        df = _null_tokens(_read_delimited(spark, path, facts, DELIMITERS[suffix], multi_line), na_tokens)
        form = "tsv" if DELIMITERS[suffix] == "\t" else "csv"
    df = clean_column_names(df)
    if sample_rows:
        df = first_rows(df, sample_rows)
    if suffix in DELIMITERS:
        if schema is None:
            df = apply_types(df, infer_types(df))
        else:
            wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            df = apply_types(df, {f.name: f.dataType.simpleString() for f in wanted.fields})
    validate_table(df, allow_tiny)
    return df, facts.select(
        F.col("path").alias("source"), "encoding", F.lit(form).alias("format"), F.col("length").alias("size_bytes"),
        F.lit(sample_rows).cast("bigint").alias("sample_rows"))


def _read_delimited(
    spark: SparkSession, path: str | Sequence[str], facts: DataFrame, delimiter: str, multi_line: bool | None
) -> DataFrame:
    """One read by the given path for all encodings, and another if in some files cells span lines."""
    empty = facts.where("encoding IS NULL").limit(5).collect()
    if empty:
        raise TableError(f"empty file: {', '.join(unquote(row['path']) for row in empty)}")
    spans = F.col("open_quotes") if multi_line is None else F.lit(multi_line)
    marked = facts.withColumn("spans", spans)
    first = marked.orderBy("path").select("path", "encoding", "head").first()
    names = parse_header(_header(first["encoding"], first["head"]), delimiter)
    headers = marked.groupBy("encoding", "head").agg(F.min("path").alias("path")).select("path", "encoding", "head")
    others = headers.mapInPandas(lambda it: _other_headers(it, names, delimiter), "path string").orderBy("path").first()
    if others:
        raise TableError(f"header of {unquote(others['path'])} differs from {unquote(first['path'])}")
    text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    # of these there are two for each encoding at most
    wanted = sorted((row["encoding"], row["spans"]) for row in marked.select("encoding", "spans").distinct().collect())
    encodings = {encoding for encoding, _ in wanted}
    # bytes come through as they are in Latin-1, so one read serves files of all encodings
    single = len(encodings) == 1 and not encodings & PYTHON_ENCODINGS
    read_as = SPARK_ENCODINGS[wanted[0][0]] if single else SPARK_ENCODINGS["latin1"]
    kinds = sorted({over_lines for _, over_lines in wanted})
    frames = []
    for over_lines in kinds:
        frame = (
            spark.read.schema(text)
            .options(header=True, sep=delimiter, encoding=read_as, multiLine=over_lines, quote='"', escape='"')
            .csv(path))
        if not single or len(kinds) > 1:
            # files whose cells span lines can't be split, so the others are read without them
            own = marked.where(F.col("spans") == over_lines).select(F.col("path").alias("__file"), F.col("encoding").alias("__encoding"))
            frame = frame.select(*[column(name) for name in names], F.col("_metadata.file_path").alias("__path")).join(
                own, F.col("__path") == F.col("__file"))
            cells = [column(name) if single else _decoded(column(name), F.col("__encoding"), encodings).alias(name) for name in names]
            frame = frame.select(*cells)
        frames.append(frame)
    return union_all(frames)


def _decoded(cell: Column, encoding: Column, encodings: set[str]) -> Column:
    """A cell read as Latin-1 in the encoding of its file. Only files that Spark can't decode go through Python."""
    raw = F.encode(cell, "ISO-8859-1")
    text = F.when(encoding.isin("utf-8", "utf-8-sig"), F.decode(raw, "UTF-8")).when(encoding == "latin1", cell)
    if encodings & PYTHON_ENCODINGS:
        odd = encoding.isin(*sorted(PYTHON_ENCODINGS))
        text = text.otherwise(F.pandas_udf(_decode_cells, "string")(F.when(odd, raw), F.when(odd, encoding)))
    return text


def _decode_cells(raw: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else bytes(r).decode(e) for r, e in zip(raw, encoding)], dtype=object)


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, path)
