"""Run a registered query and its SQL counterpart and compare names, rows and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(sf_dir) / name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    return "" if value is None else str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, fn, sql: str, sf_dir: str) -> list[str]:
    df = fn(spark, sf_dir)
    got_names, got = _table(df.columns, [tuple(row) for row in df.collect()])
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    want_names, want = _table(names, relation.fetchall())
    found = []
    if got_names != want_names:
        found.append(f"columns {got_names} != {want_names}")
    if len(got) != len(want):
        found.append(f"rows {len(got)} != {len(want)}")
    if not found and got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        found.append(f"{len(bad)} rows differ, first: spark {bad[0][0]} sql {bad[0][1]}")
    return found
