"""NPZ array files as a bundle table with one row per sample."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from tabloom.operators.arrays import BUNDLE_SCHEMA

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

ROWS_PER_BATCH = 256


def _rows(path: str, position: int, name: str, array: np.ndarray) -> Iterator[pd.DataFrame]:
    array = np.asarray(array)
    samples = array.reshape(1) if array.ndim == 0 else array
    shape = [int(n) for n in samples.shape[1:]]
    numeric = np.issubdtype(array.dtype, np.number) or array.dtype == bool
    flat = samples.reshape(len(samples), -1) if len(samples) else samples.reshape(0, 0)
    for start in range(0, len(samples), ROWS_PER_BATCH):
        part = flat[start:start + ROWS_PER_BATCH]
        yield pd.DataFrame({
            "file": path, "position": position, "name": name,
            "sample_index": np.arange(start, start + len(part)),
            "shape": [shape] * len(part), "dtype": str(array.dtype),
            "values": [row.astype("float64") if numeric else np.empty(0) for row in part],
            "text": [None if numeric else " ".join(map(str, row)) for row in part],
        })


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            if not content:
                raise ValueError(f"empty file: {path}")
            with np.load(BytesIO(content), allow_pickle=False) as arrays:
                if not arrays.files:
                    raise ValueError(f"no arrays in {path}")
                for position, name in enumerate(arrays.files):
                    yield from _rows(path, position, name, arrays[name])


def read_npz(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All arrays of all files; files are decoded in parallel, one file at a time per task."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_decode, BUNDLE_SCHEMA)
