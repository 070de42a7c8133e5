"""Seeded row hashes: the order-free replacement for head, shuffle, split and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.names import column

HASH_RANGE = 2**32
SHORT_TEXT = 64


def compact(text: Column) -> Column:
    """Stand-in for ``text`` where only equality matters: long text becomes its SHA-256 digest.

    Keeps whole documents out of shuffles. The mark makes a stand-in longer than any text that is
    kept as it is, so the two never meet.
    """
    digest = F.concat(F.lit("sha256:"), F.sha2(text, 256))
    return F.when(F.octet_length(text) <= SHORT_TEXT, text).otherwise(digest)


def row_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Text key of a row. Equal rows share a key, so copies never straddle a split."""
    names = df.columns if columns is None else columns
    if len(names) == 1:
        return F.coalesce(column(names[0]).cast("string"), F.lit(""))
    return F.md5(F.to_json(F.struct(*[column(name).alias(f"c{i}") for i, name in enumerate(names)])))


def seeded_hash(key: Column, seed: int) -> Column:
    """Uniform 32-bit number per key, the same in any engine that has md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
