"""Column names: quoting, cleaning and the name rules used by roles and leakage checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a column name as date-like, or as risky next to a target.
DATE_WORDS = ("date", "time", "timestamp", "datetime", "created", "updated", "日期", "时间")
RISKY_WORDS = (
    "label", "target", "outcome", "result", "diagnosis", "class", "score",
    "结果", "标签", "诊断", "结局",
)
# Fixed value: characters dropped when two names are compared.
NAME_NOISE = "[^a-z0-9一-龥]"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """Reference a column whose name may hold dots or spaces."""
    return F.col(quoted(name))


def normalized_name(text: Column) -> Column:
    """Lower-case ``text`` and keep only a-z, 0-9 and CJK characters."""
    return F.regexp_replace(F.lower(text), NAME_NOISE, "")


def normalize_name(name: str) -> str:
    return re.sub(NAME_NOISE, "", name.lower())


def looks_like_datetime_name(name: str) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in DATE_WORDS)


def looks_like_identifier_name(name: str) -> bool:
    return name.lower().endswith("id")


def clean_column_names(df: DataFrame) -> DataFrame:
    """Strip blanks around column names; refuse empty names and names equal up to case."""
    stripped = [name.strip() for name in df.columns]
    check_names(stripped)
    return df.toDF(*stripped)


def check_names(names: list[str]) -> None:
    if any(name == "" for name in names):
        raise ValueError("empty column name: give every column a name")
    folded: dict[str, str] = {}
    clashes = set()
    for name in names:
        if name.lower() in folded:
            clashes.add(name)
        folded[name.lower()] = name
    if clashes:
        raise ValueError(f"duplicate column names: {', '.join(sorted(clashes))}")
