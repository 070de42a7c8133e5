"""Recognising text columns that hold dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (shape of the text, datetime pattern, the same pattern for strptime).
# The regular expression keeps ordinary text away from the parser, whose failures are costly.
DATE_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", "%Y-%m-%d"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-MM-dd[' ']['T']HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "%Y-%m-%d %H:%M:%S.%f"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd", "%Y/%m/%d"),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy", "%m/%d/%Y"),
    (r"^\d{8}$", "yyyyMMdd", "%Y%m%d"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy", "%d %b %Y"),
)


MAX_DATE_CHARS = 29


def parses_as(text: Column, shape: str, pattern: str) -> Column:
    """Whether ``text`` is a date in the given format."""
    # every format starts with a digit: most text is turned away without a regular expression
    likely = F.substring(text, 1, 1).between("0", "9") & (F.char_length(text) <= MAX_DATE_CHARS)
    parsed = F.when(likely, F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)).isNotNull()))
    return F.coalesce(parsed, F.lit(False))


def best_format_share(text: Column, cnt: Column) -> Column:
    """Aggregate over ``(value, cnt)``: share of cells that parse under the best single format."""
    total = F.sum(F.when(text.isNotNull(), cnt)).cast("double")
    hits = [
        F.sum(F.when(parses_as(text, shape, pattern), cnt).otherwise(0)) for shape, pattern, _ in DATE_FORMATS
    ]
    return F.coalesce(F.try_divide(F.greatest(*hits).cast("double"), total), F.lit(0.0))
