"""Quality rules: a threshold table compiled into one projection of ratios, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import text_or_empty, words_of

WINDOW = 8

# fixed values: frequent function words of the four languages
STOP_WORDS = (
    # English
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "were", "which", "with",
    # German
    "als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht",
    "sich", "und", "von", "zu",
    # French
    "au", "aux", "dans", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    # Spanish
    "con", "de", "del", "el", "es", "las", "lo", "los", "no", "para", "por", "se", "su", "y",
)


@dataclass(frozen=True)
class Threshold:
    """``low <= 100 * part / whole <= high``, compared in whole numbers; None leaves a side open."""

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None


# Measures a rule may name are those of ``measures``.
THRESHOLDS = (
    Threshold("words", "n_words", "one", 2000, None),
    Threshold("repeated_words", "n_repeat_words", "n_words", None, 30),
    Threshold("word_length", "word_chars", "n_words", 200, 1200),
    Threshold("symbols", "n_symbols", "n_words", None, 20),
    Threshold("exclamations", "n_exclamations", "n_words", None, 50),
    Threshold("stop_words", "n_stop_words", "n_words", 5, None),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Threshold("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Threshold("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
)
BASE = ("words", "repeated_words")


def _repeat_words(docs: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside windows of eight that occur twice or more in the text.

    Word hashes are combined to window hashes; only texts with an equal pair of windows sort
    theirs. Sorted by hash, a repeated window equals a neighbour; sorted by place, each covers
    eight words or as many as lie before the next one. Everything is linear but the two sorts.
    """
    combined = [F.get(F.col("hashes"), F.lit(k)) for k in range(WINDOW)]
    windows = F.transform(
        F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(F.col("hashes"), i + k) for k in range(1, len(combined))]),
    )
    places = F.transform(F.col("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    neighbour = lambda i: F.get(F.col("places"), i).getField("h")
    repeated = F.filter(
        F.col("places"),
        lambda x, i: F.coalesce((i > 0) & (neighbour(F.greatest(i - 1, F.lit(0))) == x["h"]), F.lit(False))
        | F.coalesce(neighbour(i + 1) == x["h"], F.lit(False)),
    )
    covered = F.transform(
        F.col("starts"),
        lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), i + 1) - s, F.lit(WINDOW))),
    )
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    return (
        docs.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("windows", windows)
        .withColumn("places", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(places)).otherwise(empty))
        .withColumn("starts", F.sort_array(F.transform(repeated, lambda x: x["i"])))
        .withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as ``doc_id`` and the counts the thresholds compare. A null text counts as empty."""
    one_line = F.lit("[^\\x20\\x09-\\x0D]")
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("body"))
    split = base.withColumn("words", words_of(F.col("body"))).withColumn(
        "lines", F.filter(F.split("body", "\n", -1), lambda line: F.regexp_like(line, one_line))
    )
    missing = lambda pattern: (F.length("body") - F.length(F.regexp_replace("body", pattern, ""))).cast("long")
    lines_like = lambda pattern: F.size(F.filter("lines", lambda line: F.regexp_like(line, F.lit(pattern)))).cast("long")
    counts = [
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        missing(r"[#*$%&|<>]+").alias("n_symbols"),
        missing(r"!+").alias("n_exclamations"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        lines_like(r"^[\x20\x09]*[-*•]").alias("n_bullet_lines"),
        lines_like(r"(\.\.\.|…)[\x20\x09]*$").alias("n_ellipsis_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.col("n_repeat_words"),
    ]
    # Through an array of one row: else a filter on a verdict moves below all of this, with every
    # step written out again in each place that uses it.
    return _repeat_words(split).select("doc_id", F.inline(F.array(F.struct(*counts))))


def compile_rule(rule: Threshold) -> Column:
    """True where the rule is broken. A zero whole breaks nothing but a lower bound on it."""
    part = 100 * F.col(rule.part)
    whole = F.lit(1) if rule.whole == "one" else F.col(rule.whole)
    broken = F.lit(False)
    if rule.low is not None:
        broken = broken | (part < rule.low * whole)
    if rule.high is not None:
        broken = broken | (part > rule.high * whole)
    return broken


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """One row per input row: the measures, ``base_failed``, ``kept`` and the broken rules' names.

    Null texts count as empty and so break the rule on length; null ids stay null; repeated rows
    are judged one by one; other columns of the input don't matter. An empty table gives none.
    """
    judged = measures(docs, id_col, text_col)
    names = F.concat_ws(",", *[F.when(compile_rule(r), F.lit(r.name)) for r in thresholds])
    base = [compile_rule(r) for r in thresholds if r.name in BASE]
    failed = F.lit(False)
    for rule in base:
        failed = failed | rule
    return judged.withColumn("failed_rules", names).withColumn("base_failed", failed).withColumn("kept", F.col("failed_rules") == "")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that break no rule."""
    # Judged beside the row: the texts are not shuffled, and no key is needed.
    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    base = packed.select(F.col("row").alias("doc_id"), "text")
    return quality_rules(base).where("kept").select("doc_id.*")
