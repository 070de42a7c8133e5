"""URL filters: host and path rules, and boosted trees on lexical features where no rule fits.

Trees are trained on labelled URLs; the query takes those that a rule decides. Features are lengths,
depth, digit and symbol ratios, character entropy, parameter counts, and statistics of the host's
suffix. Everything is a column expression or a fitted stage of Spark's own library.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER, UPPER, fresh, keep

ALLOW, BLOCK = "allow", "block"
MOST_LABELLED = 20_000  # labelled URLs that the trees are fitted on, half of them of each verdict at most, chosen by hash
TREES, DEPTH, RATE = 20, 4, 0.2
PRIOR = 10.0  # a suffix's share of blocked URLs starts from the share of all, with this weight
SMALL_TABLE = 100_000  # suffixes, of at most 253 bytes, that may be broadcast
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "symbol_ratio", "entropy", "n_parameters",
    "longest_label", "secure", "suffix_length", "suffix_blocked",
)


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and all its subdomains where the path starts with ``/path``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1] if "/" in self.text else ""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def judged_by_rules(urls: DataFrame, url_col: str, rules: list[Rule]) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``, the last two null where no rule fits."""
    split = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return split.withColumns({"rule": text, "verdict": verdict})


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _entropy(text: Column) -> Column:
    """Bits per character: each distinct one counted by what remains without it."""
    letters = F.split(text, "")
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    bits = F.transform(F.filter(F.array_distinct(letters), lambda c: c != ""), lambda c: -share(c) * F.log2(share(c)))
    return F.aggregate(bits, F.lit(0.0), lambda a, x: a + x)


def lexical(judged: DataFrame, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    without = lambda pattern: F.length(url) - F.length(F.regexp_replace(url, pattern, ""))
    labels = F.split("host", r"\.")
    columns = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda part: part != "")),
        "host_labels": F.size(labels),
        "digit_ratio": without("[0-9]+") / size,
        "symbol_ratio": without("[-_~%+=&.]+") / size,
        "entropy": _entropy(url),
        "n_parameters": F.regexp_count(url, F.lit("[?&][^=&#]+=")),
        "longest_label": F.array_max(F.transform(labels, lambda label: F.length(label))),
        "secure": F.lower(F.substring(url, 1, 8)).eqNullSafe(F.lit("https://")),
    }
    return judged.select("*", *[c.cast("double").alias(name) for name, c in columns.items()], suffix_of(F.col("host")).alias("suffix"))


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """A row for each suffix of all URLs: its length, and the share of blocked labels.

    The share is smoothed to that of all labels, so a suffix without a label says nothing either way.
    """
    blocked = F.sum(F.when(F.col("verdict") == BLOCK, 1).otherwise(0))
    counts = rows.groupBy("suffix").agg(F.count("verdict").alias("labelled"), blocked.alias("blocked"))
    counts = keep(counts, "suffixes")
    total = counts.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    prior = (total["blocked"] or 0) / max(1, total["labelled"] or 0)
    table = counts.select(
        F.col("suffix").alias("of_suffix"), F.length("suffix").cast("double").alias("suffix_length"),
        ((F.col("blocked") + PRIOR * prior) / (F.col("labelled") + PRIOR)).alias("suffix_blocked"),
    )
    return F.broadcast(table) if counts.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE else table


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def fit(rows: DataFrame, most: int = MOST_LABELLED, seed: int = 2) -> GBTClassificationModel | None:
    """Trees fitted on ``verdict`` of at most ``most`` rows, ``most / 2`` of a verdict; None without an example of each verdict.

    Rows are chosen by a hash of their URL, so reruns choose the same.
    """
    labelled = rows.where("verdict is not null").withColumn("order", F.xxhash64(F.lit(seed), "url"))
    halves = [labelled.where(F.col("verdict") == v).orderBy("order", *FEATURES).limit(most // 2) for v in (ALLOW, BLOCK)]
    chosen = keep(halves[0].union(halves[1]).select((F.col("verdict") == BLOCK).cast("double").alias("label"), *FEATURES), "labelled")
    sizes = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    # both verdicts weigh the same, whatever the rules decide more often
    chosen = chosen.withColumn("weight", F.when(F.col("label") == 1.0, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0]) * sum(sizes.values()))
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=seed, cacheNodeIds=False)
    return trees.fit(_assembled(chosen).select("label", "weight", "features").coalesce(4))


def filter_urls(urls: DataFrame, rules: list[Rule], url_col: str = "url", labels: DataFrame | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of ``urls`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_probability``.

    Input columns of those names are replaced. A rule's verdict stands; elsewhere the trees decide.
    ``labels`` (``url``, ``verdict``) train them, by default the URLs that a rule decides; without an
    example of each verdict they can't be fitted, and what no rule decides is allowed, with a null
    probability. A null URL or one without ``://`` has an empty host and path, fits no rule and goes
    to the trees as it is. Repeated rows are judged one by one; an empty table gives none.
    """
    result = ("host", "path", "rule", "verdict", "block_probability")
    urls = urls.drop(*result)
    row, url = fresh(urls, "row", "url")
    packed = urls.select(F.struct("*").alias(row), F.col(f"`{url_col}`").alias("url"))
    rows = lexical(judged_by_rules(packed, "url", rules), "url")
    examples = rows if labels is None else lexical(
        judged_by_rules(labels.select("url", F.col("verdict").alias("given")), "url", rules).withColumn("verdict", F.col("given")), "url"
    )
    suffixes = suffix_statistics(rows if labels is None else rows.select("suffix", F.lit(None).cast("string").alias("verdict")).union(examples.select("suffix", "verdict")))
    model = fit(examples.join(suffixes, F.col("suffix") == F.col("of_suffix")), most)
    own = [F.col(f"{row}.`{c}`") for c in urls.columns]
    if model is None:
        return rows.select(*own, "host", "path", "rule", F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    scored = model.transform(_assembled(rows.join(suffixes, F.col("suffix") == F.col("of_suffix"))))
    chance = vector_to_array("probability")[1]
    judged = F.when(F.col("prediction") == 1.0, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.select(*own, "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"), F.round(chance, 6).alias("block_probability"))
