"""Mixing sources to target weights: complete epochs, then Efraimidis-Spirakis sampling to a budget.

A document's key is ``u ** (1 / weight)`` with ``u`` from a hash; the largest keys of a source come
first. They are cut into ranges, so that a source with most of the rows is summed by many tasks:
sizes are summed per range, ranges are prefix-summed per source, and only the one range of each
source that its budget ends in is sorted. What remains is one cut point per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import WORD, fresh, keep, text_or_empty, unit_interval

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5  # of all sizes
MOST = 2.0  # times its source's size
RANGE_ROWS = 4_000  # rows of a source in one range, about
RESULT = ("size", "source_size", "target", "times")
SMALL_TABLE = 100_000  # rows of at most about 100 bytes that may be broadcast


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def quality_weight(text_col: str = "text") -> Column:
    """Between 1/2 and 1, less for a larger share of digits, symbols and exclamation marks."""
    text = text_or_empty(text_col)
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[0-9#*$%&|<>!]+", ""))
    return F.lit(1.0) - odd / (F.lit(2.0) * F.greatest(F.length(text), F.lit(1)))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a written table of at most ``rows`` rows; join a larger one by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` to ``source``, ``source_size``, ``n``, ``target``.

    The budget is shared by weight; a source whose share is above its limit gets the limit, and
    the excess goes to the others by weight. Ordered by limit per unit of weight, the limited
    sources come first, so running sums find the level at which the others stand. One row per
    source passes through these windows, never a document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_limit = Window.orderBy("ratio", F.col("source").isNull(), "source")
    all_rows = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    level = (F.lit(share) * F.sum("source_size").over(all_rows) - (F.sum("bound").over(by_limit) - F.col("bound"))) / (
        F.sum("w").over(all_rows) - (F.sum("w").over(by_limit) - F.col("w"))
    )
    found = (
        sources.withColumn("w", weight)
        .withColumn("bound", F.lit(most) * F.col("source_size"))
        .withColumn("ratio", F.col("bound") / F.col("w"))
        .withColumn("level", level)
    )
    # the level counts from the first source that stays under its limit, of equal limits the one
    # with the highest level; if none does, all get theirs
    stands = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("down")))).over(all_rows)
    target = F.least(F.col("bound"), F.coalesce(-stands.getField("down") * F.col("w"), F.col("bound")))
    return found.withColumn("target", target).select("source", "source_size", "n", "target")


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: its size, target, complete epochs, and the last row taken once more.

    ``rows`` has ``source, size, key, place, ranked``; ``ranked`` orders the rows of a source.
    """
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = keep(
        targets(sized, weights, share, most)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("n") / RANGE_ROWS).cast("long")),
        "goals",
    )
    small = _bounded(goals, SMALL_TABLE).withColumnRenamed("source", "goal")
    placed = rows.join(small, F.col("source").eqNullSafe(F.col("goal")))
    # small places first, as they belong to large keys
    ranged = placed.withColumn("range", F.least(F.floor(F.col("place") * F.col("ranges")).cast("long"), F.col("ranges") - 1))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("total"), F.first("rest").alias("rest"))
    before = F.sum("total").over(Window.partitionBy("source").orderBy("range")) - F.col("total")
    # the budget ends in the first range that reaches it; a budget of nothing ends before all
    ends = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("total") >= F.col("rest")))
    last = ends.select(F.col("source").alias("s"), F.col("range").alias("r"), "before", F.col("rest").alias("budget"))
    inside = ranged.join(_bounded(keep(last, "ends"), SMALL_TABLE), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("ranked").rowsBetween(Window.unboundedPreceding, 0))
    summed = inside.withColumn("upto", upto)
    # the row in which the budget ends is taken if that comes nearer to it
    taken = (F.col("upto") <= F.col("budget")) | (F.col("upto") - F.col("budget") < F.col("budget") - (F.col("upto") - F.col("size")))
    cut = summed.groupBy("source").agg(F.min("r").alias("cut_range"), F.max(F.when(taken, F.col("ranked"))).alias("cut"))
    return goals.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("goal"), "source_size", "target", "epochs", "ranges", "cut_range", "cut"
    )


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int, names: list[str]) -> DataFrame:
    """Adds size, place and ranked. The key is a function of id and text, so reruns agree."""
    size, place, ranked = names
    w = quality_weight(text_col) if weight is None else weight
    # one minus the key: the largest key first
    digest = F.md5(F.col(text_col).cast("binary"))
    value = F.lit(1.0) - F.pow(unit_interval(F.col(id_col), digest, F.lit(seed)), F.lit(1.0) / w)
    order = F.struct(F.col(place).alias("place"), F.col(id_col).cast("string").alias("id"), F.col(size).alias("size"), digest.alias("md5"))
    return docs.withColumn(size, word_count(text_col)).withColumn(place, value).withColumn(ranked, order)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: int = 8,
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``times`` taken.

    Columns of those names in the input are replaced; ``columns`` names what else is carried, by
    default all. Without the text, texts are read once; with it twice, and never shuffled. Every
    document is taken for the complete epochs its source's target holds; the rest of the target is
    filled in order of the keys, and the document in which it ends is taken if that comes nearer.
    ``weight``: a quality weight above zero, by default ``quality_weight``. Null sources are one
    source, the last; null texts have size zero; rows without an id differ by their text; rows
    equal in id and text share one random number and are taken together. An empty table gives none.
    """
    carried = [c for c in (docs.columns if columns is None else columns) if c not in RESULT]
    own = docs.drop(*RESULT)
    size, place, ranked, src, span = fresh(own, "size", "place", "ranked", "src", "span")
    base = _measured(own, id_col, text_col, source_col, weight, seed, [size, place, ranked])
    narrow = base.select(*[F.col(f"`{c}`") for c in carried if c != text_col], *[F.col(c).alias(c) for c in (size, place, ranked)], F.col(source_col).alias(src))
    narrow = keep(narrow, "sizes")
    rows = narrow.select(F.col(src).alias("source"), F.col(size).alias("size"), F.col(place).alias("place"), F.col(ranked).alias("ranked"))
    plan = keep(_plan(rows, weights, share, most), "mix")
    body = base.withColumn(src, F.col(source_col)) if text_col in carried else narrow
    joined = body.join(_bounded(plan.select(F.struct("*").alias(span)), SMALL_TABLE), F.col(src).eqNullSafe(F.col(f"{span}.goal")))
    at = F.least(F.floor(F.col(place) * F.col(f"{span}.ranges")).cast("long"), F.col(f"{span}.ranges") - 1)
    in_cut = (at == F.col(f"{span}.cut_range")) & (F.col(ranked) <= F.col(f"{span}.cut"))
    more = F.coalesce((at < F.col(f"{span}.cut_range")) | in_cut, F.lit(False))
    return joined.select(
        *[F.col(f"`{c}`") for c in carried],
        F.col(size).alias("size"), F.col(f"{span}.source_size").alias("source_size"), F.col(f"{span}.target").alias("target"),
        (F.col(f"{span}.epochs") + more.cast("long")).alias("times"),
    )


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    (copy,) = fresh(mixed, "copy")
    taken = mixed.where("times > 0").withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return taken.select(*[F.col(f"`{c}`") for c in columns])
