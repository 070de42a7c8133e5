"""A uniform shuffle into shards of exact sizes, through a hypergeometric communication matrix.

Rows are dealt to partitions by a hash. The matrix says how many rows of each partition go to each
shard; its rows sum to the partitions' sizes and its columns to the shards' sizes, and it is drawn
as the counts of a uniform permutation are distributed. Each partition is permuted and cut by its
row of the matrix, the rows are exchanged, and each shard is permuted again.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import fresh, keep, text_or_empty

PART_ROWS = 8192  # rows of a partition, about, while there are fewer than MOST_PARTS
MOST_PARTS = 16384  # bounds the matrix on the driver, and only its size: partitions grow beyond it
_MOST_DRAWN = 5 * 10**8  # of a kind, by numpy's own draw
PRIME = 2147483647  # larger than any partition, so multiplying by it permutes the places


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts ``[partition, shard]`` with the given sums, as a uniform permutation has them."""
    rng = np.random.default_rng(seed)
    left = np.array(shards, np.int64)
    matrix = np.zeros((len(parts), len(shards)), np.int64)
    for i, n in enumerate(parts):
        total = int(left.sum())
        for j in range(len(shards)):
            # of this partition's rows not dealt yet, those that fall to shard j among j and later
            rest = total - int(left[j])
            matrix[i, j] = _hypergeometric(rng, int(left[j]), rest, n)
            n -= int(matrix[i, j])
            total = rest
        left -= matrix[i]
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``good`` and ``bad`` are good; the generator's own draw ends at 10^9 of a kind."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < _MOST_DRAWN:
        return int(rng.hypergeometric(good, bad, n))
    return _inverted(rng.random(), good, bad, n)


def _log_binomial(x: int, n: int, p: float) -> float:
    """Logarithm of the chance of ``x`` of ``n``, to full precision for any size (saddle points, no differences of large numbers)."""
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)

    def rest(k: int) -> float:  # of Stirling's formula
        if k <= 15:
            return math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi)
        return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * k * k)) / (k * k)) / (k * k)) / k

    def deviance(k: float, mean: float) -> float:
        if abs(k - mean) >= 0.1 * (k + mean):
            return k * math.log(k / mean) + mean - k
        v = (k - mean) / (k + mean)
        total, term, j = (k - mean) * v, 2 * k * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return more
            total, j = more, j + 1

    spread = rest(n) - rest(x) - rest(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p))
    return spread + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


def _inverted(u: float, good: int, bad: int, n: int) -> int:
    """The draw that belongs to ``u``: chances are summed from the likeliest count outwards, each from its neighbour's."""
    p = n / (good + bad)
    low, high = max(0, n - bad), min(good, n)
    below = above = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    p_below = p_above = math.exp(
        _log_binomial(above, good, p) + _log_binomial(n - above, bad, p) - _log_binomial(n, good + bad, p)) if p < 1 else 1.0
    u -= p_above
    last = above
    while u > 0 and (p_above > 0 or p_below > 0):
        p_above *= (good - above) / (above + 1) * ((n - above) / (bad - n + above + 1)) if above < high else 0.0
        if p_above:
            above += 1
            u, last = u - p_above, above
        if u > 0:
            p_below *= below / (good - below + 1) * ((bad - n + below) / (n - below + 1)) if below > low else 0.0
            if p_below:
                below -= 1
                u, last = u - p_below, below
    return last


def shard_sizes(rows: int, shards: int) -> list[int]:
    """At most one apart, the larger ones first."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """The matrix as ``part, shards, from, to``: which places of a partition go to which shard."""
    ends = matrix.cumsum(axis=1)
    cells = F.from_json(F.lit(json.dumps(ends.tolist())), "array<array<bigint>>")
    return spark.range(1).select(F.posexplode(cells).alias("part", "ends"))


def _hashable(docs: DataFrame, name: str) -> Column:
    kind = docs.schema[name].dataType.simpleString()
    ref = F.col(f"`{name}`")
    return F.to_json(F.struct(ref)) if "map<" in kind or "variant" in kind else ref


def shard(docs: DataFrame, shards: int = 40, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``, which count from zero without a gap.

    Input columns of those names are replaced. Shards hold as many rows as each other or one more.
    Ids may be null or repeated and texts null; rows equal in both are told apart by all their
    columns, and rows equal in all of them are interchangeable and land in places of their own. An
    empty table gives none. Only columns the result uses are exchanged, twice. Where many rows are
    equal in id and text the table is written once more with a number for each row, so that no task
    gets all of them.
    """
    return _dealt(docs.drop("shard", "slot"), shards, seed, [id_col, text_col], part_rows, None)


def _salted(docs: DataFrame, hot: Column, whole: Column) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells the rows of hot cells apart: by all their columns, and equal rows by a number.

    Equal rows are numbered from one in each part of the written table and shifted by the parts before,
    so a run over other parts hands out the same numbers. No task gets all rows of a cell.
    """
    number, salt, key, task, before, count = fresh(docs, "number", "salt", "key", "task", "before", "count")
    numbered = keep(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = numbered.where(hot).select(number, whole.alias(key), F.shiftright(number, 33).alias(task))
    sums = rows.groupBy(key, task).agg(F.count("*").alias(count))
    earlier = F.sum(count).over(Window.partitionBy(key).orderBy(task)) - F.col(count)
    place = F.row_number().over(Window.partitionBy(key, task).orderBy(number)) + F.col(before)
    salts = rows.join(sums.select(key, task, earlier.alias(before)), [key, task]).select(number, F.xxhash64(F.col(key), place).alias(salt))
    return numbered.join(salts, number, "left").withColumn(salt, F.coalesce(salt, F.lit(0))).drop(number), salt


def _dealt(docs: DataFrame, shards: int, seed: int, named: list[str], part_rows: int, salt: str | None) -> DataFrame:
    spark = docs.sparkSession
    part, rank, place, n, part2, ends, lot, piece, where, rows_, total, before, at = fresh(
        docs, "part", "rank", "place", "n", "part2", "ends", "lot", "piece", "where", "rows", "total", "before", "at"
    )
    row = [_hashable(docs, c) for c in [*named, *([salt] if salt else [])]]
    draw = lambda k: F.xxhash64(F.lit(seed * 8 + k), *row)
    whole = F.xxhash64(F.lit(seed * 8 + 3), *[_hashable(docs, c) for c in docs.columns])
    sized = docs.groupBy(F.pmod(draw(0), F.lit(MOST_PARTS)).alias("fine")).agg(F.count("*").alias("n"))
    counts = {r["fine"]: r["n"] for r in sized.collect()}  # a number for each of MOST_PARTS cells at most
    rows = sum(counts.values())
    hot = [cell for cell, count in counts.items() if count > 4 * max(part_rows, rows // MOST_PARTS)]
    if hot and salt is None:
        salted, salt = _salted(docs, F.pmod(draw(0), F.lit(MOST_PARTS)).isin(hot), whole)
        return _dealt(salted, shards, seed, named, part_rows, salt).drop(salt)
    n_parts = max(1, min(MOST_PARTS, math.ceil(rows / part_rows)))
    parts = [0] * n_parts
    for fine, count in counts.items():
        parts[fine % n_parts] += count
    matrix = communication_matrix(parts, shard_sizes(rows, shards), seed)
    table = _table(spark, matrix).toDF(part2, ends)
    # rows equal in id and text are ordered by all their columns, and equal in those they are the same
    own = Window.partitionBy(part).orderBy(rank, whole)
    # copies of a row are neighbours in this order; the multiplication takes them apart
    permuted = (
        docs.withColumn(part, F.pmod(F.pmod(draw(0), F.lit(MOST_PARTS)), F.lit(n_parts)).cast("int"))
        .withColumn(rank, draw(1))
        .withColumn(place, F.row_number().over(own).cast("long") - 1)
    )
    # sizes are known and the table has one row for each partition, MOST_PARTS at most
    dealt = (
        permuted.join(F.broadcast(table), F.col(part) == F.col(part2))
        .withColumn(n, F.element_at(ends, -1))
        .withColumn(at, F.pmod(F.col(place) * F.lit(PRIME), F.greatest(F.col(n), F.lit(1))))
        .withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(at))).cast("int"))
        .withColumn(lot, F.xxhash64(F.lit(seed * 8 + 2), part, at))
        .drop(part2, ends, n, rank, place)
    )
    # a shard is permuted in pieces, as it may be large; what lies before a piece is counted
    pieces = max(1, math.ceil(rows / shards / part_rows))
    cut = dealt.withColumn(piece, F.pmod(F.col(lot), F.lit(pieces)).cast("int"))
    sums = cut.groupBy("shard", piece).agg(F.count("*").alias(total))
    earlier = F.sum(total).over(Window.partitionBy("shard").orderBy(piece)) - F.col(total)
    offsets = keep(sums.select(F.col("shard").alias(where), F.col(piece).alias(rows_), earlier.alias(before)), "pieces")
    inner = F.row_number().over(Window.partitionBy("shard", piece).orderBy(lot, part, at)).cast("long")
    placed = cut.withColumn("slot", inner).join(offsets, (F.col("shard") == F.col(where)) & (F.col(piece) == F.col(rows_)))
    return placed.withColumn("slot", F.col(before) + F.col("slot") - 1).select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "slot")


def record_size(text_col: str = "text"):
    """UTF-8 bytes of the text and 16 for what frames it."""
    return F.octet_length(text_or_empty(text_col)).cast("long") + F.lit(16)
