"""Line deduplication: runs of lines that an earlier place has too are deleted.

The lines of all documents, each with its id, are sequences; a suffix begins at every line. The
suffixes are sorted by prefix doubling: a suffix's rank by its first ``2 k`` lines follows from its
rank by ``k`` lines and that of the suffix ``k`` lines on. Pairs of ranks are counted first, so a
frequent line is one row, sorted over the cluster, and numbered in order. A prefix that occurs once
drops out, as no longer one can repeat.

A run counts if it has ``least_words`` words. So for every suffix there is a least number of lines
``m`` that a run from there must share. The suffixes that share them are one interval of the suffix
array, of a longest common prefix of ``m`` lines or more; two ranks of ``k`` lines, one at either
end with ``k <= m < 2 k``, name it. All its suffixes but the first in order of documents and lines
begin a copy. What copies that overlap cover together is a maximal repeated run, and goes.

An interval of many places needs no long run to be boilerplate: a single line of ``line_words`` words
that stands in ``many`` places or more goes from all but the first, whatever stands around it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import fresh, keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

LEAST_WORDS = 50
LINE_WORDS, MANY = 8, 20  # of a line that goes by itself, and the places it must have
_LAST = 2**63 - 1  # where null ids go in order
_BATCH = 1 << 16
LINES = "ord long, text_hash long, spot long, line long, id1 long, id2 long, need long, words long"
PLACE = ["ord", "text_hash", "spot"]


def _lines_of(text: bytes, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: its number, its 128-bit id, the lines a run from there needs, 0 if it can't have enough, and its words."""
    lines = text.split(b"\n")
    counts = [len(line.split()) for line in lines]  # bytes: the six ASCII blanks
    numbers = np.flatnonzero(counts)
    digests = b"".join(xxhash.xxh3_128_digest(lines[i]) for i in numbers)
    upto = np.cumsum(np.array(counts, np.int64)[numbers])
    before = upto - np.array(counts, np.int64)[numbers]
    ends = np.searchsorted(upto, before + least_words)
    need = np.where(ends < numbers.size, ends - np.arange(numbers.size) + 1, 0)
    return numbers, np.frombuffer(digests, np.int64).reshape(-1, 2), need, upto - before


def _split(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in LINES.split(", ")]
    for batch in batches:
        for at in range(batch.num_rows):
            order, text_hash, text = (column[at].as_py() for column in batch.columns)
            numbers, ids, need, words = _lines_of(text or b"", least_words)
            for a in range(0, numbers.size, _BATCH):
                cut = slice(a, a + _BATCH)
                n = numbers[cut].size
                columns = [np.full(n, order), np.full(n, text_hash), np.arange(a, a + n), numbers[cut], ids[cut, 0], ids[cut, 1], need[cut], words[cut]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in columns], names=names)


def _merged(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches: one of each document would cost more to send than to make."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _growing(df: DataFrame) -> DataFrame:
    """Either side of these joins grows with the corpus: merged at every size, never broadcast."""
    return df.hint("merge")


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))


def _position() -> Column:
    return F.xxhash64(*PLACE).alias("p")


def _names(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A rank for each value of ``keys`` that stands in two places or more, in the order of the keys."""
    seen = pairs.groupBy(*keys).agg(F.min("p").alias("least"), F.max("p").alias("most")).where("least < most")
    return keep(seen.select(*keys).orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, line_words: int = LINE_WORDS, many: int = MANY,
) -> DataFrame:
    """``ord, text_hash, spot, line`` of each line to delete, ``spot`` counting lines that have a word."""
    rows = docs.select(_key(id_col).alias("ord"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    lines = keep(rows.mapInArrow(lambda it: _merged(_split(it, least_words)), LINES), "lines")
    first = _names(lines.select("id1", "id2", _position()), ["id1", "id2"])
    # lines that stand in one place only are not needed; rows equal in id and text are one document
    state = lines.join(_growing(first), ["id1", "id2"]).select(*PLACE, "line", "need", "rank", "words").distinct()
    state = keep(state, "level")
    frequent = state.where(F.col("words") >= line_words).groupBy("rank").agg(F.count("*").alias("places")).where(F.col("places") >= many)
    single = state.where(F.col("words") >= line_words).join(_growing(frequent), "rank").select(
        *PLACE, F.lit(0).cast("long").alias("need"), "rank", F.col("rank").alias("last"))  # a line by itself
    state = state.drop("words")
    doc = Window.partitionBy("ord", "text_hash").orderBy("spot")
    span, found = 1, [single]
    while True:
        # suffixes whose least run is named by two ranks of this length, at its two ends
        due = state.where((F.col("need") >= span) & (F.col("need") < 2 * span) & F.col("rank").isNotNull())
        ends = state.select("ord", "text_hash", F.col("spot").alias("end_spot"), F.col("rank").alias("last"))
        due = due.withColumn("end_spot", F.col("spot") + F.col("need") - span)
        found.append(due.join(_growing(ends.where("last is not null")), ["ord", "text_hash", "end_spot"]).select(*PLACE, "need", "rank", "last"))
        if state.where((F.col("need") >= 2 * span) & F.col("rank").isNotNull()).isEmpty():
            break
        ahead = F.lead(F.struct("spot", "rank"), span).over(doc)
        paired = state.withColumn("ahead", ahead).withColumn(
            "second", F.when(F.col("ahead.spot") == F.col("spot") + span, F.col("ahead.rank"))
        ).drop("ahead").withColumnRenamed("rank", "first")
        both = paired.where("first is not null and second is not null").select("first", "second", _position())
        ranks = _names(both, ["first", "second"])
        state = keep(paired.join(_growing(ranks), ["first", "second"], "left").select(*PLACE, "line", "need", "rank"), "level")
        span *= 2
    members = found[0]
    for more in found[1:]:
        members = members.union(more)
    members = keep(members, "intervals")
    interval = ["need", "rank", "last"]
    heads = members.groupBy(*interval).agg(F.min(F.struct(*PLACE)).alias("head")).select("need", "head.*")
    # by place, so a run that a third of all documents share is no hot key here; a place begins one run at most, and is one line
    copies = members.join(_growing(heads), [*PLACE, "need"], "left_anti")
    length = F.greatest(F.col("need"), F.lit(1))
    covered = copies.select("ord", "text_hash", F.explode(F.sequence(F.col("spot"), F.col("spot") + length - 1)).alias("spot")).distinct()
    return covered.join(_growing(lines.select(*PLACE, "line").distinct()), PLACE)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are the text and the numbers of its lines to delete."""
    for batch in batches:
        texts, removed = [], []
        for text, gone in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
            value, drop = text.as_py(), set(gone.as_py() or ())
            removed.append(len(drop))
            texts.append("\n".join(x for i, x in enumerate(value.split("\n")) if i not in drop) if drop else value)
        columns = [*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_removed"])


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, line_words: int = LINE_WORDS, many: int = MANY,
) -> DataFrame:
    """The rows of ``docs`` with copies of earlier lines deleted from the text, and ``n_removed``.

    An input column ``n_removed`` is replaced; the others stay, the text last. Order is by id, null
    ids last, and then by line. Lines without a word are neither compared nor deleted. A run that
    repeats inside one text loses its later copies too. Null texts stay null. Rows equal in id and
    text are one document and get the same result; rows of one id and different texts are ordered
    by a hash. An empty table gives an empty result.
    """
    docs = docs.drop("n_removed")
    order, text_hash, lines, body = fresh(docs, "order", "text_hash", "lines", "body")
    gone = repeated_runs(docs, id_col, text_col, least_words, line_words, many).groupBy("ord", "text_hash").agg(F.collect_list("line").alias("lines"))
    gone = keep(gone, "deleted").toDF(order, text_hash, lines)
    on = (_key(id_col) == F.col(order)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(text_hash))
    others = [c for c in docs.columns if c != text_col]
    joined = docs.join(_growing(gone), on, "left").select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").cast("string").alias(text_col), lines)
    schema = joined.schema[:-1].add("n_removed", "long")
    return joined.mapInArrow(_apply, schema)
