"""Ranked lexical search: the best documents for each of a set of query texts, with exact whole scores.

LEMP: a document is the vector of its impacts, one coordinate for each query term that it holds.
Vectors are ordered by length and dealt in that order, so a batch of them is a bucket of similar
lengths. By Cauchy-Schwarz a bucket, and whole files by their statistics, fall away once a query's
length times the bucket's can't reach the score of the query's tenth best so far. Inside a bucket,
a coordinate's greatest impact bounds what the query's weaker terms can add, so only documents that
hold a stronger term are looked at, and only those whose partial sum with that bound reaches the
tenth best are scored in full, in whole numbers. Bounds are never below a score, so ties stay.

Queries are taken in blocks of bounded text, each against all documents. A null or empty text has no
term: as a document it is never found, as a query it finds nothing. Equal scores are ordered by id,
null last; repeated documents take a place each, repeated queries get a result each. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import keep, text_or_empty
from tabloom.operators.lanes import empty, local_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

BLOCK_BYTES = 4 << 20  # text of the queries that are searched together
HEAD = 0.99  # the longest vectors, from this quantile on, set the first thresholds
SLACK = 1 + 1e-9  # bounds are in doubles and must not fall below a score

# ASCII letters, lower-cased, and digits stay; other ASCII separates terms
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text, repeats included."""
    return (text or "").encode().translate(_TABLE).split()


def _term_counts(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Each document's number of terms, the query terms it holds, and how often it holds them."""
    seen = 0
    for batch in batches:
        sizes, held = [], []
        for text in batch.column(1):
            words = text.as_py().translate(_TABLE).split()
            sizes.append(len(words))
            held.append(np.array([n for n in map(numbers.get, words) if n is not None], np.int64))
        row = np.repeat(np.arange(len(held)), [len(h) for h in held])
        codes, counts = np.unique(row * len(numbers) + np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
        ends = np.searchsorted(codes, np.arange(len(held) + 1) * len(numbers))
        offsets = pa.array(ends.astype(np.int32))
        salt = (np.arange(seen, seen + len(held), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        seen += len(held)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(salt), pa.array(np.array(sizes, np.int64)),
            pa.ListArray.from_arrays(offsets, pa.array((codes % max(len(numbers), 1)).astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
        ], names=["id", "salt", "n", "terms", "tf"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and all values of a list column."""
    ends = column.offsets.to_numpy()
    return np.diff(ends), column.flatten().to_numpy(zero_copy_only=False)


def _impacts(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """Whole impacts of the terms of each document, and the length of that vector."""
    for batch in batches:
        sizes, terms = _flat(batch.column("terms"))
        _, tf = _flat(batch.column("tf"))
        n = batch.column("n").to_numpy()
        m = 10 + 90 * n * n_docs // n_terms
        tf = tf.astype(np.int64)
        impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes)))
        row = np.repeat(np.arange(len(sizes)), sizes)
        length = np.sqrt(np.bincount(row, weights=impact.astype(float) ** 2, minlength=len(sizes)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("salt"), pa.array(length),
            pa.ListArray.from_arrays(offsets, pa.array(terms)), pa.ListArray.from_arrays(offsets, pa.array(impact)),
        ], names=["id", "salt", "length", "terms", "impacts"])


def _best(scores: np.ndarray, ids: list[Any], k: int) -> tuple[np.ndarray, list[Any]]:
    """The ``k`` highest scores, equal ones by id, null last."""
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        among = np.arange(len(scores))
    order = sorted(among.tolist(), key=lambda i: (-scores[i], ids[i] is None, 0 if ids[i] is None else ids[i]))[:k]
    return scores[order], [ids[i] for i in order]


class Bucket:
    """Vectors of similar length as lists by coordinate."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        order = np.argsort(terms, kind="stable")
        self.n = len(sizes)
        self.rows, self.impacts = np.repeat(np.arange(self.n), sizes)[order], impacts[order]
        self.ends = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, terms, impacts)

    def search(self, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that score ``least`` or more (and above 0), with their exact scores."""
        query = query[np.argsort(self.most[query], kind="stable")]
        reach = np.cumsum(self.most[query])  # of the weaker coordinates up to each
        weak = int(np.searchsorted(reach, least, side="left")) if least > 0 else 0
        if weak == len(query):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums = np.zeros(self.n, np.int64)
        for term in query[weak:]:
            at = slice(self.ends[term], self.ends[term + 1])
            sums[self.rows[at]] += self.impacts[at]
        rest = int(reach[weak - 1]) if weak else 0
        rows = np.flatnonzero((sums > 0) & (sums + rest >= least))
        scores = sums[rows]
        for term in query[:weak]:
            at = slice(self.ends[term], self.ends[term + 1])
            spot = np.searchsorted(self.rows[at], rows)
            spot = np.minimum(spot, max(self.ends[term + 1] - self.ends[term] - 1, 0))
            if self.ends[term + 1] > self.ends[term]:
                scores += np.where(self.rows[at][spot] == rows, self.impacts[at][spot], 0)
        on = scores >= max(least, 1)
        return rows[on], scores[on]


def _search(
    batches: Iterator[pa.RecordBatch], queries: list[np.ndarray], start: np.ndarray, n_terms: int, k: int
) -> Iterator[pa.RecordBatch]:
    """The task's ``k`` best documents of each query, from vectors in falling order of length."""
    least = start.copy()
    held: list[tuple[np.ndarray, list[Any]]] = [(np.zeros(0, np.int64), [])] * len(queries)
    reach = np.sqrt([len(q) for q in queries])  # the queries' own lengths
    kind = None
    for batch in batches:
        kind = batch.schema.field("id").type
        if not batch.num_rows:
            continue
        longest = float(np.max(batch.column("length").to_numpy()))
        open_queries = np.flatnonzero(reach * longest * SLACK >= least)
        if not len(open_queries):
            continue
        sizes, terms = _flat(batch.column("terms"))
        bucket = Bucket(sizes, terms, _flat(batch.column("impacts"))[1], n_terms)
        ids = batch.column("id")
        for q in open_queries:
            rows, scores = bucket.search(queries[q], int(least[q]))
            if len(rows):
                old, old_ids = held[q]
                held[q] = _best(np.concatenate([old, scores]), old_ids + ids.take(pa.array(rows)).to_pylist(), k)
                if len(held[q][0]) == k:
                    least[q] = max(least[q], held[q][0][-1])
    if kind is not None:
        counts = [len(scores) for scores, _ in held]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(queries)), counts).astype(np.int32)),
            pa.array([i for _, ids in held for i in ids], kind),
            pa.array(np.concatenate([s for s, _ in held]).astype(np.int64)),
        ], names=["query", "id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """``text, rank, id, score`` for the queries of one block."""
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    queries = []
    for text in texts:
        wanted = sorted({numbers.setdefault(t, len(numbers)) for t in terms_of(text)})
        queries.append(np.array(wanted, np.int64))
    id_type = docs.schema["id"].dataType.simpleString()
    counted = keep(docs.mapInArrow(
        lambda it: _term_counts(it, numbers), f"id {id_type}, salt long, n long, terms array<int>, tf array<int>"), "terms")
    total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_words = total["docs"], max(total["terms"], 1)
    # one row for each term of the block
    df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(numbers))], np.int64)
    shape = f"id {id_type}, salt long, length double, terms array<int>, impacts array<bigint>"
    vectors = counted.where(F.size("terms") > 0).mapInArrow(lambda it: _impacts(it, weights, n_docs, n_words), shape)
    vectors = keep(vectors.where("length > 0").repartitionByRange(F.desc("length"), "salt").sortWithinPartitions(
        F.desc("length")).drop("salt"), "vectors")

    result = f"query int, id {id_type}, score long"
    start = np.zeros(len(queries), np.int64)

    def best_of(part: DataFrame, least: np.ndarray) -> DataFrame:
        return part.mapInArrow(lambda it: _search(it, queries, least, len(numbers), k), result)

    cut = vectors.agg(F.percentile_approx("length", HEAD, 1000).alias("cut")).first()["cut"]
    if cut is None:
        return empty(spark, f"text string, rank int, id {id_type}, score long")
    head = keep(_top(best_of(vectors.where(F.col("length") >= cut), start), k), "head")
    # one row for each query of the block
    for row in head.where(F.col("rank") == k).select("query", "score").collect():
        start[row["query"]] = row["score"]
    able = [least / (math.sqrt(len(q)) * SLACK) for q, least in zip(queries, start) if len(q)]
    rest = vectors.where((F.col("length") < cut) & (F.col("length") >= (min(able) / SLACK if able else cut)))
    found = _top(head.drop("rank").unionByName(best_of(rest, start)), k)
    names = local_table(spark, list(enumerate(texts)), "query int, text string")
    return found.join(F.broadcast(names), "query").select("text", "rank", "id", "score")  # a block's texts


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for each item.

    The columns keep the names given. Items with the same text are searched once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("body"))
    asked = items.select(F.col(item_id_col).alias("item"), text_or_empty(item_text_col).alias("text"))
    texts = asked.select("text").distinct()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    found = None
    for block in range(blocks):
        mine = [r["text"] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()]
        if not mine:
            continue
        one = _search_block(rows, sorted(mine), k)
        found = one if found is None else found.unionByName(one)
    if found is None:
        id_type = rows.schema["id"].dataType.simpleString()
        found = empty(spark, f"text string, rank int, id {id_type}, score long")
    return asked.join(found, "text").select(F.col("item").alias(item_id_col), "rank", F.col("id").alias(id_col), "score")
