"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document that contains four fifths or more of its distinct five-word shingles.

Shingles of a document that no item has can't be shared with one, so a document's set is cut down
to the items' vocabulary first; that changes no shared count and leaves clean documents empty. The
sets are partitioned by size in powers of two. A set of at most ``u`` shingles that contains a share
``c`` of an item of ``q`` has a Jaccard similarity of at least ``c q / (q + u - c q)``; from that each
pair of a partition and an item size gets the most selective banding of its 64 minima that misses
such a pair with a probability under ``MISS``. Where sets are so large that no banding can promise
that, the item's postings are looked up instead: if four fifths of its shingles are there, so is one
of any ``q - ceil(c q) + 1`` of them, which misses nothing. Candidates are verified by exact counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fresh, keep, text_or_empty

WORDS = 5
CONTAINMENT = 0.8
HASHES = 64
MISS = 1e-6
BANDINGS = (8, 4, 2, 1)  # rows of a band, most selective first
LARGEST = 40  # sizes are below two to this power
SMALL_VOCABULARY = 1_000_000  # shingles, of eight bytes, that may be broadcast


def shingles(text: Column) -> Column:
    """Distinct hashes of the runs of five words; words are runs of letters and digits, lower-cased."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    several = lambda x: F.transform(
        F.slice(x, F.lit(1), F.greatest(F.size(x) - (WORDS - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(x, i + k) for k in range(1, WORDS)]),
    )
    # bound to a name, so that the words are made once
    return F.get(F.transform(F.array(words), lambda x: F.array_distinct(several(x))), F.lit(0))


def least_jaccard(item: int, largest: int, containment: float = CONTAINMENT) -> float:
    """Of an item of that many shingles with a set of at most ``largest`` that contains it."""
    shared = math.ceil(containment * item)
    return shared / (item + max(largest, shared) - shared)


def banding(item: int, largest: int, containment: float = CONTAINMENT) -> int | None:
    """Rows of a band that keep the chance of a miss under ``MISS``; None if no banding does."""
    t = least_jaccard(item, largest, containment)
    return next((r for r in BANDINGS if (1 - t**r) ** (HASHES // r) <= MISS), None)


def _bandings(containment: float) -> Column:
    """Rows of a band for ``q`` and the upper size ``u`` as an expression, 0 for the postings."""
    q, u = F.col("q").cast("double"), F.col("u").cast("double")
    shared = F.ceil(F.lit(containment) * q)
    t = shared / (q + F.greatest(u, shared) - shared)
    found = F.lit(0)
    for r in reversed(BANDINGS):
        found = F.when(F.pow(1 - F.pow(t, F.lit(float(r))), F.lit(float(HASHES // r))) <= MISS, F.lit(r)).otherwise(found)
    return found


def _signature(shingle_set: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.lit(HASHES)), lambda j: F.array_min(F.transform(shingle_set, lambda h: F.xxhash64(h, j)))
    )


def _bands(r: Column) -> Column:
    """Numbered hashes of the bands of ``r`` minima that ``signature`` has."""
    band = lambda b: F.xxhash64(F.slice("signature", b * r + 1, r))
    numbers = F.sequence(F.lit(0), (F.lit(HASHES) / r).cast("int") - 1)
    return F.transform(numbers, lambda b: F.struct(b.alias("band"), band(b).alias("value")))


def _power(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double"))).cast("int")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment`` for each item found in a document.

    Null or short texts, of fewer than five words, have no shingles: such documents contain nothing
    and such items are never found. Rows that repeat an id and a text are one document or item;
    rows of one id and different texts are judged each on its own, and the pair is reported once
    with its largest count. Null ids are reported as null. Other columns don't matter; if either
    table is empty, so is the result.
    """
    sets = items.select(F.col(item_col).alias("item_id"), F.xxhash64(item_text).alias("item_hash"), shingles(text_or_empty(item_text)).alias("item_set"))
    sets = sets.where(F.size("item_set") > 0).distinct()
    sets = keep(sets.withColumn("q", F.size("item_set")).withColumn("item", F.xxhash64("item_id", "item_hash")), "items")
    vocabulary = keep(sets.select(F.explode("item_set").alias("word")).distinct(), "vocabulary")
    if vocabulary.limit(SMALL_VOCABULARY + 1).count() <= SMALL_VOCABULARY:
        vocabulary = F.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), shingles(text_or_empty(text_col)).alias("set"))
    hits = rows.select("doc_id", "text_hash", F.explode("set").alias("word")).join(vocabulary, "word", "left_semi")
    found = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("word").alias("set"))
    found = keep(found.withColumn("doc", F.xxhash64("doc_id", "text_hash")).withColumn("x", F.size("set")), "found")

    # an item goes into the partitions whose sets are large enough to contain it
    power = F.explode(F.sequence(F.greatest(_power(F.ceil(F.lit(containment) * F.col("q"))), F.lit(0)), F.lit(LARGEST)))
    placed = sets.withColumn("power", power).withColumn("u", F.pow(F.lit(2.0), F.col("power") + 1) - 1).withColumn("r", _bandings(containment))
    used = found.select(_power(F.col("x")).alias("power")).distinct()
    placed = keep(placed.join(F.broadcast(used), "power").withColumn("signature", _signature(F.col("item_set"))), "placed")

    bands_of_items = placed.where("r > 0").select("item", "power", "r", F.explode(_bands(F.col("r"))).alias("b")).select("item", "power", "r", "b.*")
    signed = found.withColumn("power", _power(F.col("x"))).withColumn("signature", _signature(F.col("set")))
    wanted = placed.where("r > 0").select("power", "r").distinct()
    bands_of_docs = signed.join(F.broadcast(wanted), "power").select("doc", "power", "r", F.explode(_bands(F.col("r"))).alias("b")).select("doc", "power", "r", "b.*")
    by_bands = bands_of_docs.join(bands_of_items, ["power", "r", "band", "value"]).select("doc", "item")

    some = F.slice(F.array_sort("item_set"), F.lit(1), (F.col("q") - F.ceil(F.lit(containment) * F.col("q")) + 1).cast("int"))
    looked_up = placed.where("r = 0").select("item", "power", F.explode(some).alias("word"))
    large = signed.select("doc", "power", F.explode("set").alias("word"))
    by_postings = large.join(looked_up, ["power", "word"]).select("doc", "item")

    pairs = by_bands.union(by_postings).distinct()
    counted = (
        pairs.join(found.select("doc", "doc_id", "set"), "doc")
        .join(sets.select("item", "item_id", "q", "item_set"), "item")
        .withColumn("n_shared", F.size(F.array_intersect("item_set", "set")))
        .where(F.col("n_shared") >= F.ceil(F.lit(containment) * F.col("q")))
    )
    best = counted.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("q")).alias("containment"), "n_shared", "q")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_shared").cast("long").alias("n_shared"), F.col("best.q").cast("long").alias("n_shingles"), "best.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no item is found."""
    own, body = fresh(docs, "own", "body")
    found = contained(
        docs.select(F.xxhash64(f"`{text_col}`").alias(own), F.col(f"`{text_col}`").alias(body)), items, own, body, item_col, item_text
    )
    bad = keep(found.select(F.col("doc_id").alias(own)).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(F.col(f"`{text_col}`")) == F.col(own), "left_anti")
