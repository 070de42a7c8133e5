"""SimHash near-duplicates through an inverted index of byte positions.

A fingerprint has eight bytes. Two that differ in three bits or fewer share at least five bytes in
place. Lists of a single byte in place hold a 256th of all fingerprints each and their pairs grow
with the square of the table; so a list here is keyed by three bytes in place at once, the
intersection of three such lists. Halve the positions: of five shared ones, three lie in one half,
so the eight triples within the halves miss no pair. Inside a list the shared positional bytes of
a pair are tallied, pairs with fewer than five are dropped, and the rest verified by their bits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import fresh, keep
from tabloom.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

BYTES = 8
TRIPLES = (*combinations(range(4), 3), *combinations(range(4, 8), 3))
BLOCK = 2048  # fingerprints of a list that meet in one task, about; longer lists go by pairs of blocks
FEW = 16
CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: each is set if set in over half the hashes of the text's shingles, repeats counted."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : at + CHUNK], ends[at : at + CHUNK])
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(text.as_py(), shingle, seed) for text in batch.column(1)]
        values = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), values, batch.column(2)], names=["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``doc_id``, ``fp`` and ``text_hash``, which tells rows with the same or no id apart."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_hash")
    )
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle, seed), "doc_id long, fp long, text_hash long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs are linked: shared positional bytes tallied first, differing bits after."""
    differing = x ^ y
    shared = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    enough = np.flatnonzero(shared >= BYTES - bits)
    return enough[np.bitwise_count(differing[enough]) <= bits]


def _forest(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links among ``x`` connect, and at most one less than ``x`` has.

    Each fingerprint in turn looks at those not reached yet, so what one copy reaches need not
    be compared with the other copies.
    """
    left, heads, tails = x, [], []
    while left.size:
        frontier, left = [left[0]], left[1:]
        while frontier and left.size:
            head = frontier.pop()
            near = _near(left, np.full_like(left, head), bits)
            hit = left[near]
            heads.append(np.full_like(hit, head))
            tails.append(hit)
            frontier.extend(hit)
            left = np.delete(left, near)
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(heads or empty), np.concatenate(tails or empty)


def _links_of(group: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside sorted groups: small ones all at once by offset, larger ones by themselves."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, group.size])
    heads, tails = [], []
    small = np.repeat(size <= FEW, size)
    g, x = group[small], fp[small]
    for step in range(1, FEW):
        same = np.flatnonzero(g[step:] == g[:-step])
        if not same.size:
            break
        near = same[_near(x[same], x[same + step], bits)]
        heads.append(x[near])
        tails.append(x[near + step])
    for at, n in zip(first[size > FEW], size[size > FEW]):
        a, b = _forest(fp[at : at + n], bits)
        heads.append(a)
        tails.append(b)
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(heads or empty), np.concatenate(tails or empty)


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by list and pair of blocks; a group left open waits for the next batch."""
    rest = np.zeros((4, 0), np.int64)
    end = False
    while not end:
        batch = next(batches, None)
        end = batch is None
        rows = rest if end else np.concatenate([rest, np.array([c.to_numpy() for c in batch.columns])], axis=1)
        if not rows.shape[1]:
            continue
        new = np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]
        cut = rows.shape[1] if end else int(np.flatnonzero(new)[-1])
        rest = rows[:, cut:]
        if cut:
            a, b = _links_of(np.cumsum(new[:cut]), np.ascontiguousarray(rows[3, :cut]).view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(distinct: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints ``fp`` that connect whatever is connected.

    ``bits`` may be 3 at most: the triples are a full cover only for five shared bytes.
    """
    if not 0 <= bits <= BYTES - 5:
        raise ValueError("the index of byte triples covers up to 3 differing bits")
    fp = F.col("fp")
    keys = [
        F.lit(i << 24).cast("long").bitwiseOR(F.shiftleft(_byte(fp, a), 16)).bitwiseOR(F.shiftleft(_byte(fp, b), 8)).bitwiseOR(_byte(fp, c))
        for i, (a, b, c) in enumerate(TRIPLES)
    ]
    postings = distinct.select(F.explode(F.array(*keys)).alias("list"), "fp")
    shared = postings.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("long")
    own = postings.join(shared, "list").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), blocks))
    placed = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(
        "list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )
    grouped = placed.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "fp")
    return grouped.mapInArrow(lambda it: _links(it, bits), "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, seed: int, block: int) -> DataFrame:
    """The fingerprints with their component: its root and its smallest id."""
    rows = keep(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = keep(components(links(nodes.select("fp"), bits, block)), "roots").withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(of_root, "root").select("fp", "root", "component_id"), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp`` and ``component_id``, the smallest id reachable.

    Equal fingerprints are one node from the start, so exact copies cost one row each. Null texts
    and texts without a word have the fingerprint zero and are linked like any other. Rows with a
    null id keep it; a component of null ids only has a null id. Other columns don't matter; an
    empty table gives an empty result. The texts are read once and never shuffled.
    """
    return _grouped(docs, id_col, text_col, shingle, bits, seed, block).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, one for each group of near-duplicates.

    The row with the smallest id stays, null ids last; of several with that id, one stays. Rows
    of the same id and text are compared by all columns, which must have an order.
    """
    groups = _grouped(docs, id_col, text_col, shingle, bits, 42, BLOCK)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = groups.groupBy("root").agg(F.min(order).alias("first"))
    per_row = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    chosen = keep(
        first.select("first.doc_id", "first.text_hash").join(
            per_row.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "n"),
            (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id")),
        ).select("id", "h", "n"), "chosen"
    )
    wanted, text_hash, n = fresh(docs, "wanted", "text_hash", "n")
    kept = docs.join(
        chosen.toDF(wanted, text_hash, n),
        (F.xxhash64(F.col(f"`{text_col}`")) == F.col(text_hash)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(wanted)),
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.where(F.col(n) == 1).select(row.alias("row"))
    repeated = kept.where(F.col(n) > 1).groupBy(wanted, text_hash).agg(F.min(row).alias("row")).select("row")
    return once.union(repeated).select("row.*")
