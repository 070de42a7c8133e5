"""Phrases whose words stand together more often than apart, mined shard by shard.

SON partitioning: texts are dealt to a few shards. A phrase with ``support`` occurrences in a
language has, in one shard at least, its share of them, so mining every shard completely at that
lower support misses none. The phrases found in any shard are the candidates; a last pass counts
them over all texts. Inside a shard a phrase is tried only if its shorter parts were found, which a
set of bits of fixed size remembers: it may say yes too often, never no, so it costs exactness
nothing and memory doesn't grow with the corpus.

Counts travel as blocks: a lot's counts of one bucket of hashes are one row, packed as sorted
differences. Buckets are as many as the corpus has millions of words, so a block stays small, and a
task that merges a bucket holds about as much whatever the corpus.

Null texts are empty, a null language is ``und``, texts without words give nothing, repeated rows
count as often as they stand there, equal scores are ordered by count and phrase, and an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import keep, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

# fixed values: what ends a piece of text, what separates words, the language of rows without one
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
UNKNOWN = "und"

SHARDS = 8
CHUNK_WORDS = 1 << 22  # words held by a task before it sends its counts
TEXT_BYTES = 1 << 20  # texts are cut into words together up to this size
BITS = 27  # the set of candidates has 2^BITS bits, 16 MB
SLICE = 1 << 18  # hashes looked up at once
KEY = 40  # leading bits of a hash that are counted; where two phrases share them both may seem frequent
PROBES = (24, 31, 37)  # each candidate sets one bit for each: its hash, shifted right; all within its key
BUCKET_WORDS = 1 << 20  # words of the corpus for each bucket, about
SALTS = 64  # parts in which the best of a language are found first
BREAK = b"\xff"  # in no UTF-8 text

_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
for _c in ENDS:
    _TABLE[_c] = BREAK[0]
for _c in GAPS:
    _TABLE[_c] = 32
_TABLE = bytes(_TABLE)


class _Ids(dict):
    """Numbers words as they come; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mix(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its beginning and of its next word."""
    h = h ^ more
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set."""
    found = np.ones(len(h), bool)
    for begin in range(0, len(h), SLICE):
        some = slice(begin, begin + SLICE)
        for shift in PROBES:
            at = (h[some] >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)
            found[some] &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


class _Lot:
    """The distinct words that a task holds, with what is worked out for them once."""

    def __init__(self, words: list[bytes], bits: np.ndarray | None) -> None:
        self.words, self.bits, self._frequent = words, bits, {}
        self.own = _hashes(words) if bits is not None else None

    def start(self, lang: str) -> np.ndarray:
        return _mix(np.zeros(1, np.uint64), _hashes([lang.encode()]))

    def frequent(self, lang: str) -> np.ndarray:
        """Which words may be frequent in a language."""
        if lang not in self._frequent:
            self._frequent[lang] = _holds(self.bits, _mix(self.start(lang), self.own))
            self._frequent[lang][0] = False
        return self._frequent[lang]


Groups = dict[tuple[str, int], np.ndarray]
Counter = Callable[[_Lot, Groups], Iterator[pa.RecordBatch]]


def _mined(batches: Iterator[pa.RecordBatch], count: Counter, bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """What ``count`` makes of the numbered words of each language and shard, a bounded lot at a time."""
    held: dict[tuple[str, int], list[np.ndarray]] = {}
    ids, size = _Ids(), 0

    def flush() -> Iterator[pa.RecordBatch]:
        groups = {group: np.concatenate(held.pop(group)) for group in list(held)}
        yield from count(_Lot(list(ids), bits), groups)

    for batch in batches:
        waiting: dict[tuple[str, int], list[bytes]] = {}
        weight = 0

        def number() -> int:
            read = 0
            for group, texts in waiting.items():
                body = BREAK.join([*texts, b""]).translate(_TABLE).replace(BREAK, b" \xff ")
                words = body.split()
                held.setdefault(group, []).append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                read += len(words)
            waiting.clear()
            return read

        langs, shards = batch.column("lang").to_pylist(), batch.column("shard").to_pylist()
        for lang, shard, text in zip(langs, shards, batch.column("text")):
            body = text.as_py()
            waiting.setdefault((lang, shard), []).append(body)
            weight += len(body)
            if weight >= TEXT_BYTES:
                size, weight = size + number(), 0
                if size >= CHUNK_WORDS:
                    yield from flush()
                    held.clear()
                    ids, size = _Ids(), 0
        size += number()
    if held:
        yield from flush()


def _count_words(lot: _Lot, groups: Groups) -> Iterator[pa.RecordBatch]:
    """Words with their counts in each language, and a row without word for the size of each shard."""

    def rows(lang, shard, names, counts):
        n = len(counts)
        return pa.RecordBatch.from_arrays([
            _repeated(lang, n), pa.array(np.full(n, shard, np.int32)), pa.array(names, pa.string()), pa.array(counts.astype(np.int64)),
        ], names=["lang", "shard", "phrase", "n"])

    by_lang: dict[str, list[np.ndarray]] = {}
    for (lang, shard), ids in groups.items():
        by_lang.setdefault(lang, []).append(ids)
        yield rows(lang, shard, [None], np.array([np.count_nonzero(ids)]))
    for lang, parts in by_lang.items():
        counts = np.bincount(np.concatenate(parts), minlength=1)
        counts[0] = 0
        seen = np.flatnonzero(counts)
        yield rows(lang, -1, [lot.words[i].decode() for i in seen.tolist()], counts[seen])


def _repeated(text: str, n: int) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([text])).cast(pa.string())


def _pairs(lot: _Lot, lang: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where two frequent words follow each other, and the hashes of those pairs."""
    frequent = lot.frequent(lang)[ids]
    at = np.flatnonzero(frequent[:-1] & frequent[1:])
    return at, _mix(_mix(lot.start(lang), lot.own[ids[at]]), lot.own[ids[at + 1]])


def _longer(ids: np.ndarray, own: np.ndarray, at: np.ndarray, h: np.ndarray, known: np.ndarray, longest: int):
    """For 3 words and more: places where each two neighbours are a known pair, and the phrases' hashes.

    ``at`` are places of pairs in ascending order, ``h`` their hashes, ``known`` says which are known.
    """
    is_pair = np.zeros(len(ids) + 1, bool)
    is_pair[at[known]] = True
    at, h = at[known], h[known]
    for size in range(3, longest + 1):
        on = is_pair[at + size - 2]
        at, h = at[on], h[on]
        h = _mix(h, own[ids[at + size - 1]])
        yield size, at, h


def _buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, else as they come, and each bucket met with where it begins and ends."""
    bucket = (keys * np.uint64(buckets)) >> np.uint64(KEY)
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
    starts = [0, *ends[:-1].tolist()]
    return order, [(b, x, y) for b, (x, y) in enumerate(zip(starts, ends.tolist())) if y > x]


def _pack(code: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending numbers as differences, and counts, each byte's place by itself."""
    step = code.copy()
    step[1:] -= code[:-1]
    planes = [a.view(np.uint8).reshape(len(a), -1).T.ravel() for a in (step, n.astype(np.uint32))]
    return pa.Codec("zstd", 1).compress(np.concatenate(planes).tobytes(), asbytes=True)


def _unpack(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 12 * size, asbytes=True), np.uint8)
    step = np.ascontiguousarray(planes[: 8 * size].reshape(8, size).T).view(np.uint64)[:, 0]
    return np.cumsum(step, dtype=np.uint64), np.ascontiguousarray(planes[8 * size :].reshape(4, size).T).view(np.uint32)[:, 0]


def _local_counts(hashes: dict[tuple[str, int], np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the counts of each language and shard, one for each bucket."""
    names, parts = list(hashes), [np.unique(h >> np.uint64(64 - KEY), return_counts=True) for h in hashes.values()]
    key, n = (np.concatenate([part[i] for part in parts]) for i in range(2))
    order, spans = _buckets(key, buckets)
    group = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(keys) for keys, _ in parts])[order]
    key, n, rows = key[order], n[order], []
    for bucket, a, b in spans:
        met, own = np.unique(group[a:b], return_inverse=True)
        some = [names[i] for i in met.tolist()]
        data = _pack(own.astype(np.uint64) << np.uint64(KEY) | key[a:b], n[a:b])
        rows.append((bucket, [lang for lang, _ in some], [shard for _, shard in some], b - a, data))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), BLOCK)], schema=BLOCK)


BLOCK = pa.schema([
    ("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("shards", pa.list_(pa.int32())), ("size", pa.int32()), ("data", pa.binary())])
BLOCK_COLUMNS = "bucket int, langs array<string>, shards array<int>, size int, data binary"
MERGED = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("shards", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
MERGED_COLUMNS = "lang string, h long, shards array<int>, counts array<long>"


def _merge(table: pa.Table, support: int) -> pa.Table:
    """Of a bucket: the hashes with ``support`` occurrences, and their counts in each shard."""
    langs: dict[str, int] = {}
    codes, shards, counts = [], [], []
    for row in table.select(BLOCK.names[1:]).to_pylist():
        code, n = _unpack(row["data"], row["size"])
        group = (code >> np.uint64(KEY)).astype(np.int64)
        lang = np.array([langs.setdefault(x, len(langs)) for x in row["langs"]], np.uint64)
        codes.append(lang[group] << np.uint64(KEY) | code & np.uint64((1 << KEY) - 1))
        shards.append(np.array(row["shards"], np.int32)[group])
        counts.append(n)
    code, shard, n = np.concatenate(codes), np.concatenate(shards), np.concatenate(counts).astype(np.int64)
    order = np.argsort(code, kind="stable")
    code, shard, n = code[order], shard[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    many = np.repeat(np.add.reduceat(n, first) >= support, np.diff(np.append(first, len(code))))
    code, shard, n = code[many], shard[many], n[many]
    if not len(code):
        return MERGED.empty_table()
    order = np.lexsort((shard, code))
    code, shard, n = code[order], shard[order], n[order]
    each = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])]))
    code, shard, n = code[each], shard[each], np.add.reduceat(n, each)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    offsets = pa.array(np.append(first, len(code)).astype(np.int32))
    names = pa.array(list(langs)).take(pa.array((code[first] >> np.uint64(KEY)).astype(np.int64)))
    h = (code[first] << np.uint64(64 - KEY)).view(np.int64)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in (shard, n)]
    return pa.Table.from_arrays([names, pa.array(h), *lists], schema=MERGED)


def _mine_pairs(lot: _Lot, groups: Groups, buckets: int) -> Iterator[pa.RecordBatch]:
    yield from _local_counts({group: _pairs(lot, group[0], ids)[1] for group, ids in groups.items()}, buckets)


def _mine_longer(lot: _Lot, groups: Groups, longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    found = {}
    for (lang, shard), ids in groups.items():
        at, h = _pairs(lot, lang, ids)
        sizes = [hashes for _, _, hashes in _longer(ids, lot.own, at, h, _holds(lot.bits, h), longest)]
        found[lang, shard] = np.concatenate([h[:0], *sizes])
    yield from _local_counts(found, buckets)


def _count_exactly(lot: _Lot, groups: Groups, longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Candidates as text with their counts, in blocks; the numbers of their words, not hashes, tell them apart."""
    words = lot.words
    by_lang: dict[str, list[np.ndarray]] = {}
    for (lang, _), ids in groups.items():  # shards don't matter any more; each group ends with the end of a piece
        by_lang.setdefault(lang, []).append(ids)

    def rows(lang, ids, at, keys, hashes, size):
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        order, spans = _buckets(hashes[first] >> np.uint64(64 - KEY), buckets)
        lots = ids[at[first[order]][:, None] + np.arange(size)]
        phrases, counts = [b" ".join([words[i] for i in lot]) for lot in lots.tolist()], counts[order].astype(np.int32)
        n = len(spans)
        texts = [b"\n".join(phrases[a:b]) for _, a, b in spans]  # no word has a line end
        return pa.RecordBatch.from_arrays([
            pa.array([b for b, _, _ in spans], pa.int32()), _repeated(lang, n), pa.array(np.full(n, size, np.int32)),
            pa.array(texts, pa.binary()), pa.array([counts[a:b].tobytes() for _, a, b in spans], pa.binary()),
        ], names=["bucket", "lang", "size", "phrases", "counts"])

    for lang, parts in by_lang.items():
        ids = np.concatenate(parts).astype(np.int64)  # products of them pass 32 bits
        at, h = _pairs(lot, lang, ids)
        known = _holds(lot.bits, h)
        distinct, code = np.unique(ids[at[known]] * len(words) + ids[at[known] + 1], return_inverse=True)
        key = np.zeros(len(ids) + 1, np.int64)  # of the phrase that begins in each place
        key[at[known]] = code
        yield rows(lang, ids, at[known], code, h[known], 2)
        for size, places, hashes in _longer(ids, lot.own, at, h, known, longest):
            # a phrase is its first words and its last two; all first words are still numbered in key
            longer = key[places] * np.int64(len(distinct) + 1) + _code_of(distinct, ids, places + size - 2, len(words))
            _, code = np.unique(longer, return_inverse=True)
            key[places] = code
            on = _holds(lot.bits, hashes)
            yield rows(lang, ids, places[on], code[on], hashes[on], size)


def _merge_exactly(table: pa.Table, support: int) -> pa.Table:
    """Of a bucket: the phrases with ``support`` occurrences."""
    parts = []
    for row in table.select(["lang", "size", "phrases", "counts"]).to_pylist():
        phrases = row["phrases"].split(b"\n")
        parts.append(pa.Table.from_arrays([
            _repeated(row["lang"], len(phrases)), pa.array(np.full(len(phrases), row["size"], np.int32)),
            pa.array(phrases, pa.binary()), pa.array(np.frombuffer(row["counts"], np.int32).astype(np.int64)),
        ], names=["lang", "size", "phrase", "f"]))
    sums = pa.concat_tables(parts).group_by(["lang", "size", "phrase"]).aggregate([("f", "sum")])
    sums = sums.filter(pc.greater_equal(sums["f_sum"], support))
    return pa.table({"lang": sums["lang"], "size": sums["size"], "phrase": sums["phrase"].cast(pa.string()), "f": sums["f_sum"]})


def _code_of(distinct: np.ndarray, ids: np.ndarray, at: np.ndarray, n_words: int) -> np.ndarray:
    return np.searchsorted(distinct, ids[at] * n_words + ids[at + 1])


def _add_bits(found: DataFrame, bits: np.ndarray) -> None:
    """Set the bits of ``found (h)``. The driver gets at most 2^(BITS - 6) rows, whatever the corpus."""
    places = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND((1 << BITS) - 1) for s in PROBES]))
    words = found.select(places.alias("at")).select(
        F.expr("cast(shiftrightunsigned(at, 6) AS int) AS word"), F.expr("shiftleft(1L, cast(at & 63 AS int)) AS bit"))
    merged = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[merged["word"].to_numpy()] |= merged["bits"].to_numpy().view(np.uint64)


def _union(local: DataFrame, lower: DataFrame, support: int) -> DataFrame:
    """Hashes of the phrases that are frequent in some shard.

    All counts of a hash meet in one task, so their sum over the shards is there too. It is never
    below the phrase's own count, and phrases that it rules out needn't be counted again.
    """
    sums = local.groupBy("bucket").applyInArrow(lambda table: _merge(table, support), MERGED_COLUMNS)
    least = lower.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("shard", "least"))).alias("least"))
    counts = F.arrays_zip("shards", "counts")
    frequent = F.exists(counts, lambda x: x["counts"] >= F.try_element_at("least", x["shards"]))
    return sums.join(least, "lang").where(frequent).select("h")


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = _hashes([w.as_py().encode() for w in batch.column(1)])
        start = _mix(np.zeros(len(own), np.uint64), _hashes([w.as_py().encode() for w in batch.column(0)]))
        yield pa.RecordBatch.from_arrays([pa.array(_mix(start, own).view(np.int64))], names=["h"])


def phrase_counts(
    docs: DataFrame, support: int, longest: int, shards: int, text_col: str, lang_col: str
) -> tuple[DataFrame, DataFrame]:
    """``(lang, size, phrase, f)`` of all phrases of one to ``longest`` words with ``support``, and ``(lang, n)``."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.pmod(F.xxhash64(text_or_empty(text_col)), F.lit(shards)).cast("int").alias("shard"),
        text_or_empty(text_col).cast("binary").alias("text"))
    words = rows.mapInArrow(lambda it: _mined(it, _count_words), "lang string, shard int, phrase string, n long")
    words = keep(words.groupBy("lang", "shard", "phrase").agg(F.sum("n").alias("n")), "words")
    sizes = keep(words.where("phrase IS NULL").groupBy("lang", "shard").agg(F.sum("n").alias("part")), "shards")
    totals = sizes.groupBy("lang").agg(F.sum("part").alias("n"))
    # the least whole number that is not below the shard's share of the support
    share = f"({support}BD * cast(part AS decimal(19,0)) + cast(n AS decimal(19,0)) - 1BD) div cast(n AS decimal(19,0))"
    lower = sizes.where("part > 0").join(totals, "lang").select("lang", "shard", F.expr(share).alias("least"))
    frequent = words.where("phrase IS NOT NULL").where(F.col("n") >= support).select(
        "lang", F.lit(1).alias("size"), "phrase", F.col("n").alias("f"))

    buckets = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS))
    bits = np.zeros(1 << BITS - 6, np.uint64)
    _add_bits(frequent.select("lang", "phrase").mapInArrow(_word_hashes, "h long"), bits)
    for mine in (partial(_mine_pairs, buckets=buckets), partial(_mine_longer, longest=longest, buckets=buckets)):
        sent = context.broadcast(bits)
        local = rows.mapInArrow(lambda it, s=sent, m=mine: _mined(it, m, s.value), BLOCK_COLUMNS)
        _add_bits(_union(local, lower, support), bits)
        sent.unpersist()
    sent = context.broadcast(bits)
    exact = rows.mapInArrow(
        lambda it, s=sent: _mined(it, partial(_count_exactly, longest=longest, buckets=buckets), s.value),
        "bucket int, lang string, size int, phrases binary, counts binary")
    exact = exact.groupBy("bucket").applyInArrow(
        lambda table: _merge_exactly(table, support), "lang string, size int, phrase string, f long")
    return keep(exact.unionByName(frequent), "phrases"), totals


def collocations(
    docs: DataFrame, support: int = 30, longest: int = 4, top: int = 2000, shards: int = SHARDS,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of two words and more.

    A phrase's score is that of its worst cut into two parts: 2,000,000 times its count over the sum
    of theirs. A phrase inside a longer one that has four fifths of its count or more is left out.
    """
    phrases, totals = phrase_counts(docs, support, longest, shards, text_col, lang_col)
    found = phrases.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = found.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    counts = phrases.select("lang", "phrase", "f")
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(2000000BD * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    scored = cut.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy(
        "lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inside = found.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")).select(
        "lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i")).select(
        "lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(
        "longer IS NULL OR 100BD * cast(longer AS decimal(19,0)) < 80BD * cast(a AS decimal(19,0))")
    best = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = Window.partitionBy("lang", "salt").orderBy(*order)
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(first))
    best = best.where(F.col("place") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return best.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
