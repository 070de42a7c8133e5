"""Ranked search, packing and collocations against plain Python versions and round trips."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import collocations, packing, queries, retrieval

SMALL = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- ranked search


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def ranked(docs, items, k):
    bags = [(doc_id, Counter(terms(text))) for doc_id, text, *_ in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, bag in bags:
            n = sum(bag.values())
            score = 0
            for t in set(terms(text)) & set(bag):
                m = 10 + 90 * n * n_docs // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_search_finds_the_best(spark, odd, odd_rows, prose, block_bytes):
    items = [(1, prose(3, 12)), (2, "same one tail"), (2, "same one tail"), (3, None), (4, ""), (None, "W5 w6 w7, w8-w9"), (5, "É ü"), (6, "absent")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0)).withColumn("query", F.lit("x"))
    got = retrieval.search(odd.repartition(3), frame, 3, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == sorted(ranked(odd_rows, items, 3), key=repr)


def test_search_keeps_ids_and_takes_empty_tables(spark, nothing, odd):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "x z")], "item_id int, text string")
    got = [tuple(r) for r in retrieval.search(docs, items).orderBy("rank").select("rank", "doc_id").collect()]
    assert got == [(1, "c"), (2, "a"), (3, "b")]
    assert retrieval.search(nothing, items).count() == 0
    assert retrieval.search(odd, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert retrieval.search(odd, items.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0, 1, 40, 90, 150, 400])
def test_bucket_bounds_lose_nothing(least):
    rng = np.random.default_rng(least)
    lots = [np.sort(rng.choice(30, rng.integers(0, 12), replace=False)) for _ in range(200)]
    sizes, flat = np.array([len(x) for x in lots]), np.concatenate(lots)
    impacts = rng.integers(0, 60, len(flat))
    bucket = retrieval.Bucket(sizes, flat, impacts, 30)
    query = rng.choice(30, 8, replace=False)
    want, at = {}, 0
    for row, lot in enumerate(lots):
        score = sum(int(v) for t, v in zip(lot, impacts[at : at + len(lot)]) if t in query)
        at += len(lot)
        if score >= max(least, 1):
            want[row] = score
    rows, scores = bucket.search(query, least)
    assert dict(zip(rows.tolist(), scores.tolist())) == want


def test_scores_over_32_bits(spark):
    docs = spark.createDataFrame([(i, "a b" if i else "z " * 3000 + "rare") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "rare a z")], "item_id long, text string")
    want = ranked([tuple(r) for r in docs.collect()], [(1, "rare a z")], 10)
    assert [tuple(r) for r in retrieval.search(docs, items).orderBy("rank").collect()] == want and want[0][3] > 2**31


# ---------------------------------------------------------------- packing


def check_packed(rows, want, window):
    """Pieces tile documents and sequences, and hold the documents' ids. ``want``: (doc_id, ids) of all documents."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(r["length"] for r in pieces[:i]) for i in range(len(pieces))]
        size = sum(r["length"] for r in pieces)
        assert size == window or size < window and size & (size - 1) == 0
    expected = defaultdict(Counter)
    for doc_id, ids in want:
        for i, t in enumerate(ids):
            expected[doc_id][(i, t, len(ids))] += 1
    got = defaultdict(Counter)
    for doc_id, pieces in by_doc.items():
        for r in pieces:
            for i, t in enumerate(np.frombuffer(r["ids"], "<u4").tolist()):
                got[doc_id][(r["start"] + i, t, r["doc_tokens"])] += 1
    assert got == expected


@pytest.mark.parametrize(("window", "shard_bytes"), [(2048, 1 << 23), (64, 1 << 23), (2048, 60_000)])
def test_pack_keeps_every_token_once(odd, odd_rows, window, shard_bytes):
    plain = Tokenizer.from_file(TOKENIZER)
    want = [(d, plain.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, _ in odd_rows]
    packed = packing.pack(odd, TOKENIZER, window, shard_bytes=shard_bytes)
    assert packed.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    check_packed(packed.collect(), want, window)


def test_pack_again_gives_the_same(odd, nothing):
    def packed(df):
        return rows_of(packing.pack(df, TOKENIZER))

    assert packed(odd.coalesce(1)) == packed(odd.orderBy(F.desc("text")).coalesce(1))
    assert packed(nothing) == []


def test_tokens_are_the_tokenizers(odd_rows):
    plain = Tokenizer.from_file(TOKENIZER)
    texts = [
        "The CAT's hat, it's... 3.14 (really)!", "<|endoftext|> x <|STARTOFTEXT|>y<|startoftext|>", "J̌ é É Š ́x",
        "a b c\u0085d\x1ce\x0bf", "İİ ΑΣ ΟΔΟΣ. ß", "emoji 😀😀 mixed中文字 don't DON'T 'S", "tab\tnew\r\nline", "﻿bom",
        *[t or "" for _, t, _ in odd_rows[:8]],
    ]
    ours = packing.Tokens(TOKENIZER)
    for _ in range(2):
        for text in texts:
            assert np.frombuffer(ours.ids(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_tokens_forget_and_learn_again(monkeypatch):
    monkeypatch.setattr(packing, "MOST_KNOWN", 40)
    plain, ours = Tokenizer.from_file(TOKENIZER), packing.Tokens(TOKENIZER)
    for i in range(20):
        text = " ".join(f"w{chr(97 + j % 26)}{i} same word{chr(97 + i)}" for j in range(i + 3))
        assert np.frombuffer(ours.ids(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(ours.known) <= 40


def test_given_documents_round_trip(spark):
    docs = queries.table(spark, SMALL, "documents")
    plain = Tokenizer.from_file(TOKENIZER)
    want = {r["doc_id"]: plain.encode(r["text"], add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces = queries.op12_packing(spark, SMALL).collect()
    for r in pieces:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert sum(r["length"] for r in pieces) == sum(map(len, want.values()))


def test_windows_hold_neighbours():
    """Documents of few topics share their windows with their topic more often than chance has it."""
    rng = np.random.default_rng(5)
    docs = [np.append(rng.integers(1000 * (i % 8), 1000 * (i % 8) + 1000, rng.integers(50, 400)), 1).astype("<u4") for i in range(400)]
    same = total = 0
    for sequence in packing.plan(docs, 1024):
        topics = [d % 8 for d, _, _ in sequence]
        same += sum(a == b for a, b in zip(topics, topics[1:]))
        total += len(topics) - 1
    assert same / total > 0.8


def test_index_ranks_like_bm25():
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(2, 60, rng.integers(1, 30)), 1).astype("<u4") for _ in range(80)]
    index, n, mean = packing.Index(docs), len(docs), np.mean([len(d) for d in docs])
    bags = [Counter(d[:-1].tolist()) for d in docs]
    df = Counter(t for b in bags for t in b)

    def weight(t, i):
        tf = bags[i][t]
        return math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))

    unused = rng.random(n) < 0.7
    for d in range(0, n, 9):
        scores = {i: sum(weight(t, i) for t in bags[d] if t in bags[i]) for i in range(n) if unused[i]}
        best = sorted((i for i in scores if scores[i] > 0), key=lambda i: -scores[i])[:5]
        got = index.neighbours(d, unused, 5)
        assert [round(scores[i], 3) for i in got] == [round(scores[i], 3) for i in best]


# ---------------------------------------------------------------- collocations


def mined(docs, support, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("shards", "support"), [(1, 3), (8, 3), (5, 6)])
def test_collocations_are_all_found(spark, prose, shards, support):
    texts = [(prose(i, 150, 12, 9).replace("w1 ", "W1. "), ["en", None, "fr"][i % 3]) for i in range(24)]
    texts += [("one two three four five six; one two", "en")] * 7 + [(None, None), ("", "xx"), (" \t ", "de"), ("É ü É ü É ü É ü", "fr")]
    frame = spark.createDataFrame(texts, "text string, lang string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x")).repartition(4)
    got = collocations.collocations(frame, support, top=40, shards=shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(got) == sorted(mined(texts, support, 4, 40), key=repr)


def test_collocations_of_lots(spark, prose, monkeypatch):
    """Counts sent in several lots by a task add up."""
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 500)
    monkeypatch.setattr(collocations, "TEXT_BYTES", 700)
    texts = [(prose(i, 150, 12, 9), "en") for i in range(20)]
    got = collocations.collocations(spark.createDataFrame(texts, "text string, lang string").coalesce(1), 6, 5, 30)
    assert rows_of(got) == sorted(mined(texts, 6, 5, 30), key=repr)


def test_collocations_of_nothing(nothing):
    assert collocations.collocations(nothing.withColumn("lang", F.lit("en"))).count() == 0


def test_lots_are_held_in_small_numbers_and_looked_up_in_slices(monkeypatch):
    seen = []

    def count(lot, groups):
        seen.append(({group: ids.dtype for group, ids in groups.items()}, len(lot.words)))
        yield from ()

    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "shard": [0, 1], "text": [b"a b. a c", b"b"]})
    list(collocations._mined(iter([batch]), count))
    assert seen == [({("en", 0): np.int32, ("de", 1): np.int32}, 4)]
    bits = np.zeros(1 << collocations.BITS - 6, np.uint64)
    some = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64)
    for shift in collocations.PROBES:
        at = (some[:700] >> np.uint64(shift)) & np.uint64((1 << collocations.BITS) - 1)
        np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    whole = collocations._holds(bits, some)
    monkeypatch.setattr(collocations, "SLICE", 33)
    assert whole[:700].all() and not whole[700:].all() and (collocations._holds(bits, some) == whole).all()


def test_counts_travel_as_blocks():
    """A lot sends a row for each bucket, not for each phrase, and merged blocks lose no count."""
    rng, want, tables = np.random.default_rng(3), Counter(), []
    for lot in range(3):
        hashes = {}
        for group in (("en", 0), ("en", 5), (f"x{lot}", 1)):
            hashes[group] = (rng.zipf(1.3, 3000) % 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for h in hashes[group].tolist():
                want[group[0], h >> 64 - collocations.KEY, group[1]] += 1
        (block,) = collocations._local_counts(hashes, 4)
        assert block.num_rows <= 4
        tables.append(pa.Table.from_batches([block]))
    totals = Counter()
    for (lang, key, _), n in want.items():
        totals[lang, key] += n
    whole, got = pa.concat_tables(tables), {}
    for bucket in range(4):
        mine = whole.filter(pa.array([b == bucket for b in whole["bucket"].to_pylist()]))
        for row in collocations._merge(mine, 7).to_pylist():
            key = row["h"] % (1 << 64) >> 64 - collocations.KEY
            got |= {(row["lang"], key, shard): n for shard, n in zip(row["shards"], row["counts"])}
    assert got == {k: n for k, n in want.items() if totals[k[:2]] >= 7}
    assert list(collocations._local_counts({("en", 0): np.zeros(0, np.uint64)}, 4)) == []
