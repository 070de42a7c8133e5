"""Near-duplicates, line deduplication, decontamination, mixing, sharding, and the pipeline."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import decontaminate, lines, mixing, queries, sharding, simhash
from tabloom.llm.components import components
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def _signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints(odd_rows):
    for _, text, _ in odd_rows:
        if len(text or "") < 10_000:
            assert simhash.fingerprint((text or "").encode()) == brute.fingerprint(text)


def test_triples_cover_five_shared_bytes():
    from itertools import combinations

    assert all(any(set(t) <= set(five) for t in simhash.TRIPLES) for five in combinations(range(8), 5))


@pytest.mark.parametrize("block", [16, 2048])
def test_links_connect_what_pairs_connect(spark, block):
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for centre in list(values)[:6]:
        for _ in range(30):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    chain = rng.getrandbits(64)
    for i in range(0, 48, 3):
        chain ^= 7 << i
        values.add(chain)
    values = sorted(values)
    frame = spark.createDataFrame([(_signed(v),) for v in values], "fp long").repartition(5)
    found = components(simhash.links(frame, 3, block)).collect()
    roots = {r["node"]: r["root"] for r in found}
    got = [roots.get(_signed(v), _signed(v)) for v in values]
    want, _ = brute.classes([_signed(v) for v in values], brute.near(values))
    assert got == want


def test_simhash_groups(odd, odd_rows, nothing):
    prints = [brute.fingerprint(t) if len(t or "") < 10_000 else simhash.fingerprint(t.encode()) for _, t, _ in odd_rows]
    want, roots = brute.classes([d for d, _, _ in odd_rows], brute.near(prints))
    rows = simhash.simhash_groups(odd).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(((d, _signed(p), c) for (d, _, _), p, c in zip(odd_rows, prints, want)), key=key)
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(roots))
    assert simhash.simhash_groups(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{i: 1000 for i in range(1000, 1061)}}


def _line_docs(prose):
    passage = prose(50, 70, line=9)
    short = "a short common line"
    many = "\n".join(f"x{i}" for i in range(80))
    return [
        (1, prose(1, 100) + "\n" + passage + "\n" + short), (2, short + "\n" + passage + "\n" + prose(2, 80)), (3, prose(2, 80)), (4, None), (5, ""),
        (6, many), (7, "y\n" + many + "\nz"), (8, "\n".join(["same same same"] * 40)), (9, " ".join(["long"] * 60)), (10, "p\n \n" + " ".join(["long"] * 60) + "\n\nq"),
        (11, "\n".join(["one two three", "four five"] * 30)), (12, prose(1, 100)), (13, passage.replace("\n", "\n\n")), (14, many.replace("x40", "x41")),
    ]


def test_line_dedup(spark, odd, nothing, prose):
    docs = _line_docs(prose)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("lines", F.lit("kept")).withColumn("n_removed", F.lit(9))
    rows = {r["doc_id"]: r for r in lines.dedup_lines(frame).collect()}
    want = brute.dedup_lines(docs)
    assert [rows[d]["text"] for d, _ in docs] == want
    assert rows[3]["n_removed"] == 7 and rows[3]["text"] == "" and rows[4]["text"] is None and rows[1]["n_removed"] == 0
    assert {r["lines"] for r in rows.values()} == {"kept"}
    strange = lines.dedup_lines(odd)
    assert strange.count() == odd.count() and lines.dedup_lines(nothing).count() == 0
    cleaned = [r["text"] for r in strange.where("doc_id = 2").collect()]
    assert cleaned[0] == cleaned[1]


@pytest.mark.parametrize("least", [1, 7, 200])
def test_line_dedup_at_other_lengths(spark, prose, least):
    rng = random.Random(least)
    parts = [prose(i, 30, line=rng.randint(1, 9)) for i in range(6)]
    docs = [(i, "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for i in range(30)]
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), least_words=least).collect()
    assert [r["text"] for r in sorted(rows)] == brute.dedup_lines(docs, least)


def _benchmark(prose):
    items = [(i, prose(100 + i, 8 + 3 * i, vocabulary=5000)) for i in range(25)]
    items += [(30, items[5][1]), (31, None), (32, "too short to match"), (33, "five words are just enough"), (None, prose(400, 40))]
    docs = []
    for i, text in items[:25]:
        words = text.split()
        changed = words.copy()
        changed[len(words) // 2] = "changed"
        docs += [(i, f"{prose(i, 50)} {text} {prose(i + 1, 9)}"), (100 + i, " ".join(changed)), (200 + i, " ".join(words[: len(words) // 2]))]
    docs += [(300, " x ".join(t for _, t in items if t)), (301, None), (302, ""), (None, items[7][1]), (303, "so five words are just enough, yes"), (303, items[3][1])]
    docs += [(303, items[3][1]), (304, prose(9, 50_000) + " " + items[9][1].upper())]
    return docs, items


def test_decontamination(spark, odd, nothing, prose):
    docs, items = _benchmark(prose)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("q", F.lit(1)).withColumn("set", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("word", F.lit(0))
    rows = decontaminate.contained(frame, bench).collect()
    want = brute.contained(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_shingles"]) for r in rows} == want and len(rows) == len(want)
    bad = {d for d, _ in want}
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    found = [any(brute.contained([(0, t)], items)) for _, t in docs]
    assert kept.count() == sum(not f for f in found) and {r["doc_id"] for r in kept.collect()} & bad <= {303}
    assert decontaminate.contained(odd, bench).count() == 0 and decontaminate.drop_contaminated(odd, bench).count() == odd.count()
    assert decontaminate.contained(nothing, bench).count() == 0 and decontaminate.contained(frame, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(frame, bench.limit(0)).count() == frame.count()


def test_bandings_keep_their_promise():
    for item in (1, 3, 10, 40, 200):
        for largest in (item, 2 * item, 6 * item, 50 * item):
            t, r = decontaminate.least_jaccard(item, largest), decontaminate.banding(item, largest)
            if r:
                assert (1 - t**r) ** (decontaminate.HASHES // r) <= decontaminate.MISS
            else:
                assert (1 - t) ** decontaminate.HASHES > decontaminate.MISS


def _times(mixed):
    return Counter((r["doc_id"], r["size"], r["times"]) for r in mixed.select("doc_id", "size", "times").collect())


def test_mix_targets(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 40):
        sizes = {(None if i == 3 else f"s{i:02d}"): rng.choice([0, 5, 100, 3000, 90_000]) for i in range(n)}
        frame = spark.createDataFrame([(s, v, 1) for s, v in sizes.items()], "source string, source_size long, n long")
        got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
        want = brute.mix_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix(spark, odd, nothing, prose, monkeypatch):
    rng = random.Random(2)
    docs = [(i, prose(i, rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    first = _times(mixing.mix(frame))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)  # the result doesn't depend on how keys are cut
    assert _times(mixing.mix(frame, columns=["doc_id"])) == first
    monkeypatch.setattr(mixing, "SMALL_TABLE", 0)  # nor on how plans are joined
    assert _times(mixing.mix(frame)) == first
    rows = mixing.mix(frame).collect()
    for source in ("a", "b", "c", None):
        own = [r for r in rows if r["source"] == source]
        size, taken, target = sum(r["size"] for r in own), sum(r["size"] * r["times"] for r in own), own[0]["target"]
        assert size == own[0]["source_size"] and abs(taken - target) <= 30 and max(r["times"] for r in own) <= 2
        assert max(r["times"] for r in own) - min(r["times"] for r in own) <= 1
    mixed = mixing.mix(odd)
    assert mixed.count() == odd.count() and set(odd.columns) | set(mixing.RESULT) == set(mixed.columns)
    assert mixing.mix(nothing).count() == 0
    repeated = mixing.repeat_rows(mixing.mix(frame), frame.columns)
    assert repeated.columns == frame.columns and repeated.count() == sum(r["times"] for r in rows)


def test_heavier_documents_come_first(spark):
    docs = [(i, "w " * 10, "s", 5.0 if i % 2 else 1.0) for i in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, weight double")
    rows = mixing.mix(frame, weight=F.col("weight"), share=0.3).collect()
    heavy, light = (sum(r["times"] for r in rows if r["doc_id"] % 2 == k) for k in (1, 0))
    assert heavy + light == 600 and heavy > 2 * light


def test_matrix_has_the_sums_and_the_law():
    parts, shards = [40, 0, 7, 53], [25, 25, 25, 25]
    total = np.zeros((4, 4))
    for seed in range(300):
        m = sharding.communication_matrix(parts, shards, seed)
        assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == shards
        total += m
    assert np.abs(total / 300 - np.outer(parts, shards) / 100).max() < 0.6


@pytest.mark.parametrize("shards, part_rows", [(1, 10), (7, 25), (40, 8192), (60, 3)])
def test_shards(spark, prose, shards, part_rows):
    docs = [(i if i % 50 else None, prose(i % 90, 20), i) for i in range(431)]
    docs += [(7, "copy", 1000)] * 60
    frame = spark.createDataFrame(docs, "doc_id long, text string, shard int").repartition(4)
    dealt = sharding.shard(frame.withColumn("part", F.lit(1)), shards, part_rows=part_rows)
    rows = dealt.collect()
    slots = {j: sorted(r["slot"] for r in rows if r["shard"] == j) for j in range(shards)}
    assert all(slots[j] == list(range(n)) for j, n in enumerate(sharding.shard_sizes(491, shards)))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"])
    assert sorted(map(key, rows)) == sorted((d is None, d or 0, t) for d, t, _ in docs)
    if shards == 7:
        copies = Counter(r["shard"] for r in rows if r["text"] == "copy")
        assert max(copies.values()) < 25  # copies are spread
        again = {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.shard(frame.repartition(3), shards, part_rows=part_rows).collect()}
        assert {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows} == again


def test_shards_of_odd_rows(odd, nothing):
    assert sharding.shard(odd, 5).count() == odd.count() and sharding.shard(nothing, 5).count() == 0


def test_shuffle_is_uniform(spark):
    frame = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard(frame, 8, part_rows=500).collect()
    counts = np.zeros((8, 8))
    for r in rows:
        counts[r["doc_id"] // 1000, r["shard"]] += 1
    assert ((counts - 125) ** 2 / 125).sum() < 100  # chi square of 49 degrees


def test_pipeline_against_plain_versions(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLES['op1_quality_rules']}) WHERE kept").fetchall()}
    docs = {r[0]: r for r in con.execute("SELECT doc_id, text, source FROM documents").fetchall()}
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    kept = sorted(good)
    _, roots = brute.classes(kept, brute.near([brute.fingerprint(docs[d][1]) for d in kept]))
    least = {}
    for d, root in zip(kept, roots):
        least.setdefault(root, d)
    kept = sorted(least.values())
    held = {d for d, _ in brute.contained([(d, docs[d][1]) for d in kept], items)}
    kept = [d for d in kept if d not in held]
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, SMALL)
        sizes.append(frame.count())
    assert sorted(r["doc_id"] for r in frame.select("doc_id").collect()) == kept and sizes[0] == len(good)
    con.register("left_over", frame.select("doc_id", "text", "source").toPandas())
    taken = con.execute(queries.ORACLES["op8_mix"].replace("FROM documents", "FROM left_over")).fetchall()
    want = Counter()
    for doc_id, size, _, _, words in taken:
        if words:
            want[doc_id] = words // size
    result = corpus_pipeline.run(spark, SMALL)
    rows = result.collect()
    assert Counter(r["doc_id"] for r in rows) == want and result.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    by_shard = Counter(r["shard"] for r in rows)
    assert max(by_shard.values()) - min(by_shard.get(j, 0) for j in range(40)) <= 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_queries_keep_the_contract(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    five = queries.op5_simhash(spark, SMALL).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in five} == {d: f"{brute.fingerprint(t):016x}" for d, t in docs.items()}
    nine = queries.op9_shard(spark, SMALL).collect()
    assert {r["size"] - 16 - len(docs[r["doc_id"]].encode()) for r in nine} == {0} and {r["law"] for r in nine} == {"rows"}
    assert math.isclose(len(nine), len(docs)) and {r["grown_shard"] for r in nine} == {None}
    assert xxhash.xxh64_intdigest(b"a b c", 42) == spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64
