"""Hostile texts, hot keys and reruns of the operators on documents."""

import base64
import json
import random
import re
import time
import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import lines, mixing, queries, secrets, sharding
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def _part(value):
    return base64.urlsafe_b64encode(value if isinstance(value, bytes) else json.dumps(value).encode()).decode().rstrip("=")


# ---------------------------------------------------------------- secret scans


@pytest.mark.parametrize("depth", [10_000, 300_000])
def test_tokens_nested_too_deeply(depth):
    deep = b'{"alg":' + b"[" * depth
    for text in (f"{_part({'alg': 'x'})}.{_part(deep)}.s", f"{_part(deep)}.{_part({'a': 1})}.s", f"{_part(deep + b']' * depth + b'}')}.{_part({'a': 1})}.s"):
        assert secrets.spans(text) == []


@pytest.mark.parametrize("line", [
    "A" * 64, "MIIMIIMIIMII" * 5, "MIIEowIBAAKCAQEA" * 4, "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtz",
    "AAAAC3NzaC1lZDI1NTE5AAAAIEtleUtleUtleUtleUtleUtleUtleUtleUtleUtl", "MHcCAQ" * 11, "AAAAB3NzaC1yc2EA" * 4,
])
def test_wrapped_lines_take_linear_time(line):
    took = []
    for n in (2_000, 16_000):
        text = "\n".join([line] * n)
        began = time.process_time()
        secrets.spans(text)
        took.append(time.process_time() - began)
    assert took[1] < max(2.5, 20 * took[0])  # eight times the text; quadratic would be 64 times


def test_base_spans_as_plain_scans_find_them(spark):
    rng = random.Random(3)
    parts = ["password", "Passwd", "api_key", "APIKEY", "token", "secret", " = ", ":", "='", '": "', "abc+/_.=-", "AKIA", "0a1f", "ABC9", "x", " ", "\n", "é", "deadbeef" * 4]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [r["text"] for r in queries.table(spark, SMALL, "documents").select("text").limit(100).collect()]

    def plain(text):
        found = []
        for kind, pattern, group, least, flags in (
            ("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, re.I | re.A),
            ("access", "AKIA[A-Z0-9]+", 0, 16, 0), ("hex", "[0-9a-f]+", 0, 32, 0),
        ):
            found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
        order = ["assign", "access", "hex"]
        return sorted(found, key=lambda s: (s[0], order.index(s[1])))

    for text in texts:
        assert [(a, k, b) for a, b, k in secrets.spans(text) if k in ("assign", "access", "hex")] == plain(text)


def test_keys_further_down_a_block():
    """A key that begins in a later line of a block, and a second one behind it."""
    def der(tag, body):
        size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
        return bytes([tag]) + size + body

    key = der(0x30, der(2, b"\x00") + der(2, bytes(i % 250 for i in range(300))) + der(2, b"\x05" * 40))
    wrapped = "\n".join(base64.b64encode(key).decode()[i : i + 64] for i in range(0, 4 * ((len(key) + 2) // 3), 64))
    noise = "\n".join(["Q" * 64] * 5)
    text = f"{noise}\n{wrapped}\n\n{noise}\n{wrapped}\n"
    found = [(a, b) for a, b, k in secrets.spans(text) if k == "der"]
    first = len(noise) + 1
    second = first + len(wrapped) + 2 + len(noise) + 1
    assert found == [(first, first + len(wrapped)), (second, second + len(wrapped))]


def test_secret_ids_keep_their_type(spark):
    rows = secrets.secret_spans(spark.createDataFrame([("doc-1", "x"), (None, None)], "doc_id string, text string"))
    assert rows.schema["doc_id"].dataType.simpleString() == "string" and {r["doc_id"] for r in rows.collect()} == {"doc-1", None}


# ---------------------------------------------------------------- mixing


def test_rows_without_ids_are_drawn_one_by_one(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    base = mixing._measured(rows, "doc_id", "text", "source", None, 8, ["size", "place", "ranked"])
    ranges = base.groupBy(F.floor(F.col("place") * 5)).count().collect()
    assert base.select("place").distinct().count() == 20_000 and len(ranges) == 5 and max(r["count"] for r in ranges) < 8000
    taken = mixing.mix(rows, share=0.5).agg(F.sum(F.col("size") * F.col("times")).alias("t"), F.first("target").alias("g")).first()
    assert abs(taken["t"] - taken["g"]) <= 2


def test_mix_of_null_ids_and_null_texts(spark):
    rows = spark.createDataFrame([(None, None, None)] * 5 + [(None, "a b", None)] * 3, "doc_id long, text string, source string")
    assert mixing.mix(rows).count() == 8 and mixing.mix(rows).agg(F.max("times")).first()[0] <= 2


# ---------------------------------------------------------------- sharding


def test_equal_rows_spread(spark, monkeypatch):
    rows = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    seen = {}
    inner = sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda parts, *a: seen.update(parts=parts) or inner(parts, *a))
    placed = sharding.shard(rows, 8, part_rows=1000).collect()
    assert len(seen["parts"]) == 20 and max(seen["parts"]) < 1500
    assert Counter(r["shard"] for r in placed) == {j: 2500 for j in range(8)}
    assert len({(r["shard"], r["slot"]) for r in placed}) == 20_000


def test_rows_that_differ_elsewhere_keep_their_places(spark):
    rows = spark.createDataFrame([(1, "t", i, {str(i): 1}) for i in range(500)], "doc_id long, text string, other long, m map<string,int>")
    first, second = (
        {(r["other"], r["shard"], r["slot"]) for r in sharding.shard(rows.repartition(n), 7, part_rows=40).collect()} for n in (2, 5))
    assert first == second and len(first) == 500


def test_draws_beyond_the_generator():
    for good, bad, n in ((30, 50, 20), (5, 3, 6), (100, 7, 50), (2, 90, 40)):
        want = [comb(good, k) * comb(bad, n - k) / comb(good + bad, n) if n - k >= 0 else 0 for k in range(n + 1)]
        draws = [sharding._inverted((i + 0.5) / 20_000, good, bad, n) for i in range(20_000)]
        assert np.abs(np.bincount(draws, minlength=n + 1) / 20_000 - want).max() < 2e-4
    rng = np.random.default_rng(1)
    matrix = sharding.communication_matrix([10**9, 2 * 10**9, 3], sharding.shard_sizes(3 * 10**9 + 3, 3), 5)
    assert matrix.sum(axis=1).tolist() == [10**9, 2 * 10**9, 3] and matrix.sum(axis=0).tolist() == [10**9 + 1] * 3
    draws = np.array([sharding._hypergeometric(rng, 3 * 10**9, 7 * 10**10, 10**6) for _ in range(1000)])
    p = 3e9 / 7.3e10
    spread = (1e6 * p * (1 - p)) ** 0.5
    assert abs(draws.mean() - 1e6 * p) < 4 * spread / 1000**0.5 and 0.9 < draws.std() / spread < 1.1


def test_digests_of_texts(spark):
    docs = {r["doc_id"]: r["text"].encode() for r in queries.table(spark, SMALL, "documents").collect()}
    assert {(r["doc_id"], r["text_crc32"]) for r in queries.op9_shard(spark, SMALL).collect()} == {(d, zlib.crc32(t)) for d, t in docs.items()}


# ---------------------------------------------------------------- line deduplication


def test_frequent_lines_go_by_themselves(spark, prose):
    often, seldom, short = "a line of eight words that is common", "another line of eight words stands less often", "too short to go"
    rng = random.Random(5)
    docs = []
    for i in range(40):
        body = prose(1000 + i, 60, vocabulary=5000).split("\n")
        body.insert(rng.randrange(5), short)
        if i % 2:
            body.insert(rng.randrange(5), often)
        if i % 4 == 1:
            body.insert(rng.randrange(5), seldom)
        docs.append((i, "\n".join(body)))
    docs[3] = (3, docs[3][1] + "\n" + often)
    rows = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert [rows[i] for i, _ in docs] == brute.dedup_lines(docs)
    text = "\n".join(rows.values())
    assert text.count(often) == 1 and text.count(seldom) == 10 and text.count(short) == 40


@pytest.mark.parametrize(("line_words", "many"), [(1, 2), (3, 5)])
def test_frequent_lines_at_other_bounds(spark, line_words, many):
    rng = random.Random(many)
    docs = [(i, "\n".join(" ".join("w" for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 8)))) for i in range(25)]
    docs = list({t: (i, t) for i, t in docs}.values())
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), least_words=9, line_words=line_words, many=many).collect()
    assert [r["text"] for r in sorted(rows)] == brute.dedup_lines(sorted(docs), 9, line_words, many)
