"""Quality rules, URL filters, license scans, scoring and secret scans."""

import base64
import hashlib
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import licenses, lm, quality, queries, secrets, urls
from tests.llm import brute


def test_quality_counts(odd, odd_rows):
    rows = quality.quality_rules(odd).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[f] for f in fields]) for r in rows)
    assert got == sorted((d is None, d or 0, *brute.quality(t)) for d, t, _ in odd_rows)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_quality_keeps_rows_as_they_are(odd, nothing):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    assert 10 not in ids and 7 not in ids and ids.count(12) == 0  # no stop words in those
    assert quality.quality_rules(nothing).count() == 0 and quality.keep_good(nothing).count() == 0


@pytest.mark.parametrize("text, broken", [
    ("the cat and the dog " * 2 + " ".join(f"word{i} of" for i in range(20)), ""),
    (" ".join(f"word{i} | the" for i in range(20)), "symbols"),
    (" ".join(f"word{i}!!! the" for i in range(20)), "exclamations"),
    (" ".join(f"word{i}" for i in range(30)), "stop_words"),
    ("the cat sat\n" * 3 + "\n".join(f"- the item {i}" for i in range(60)), "bullet_lines"),
    ("\n".join(f"the word{i} of..." for i in range(20)), "ellipsis_lines"),
])
def test_each_rule(spark, text, broken):
    row = quality.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["failed_rules"] == broken and row["kept"] == (broken == "")


URLS = [
    (1, "http://a.COM/x", "a.com", "/x", "com/"), (2, "https://example.com/en/1", "example.com", "/en/1", "example.com/en/"),
    (3, "https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"),
    (4, "https://www.example.com/de/1?x=/en/", "www.example.com", "/de/1", "com/"), (5, "http://b.net/es/q#f", "b.net", "/es/q", "net/es/"),
    (6, "http://net/fr/", "net", "/fr/", "net/fr/"), (7, "http://b.net/de/", "b.net", "/de/", None), (8, "http://a.com", "a.com", "", None),
    (9, "a.com/x", "", "", None), (10, None, "", "", None), (11, "http://mycom/x", "mycom", "/x", None), (12, "://", "", "", None),
    (13, "x://notexample.com/en/?a=b&c=d", "notexample.com", "/en/", "com/"), (14, "HTTP://É.com:80/é\n/x?y", "É.com:80", "/é\n/x", None),
    (2, "https://example.com/en/1", "example.com", "/en/1", "example.com/en/"),
]


def test_url_rules(spark):
    given = spark.createDataFrame([(i, u, "x", 0) for i, u, *_ in URLS], "page_id long, url string, verdict string, row int")
    rows = urls.filter_urls(given, queries.URL_RULES).collect()
    key = lambda r: (r[0], r[1], r[2], r[3] or "")
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in rows), key=key) == sorted(((i, h, p, r) for i, _, h, p, r in URLS), key=key)
    verdicts = {r.text: r.verdict for r in queries.URL_RULES}
    assert all(r["verdict"] == verdicts.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block") for r in rows)
    assert urls.filter_urls(given.limit(0), queries.URL_RULES).count() == 0


def test_url_trees_on_held_out_labels(spark):
    rng = random.Random(5)

    def url(bad):
        name = "".join(rng.choice("abcdefgh0123456789" if bad else "abcdefgh") for _ in range(rng.randint(8, 20)))
        tail = "&".join(f"k{i}={rng.randrange(99)}" for i in range(rng.randint(2, 5))) if bad else ""
        return f"http://{name}.org/{'a/' * rng.randint(0, 3)}{'?' + tail if tail else ''}"

    rows = [(i, url(i % 3 == 0), "block" if i % 3 == 0 else "allow") for i in range(900)]
    labels = spark.createDataFrame([(u, v) for i, u, v in rows if i < 600], "url string, verdict string")
    held_out = spark.createDataFrame([(u, v) for i, u, v in rows if i >= 600], "url string, truth string")
    judged = urls.filter_urls(held_out, [], labels=labels, most=500)
    right = judged.where("verdict = truth").count()
    assert right >= 0.95 * 300


def test_licenses(spark, odd, nothing, prose):
    mit, gpl = licenses.TEMPLATES["mit-permission"], licenses.TEMPLATES["gpl-3.0-notice"]
    words = mit.split()
    changed, ruined = words.copy(), words.copy()
    changed[30] = "another"
    for i in range(0, len(ruined), 4):
        ruined[i] = "x"
    texts = [
        (1, prose(1, 333) + "\n" + mit + "\n" + prose(2, 77)), (2, gpl.upper()), (3, " ".join(changed)), (4, " ".join(ruined)),
        (5, f"{gpl} {prose(3, 500)} {mit} {gpl}"), (6, None), (None, gpl), (7, "Released under the MIT"), (7, "Released under the MIT License."),
    ]
    found = licenses.license_matches(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["license"]) for r in found}
    assert got == {(1, "mit-permission"), (2, "gpl-3.0-notice"), (3, "mit-permission"), (5, "mit-permission"), (5, "gpl-3.0-notice"), (None, "gpl-3.0-notice"), (7, "mit-notice")}
    whole = next(r for r in found if (r["doc_id"], r["license"]) == (1, "mit-permission"))
    assert whole["n_shared"] == whole["n_shingles"] and whole["first_word"] == 333
    assert licenses.license_matches(odd).count() == 0 and licenses.license_matches(nothing).count() == 0


def test_license_windows_miss_nothing(prose):
    """Every alignment of every template is found, as exact containment in the whole text says."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        for shift in range(0, 70, 7):
            assert name in {m[0] for m in scanner.scan(f"{prose(shift, shift)} {template} {prose(9, 50)}")}


def test_licenses_of_few_words(spark, prose):
    texts = [
        (1, prose(1, 40) + "\nCopyright 2020 Someone. All rights reserved.\n" + prose(2, 9)), (2, "All rights reserved."), (3, "all rights are reserved"),
        (4, "rights reserved"), (5, "Unauthorized copying of this file, via any medium, is strictly prohibited"),
    ]
    found = licenses.license_matches(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == [(1, "all-rights-reserved", 1, 1, 43, 46), (2, "all-rights-reserved", 1, 1, 0, 3), (5, "unauthorized-copying", 7, 7, 0, 11)]
    for short in ("Proprietary", "CC0", "GPL v2", "Public domain", "Do not copy this"):
        scanner = licenses.Scanner({"short": short, "long": licenses.TEMPLATES["mit-permission"]})
        for shift in range(9):
            size = len(short.split())
            assert scanner.scan(f"{prose(shift, shift)} {short} {prose(9, 20)}") == [("short", 1, 1, shift, shift + size)]
    assert licenses.Scanner({}).scan("All rights reserved") == []


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, lm.TOKENS, 50).astype(np.int32)
    context, network = lm._contexts(ids, slice(0, 50)), lm.Network(lm.Network.initial(2).values.astype(np.float64))
    slope = network.gradient(context, ids)
    for at in np.flatnonzero(slope)[:: max(1, np.count_nonzero(slope) // 25)]:
        old, two = network.values[at], []
        for step in (1e-4, -1e-4):
            network.values[at] = old + step
            two.append(-network.log_probabilities(context, ids).sum())
        network.values[at] = old
        assert abs((two[0] - two[1]) / 2e-4 - slope[at]) < 0.02 * max(1, abs(slope[at]))


def test_probabilities_sum_to_one():
    network = lm.Network.initial(3)
    context = np.tile(np.array([[1], [2], [3], [lm.EDGE]], np.int32), lm.TOKENS)
    assert abs(np.exp(network.log_probabilities(context, np.arange(lm.TOKENS, dtype=np.int32))).sum() - 1) < 1e-3


def test_scores(spark, odd, nothing):
    rng = random.Random(3)
    phrases = ["the old man sat by the sea", "a cat ran over the green hill", "we went home at the end of day"]
    good = [" ".join(rng.choice(phrases) for _ in range(30)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(good)), "doc_id long, text string").repartition(3)
    values = lm.fit(docs)
    shuffled = good[0].split()
    rng.shuffle(shuffled)
    tests = spark.createDataFrame([(1, good[1]), (2, " ".join(shuffled)), (3, "zz yy xx " * 40), (4, None), (5, " \n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(tests, values).collect()}
    assert got[1]["mean_log_prob"] > got[2]["mean_log_prob"] > got[3]["mean_log_prob"] and got[1]["mean_log_prob"] > math.log(1 / lm.TOKENS)
    assert got[4]["n_tokens"] == 0 and got[5]["log_prob"] == 0.0 and got[5]["mean_log_prob"] is None
    assert lm.score(odd, values).count() == odd.count() and lm.score(nothing, values).count() == 0
    assert lm.fit(nothing).shape == values.shape


def test_every_position_is_a_target_once(monkeypatch):
    seen = []
    monkeypatch.setattr(lm.Trainer, "step", lambda self, context, target: seen.append((context, target)))
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, n)) for n in (0, 1, 7, 15, 16, 17, 500, 3 * lm.BATCH + 5)]
    list(lm._train((t.encode() for t in texts), 4, lm.RATE))
    ids = [lm.tokens(t.encode(), lm._Hashes()) for t in texts]
    want = np.concatenate([np.vstack([lm._contexts(x, slice(None)), x]) for x in ids], axis=1)
    got = np.vstack([np.concatenate([c for c, _ in seen], axis=1), np.concatenate([t for _, t in seen])])
    assert sorted(map(tuple, got.T)) == sorted(map(tuple, want.T))


def test_words_rarely_share_a_token():
    words = {int(t) for t in lm.tokens(" ".join(f"word{i}" for i in range(2000)).encode(), lm._Hashes())}
    assert len(words) > 0.95 * 2000


def test_steps_are_those_of_the_whole_gradient():
    rng, trainer = np.random.default_rng(2), lm.Trainer(1, lm.RATE)
    values, squares = trainer.network.values.copy(), np.full(lm.Network.SIZE, 1e-3, np.float32)
    for _ in range(3):
        ids = rng.integers(0, lm.TOKENS, 300).astype(np.int32)
        context = lm._contexts(ids, slice(None))
        slope = lm.Network(values).gradient(context, ids) / np.sqrt(np.float32(ids.size))
        squares += slope * slope
        values = values - np.float32(lm.RATE) * slope / np.sqrt(squares)
        trainer.step(context, ids)
    assert np.abs(trainer.network.values - values).max() < 1e-4 and trainer.seen == 900


def test_large_weights_keep_probabilities():
    network = lm.Network(lm.Network.initial(3).values * 500)
    context = np.tile(np.array([[1], [2], [3], [lm.EDGE]], np.int32), lm.TOKENS)
    found = network.log_probabilities(context, np.arange(lm.TOKENS, dtype=np.int32))
    assert np.isfinite(found).all() and abs(np.exp(found).sum() - 1) < 1e-2


def test_long_texts_are_scored_by_pieces():
    network, ids = lm.Network.initial(1), np.random.default_rng(0).integers(0, lm.TOKENS, 3 * lm.CHUNK + 5).astype(np.int32)
    whole = network.log_probabilities(lm._contexts(ids, slice(None)), ids).sum()
    assert abs(lm._log_sums(network, [ids[:3], ids, ids[:0]])[1] - whole) < 1e-3 * abs(whole)


def test_network_works_on_lots_that_a_cache_holds():
    rng, network = np.random.default_rng(6), lm.Network.initial(1)
    ids = rng.integers(0, lm.TOKENS, 1 << 14).astype(np.int32)
    context = lm._contexts(ids, slice(None))
    found = network.log_probabilities(context, ids)
    assert network.space.size <= lm.NEAR * max(lm.LEVELS.values())  # not every choice of every position
    for at in range(0, ids.size, 1000):
        some = slice(at, at + 1000)
        assert np.abs(network.log_probabilities(context[:, some], ids[some]) - found[some]).max() < 1e-4
    parts = [(name, rows, len(sums)) for name, rows, sums in network.slopes(context, ids) if name in lm.LEVELS]
    met = {name: np.concatenate([np.r_[rows] for n, rows, _ in parts if n == name]) for name in lm.LEVELS}
    assert max(n for _, _, n in parts) <= lm.NODES
    rest = lm.TOKENS
    for name, fan in lm.LEVELS.items():  # every node of the batch once
        rest //= fan
        assert (met[name] == np.unique(ids // rest // fan)).all()


def _der(*parts):
    size = lambda n: bytes([n]) if n < 128 else (b"\x81" if n < 256 else b"\x82") + n.to_bytes(1 + (n > 255), "big")
    body = b"".join(bytes([tag]) + size(len(v)) + v for tag, v in parts)
    return b"\x30" + size(len(body)) + body


def _field(*parts):
    return b"".join(len(p).to_bytes(4, "big") + p for p in parts)


KEY = _der((2, b"\x00"), (2, bytes(range(1, 200))), (0x30, b"\x02\x01\x05"))


def _token(head):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{part(head)}.{part({'sub': 1})}.c2lnbmF0dXJl"


@pytest.mark.parametrize("text, kinds", [
    ("-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(KEY).decode() + "-----END RSA PRIVATE KEY-----", ["pem", "der"]),
    ("-----BEGIN RSA PRIVATE KEY-----\nbm90IGEga2V5\n-----END RSA PRIVATE KEY-----", []),
    (base64.b64encode(KEY).decode(), ["der"]), (base64.b64encode(KEY[:-1]).decode(), []), (KEY.hex().upper(), ["hexder"]), ("A" * 60, []),
    ("ssh " + base64.b64encode(_field(b"ssh-ed25519", bytes(32))).decode(), ["ssh"]), ("ssh " + base64.b64encode(_field(b"ssh-ed25519", bytes(32))[:-1]).decode(), []),
    ("x " + _token({"alg": "HS256"}) + " y", ["jwt"]), ("x " + _token({"typ": "JWT"}), []), ("eyJ.eyJ.x", []), ("eyJhb.eyJzd.sig", []),
    ("PassWord = 'abcd1234'", ["assign"]), ("api_key:short", []), ("paſſword=abcdefgh", []), ("AKIA" + "A" * 12, ["access"]), ("AKIA" + "A" * 11, []),
    ("token = " + "0a" * 20, ["assign", "hex"]), ("É" * 3 + "0a" * 16, ["hex"]), ("g" + "0a" * 15, []), ("", []),
])
def test_secrets(text, kinds):
    found = secrets.spans(text)
    wanted = [k for k in kinds if k != "der" or "-----" not in text]
    assert [k for _, _, k in found if not (k == "der" and "-----" in text)] == wanted


LONG = _der((2, b"\x00"), (2, bytes(i * 7 % 251 for i in range(600))), (0x30, b"\x02\x01\x05"))
SSH = _field(b"ssh-rsa", b"\x01\x00\x01", bytes(i * 11 % 253 for i in range(256)))


def _lines(data, end="\n", width=64):
    text = base64.b64encode(data).decode()
    return end.join(text[i : i + width] for i in range(0, len(text), width))


def _armour(body, end="\n", label="RSA PRIVATE KEY"):
    return f"-----BEGIN {label}-----{end}{body}{end}-----END {label}-----"


@pytest.mark.parametrize("secret, kind", [
    (_armour(_lines(LONG)), "pem"), (_armour(_lines(LONG, "\\n"), "\\n"), "pem"), (_armour(_lines(LONG, "\\r\\n"), "\\r\\n"), "pem"),
    (_armour(_lines(LONG, "\\\\n").replace("/", "\\/"), "\\\\n"), "pem"),
    (_armour("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D4E5F60718293A4B5C6D7E8F9\n\n" + _lines(LONG[:608])), "pem"),
    (_armour("Comment: mine\n\n" + _lines(LONG)), "pem"),
    (_lines(LONG), "der"), (_lines(LONG, "\\n"), "der"), (_lines(LONG, "\r\n  "), "der"), (_lines(SSH, width=70), "ssh"),
    (_lines(b"openssh-key-v1\x00" + LONG, width=70), "ssh"),
])
def test_secrets_in_other_line_ends(secret, kind):
    for before, after in (("", ""), ("key: ", "\n"), ("x\n", "\n\nsome words after it"), ('{"k": "', '"}')):
        found = [s for s in secrets.spans(before + secret + after) if s[2] in ("pem", "der", "ssh")]
        assert found == [(len(before), len(before) + len(secret), kind)]


@pytest.mark.parametrize("data, kind", [(LONG, "der"), (KEY, "der"), (SSH, "ssh"), (b"openssh-key-v1\x00" + LONG, "ssh")])
def test_secrets_after_a_glued_start(data, kind):
    key = base64.b64encode(data).decode()
    for glue in ("/", "\\n", "home/keys/", "ab+"):
        found = [s for s in secrets.spans(f"see {glue}{key} end") if s[2] == kind]
        assert found == [(4 + len(glue), 4 + len(glue) + len(key), kind)]


def test_what_is_no_secret_in_lines():
    noise = np.random.default_rng(1).bytes(3000)
    for text in (_armour(_lines(LONG), label="CERTIFICATE"), _armour(_lines(noise)), _lines(noise), "A" * 20_000, "MII" * 5000, _armour("Proc-Type: 4\n\n" + _lines(noise)), "-----BEGIN RSA PRIVATE KEY-----\n" * 500):
        assert [s for s in secrets.spans(text) if s[2] in ("pem", "der", "ssh")] == []


def test_secret_digest(spark, odd, nothing):
    text = "É token = \"" + "0a" * 20 + "\" AKIA" + "Z" * 16
    row = secrets.digest(secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    base = "assign:2:51,hex:11:51,access:53:73"
    assert (row["n_assign"], row["n_access"], row["n_hex"], row["spans"]) == (1, 1, 1, base)
    assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    rows = secrets.digest(secrets.secret_spans(odd)).collect()
    assert len(rows) == odd.count() and {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.secret_spans(nothing).count() == 0
    assert secrets.digest(secrets.secret_spans(odd)).where(F.col("spans") != "").count() == 0
