"""Secret scans: patterns propose, structure confirms.

The base patterns are reported as they are. Runs of base64 and hex, PEM blocks and signed tokens
are candidates only: each is decoded and its structure parsed - nested lengths of a DER encoding,
length-prefixed fields of an SSH key, the JSON header of a signed token - before it is reported.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

# fixed values: the base patterns, as the contract has them
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, as shorter ones are dropped
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

# kinds in the order in which spans of equal start are listed
KINDS = ("assign", "access", "hex", "pem", "der", "hexder", "ssh", "jwt")

_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))++)-----END \1-----")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(?:[^-]|-(?!----))++-----END \1-----")
_ESCAPED = re.compile(r"\\+(?:[rnt]|$)", re.M)  # line ends of JSON, env files and source code
_HEADER = re.compile(r"^[ \t]*([A-Za-z][A-Za-z0-9-]*):.*$", re.M)
_NEXT = re.compile(r"(?:\\+r|\r)?(?:\\+n|\n)[ \t]*([A-Za-z0-9+/]+)(?![^\s\\=\"'])")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")

# fixed values: what SSH keys begin with
_SSH_NAMES = (b"ssh-", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")
_OPENSSH = b"openssh-key-v1\x00"
_DEPTH = 16
_MOST_ELEMENTS = 64

# fixed values: what keys begin with in base64, in a run that begins earlier or ends in a later line
_PREFIX = re.compile(r"MI[GHI]|MHcCAQ|MC4CAQ|AAAA|b3BlbnNzaC1rZXk")
_NESTED = (0x30, 0x31, 0xA0, 0xA1)


def _decode(text: str, alphabet: bytes | None = None) -> bytes | None:
    text = "".join(text.split()).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=alphabet, validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(data: bytes, depth: int = 0) -> list[tuple[int, int]] | None:
    """Tags and sizes of the DER elements that fill ``data`` exactly, nested ones checked too."""
    at, found = 0, []
    while at < len(data):
        if at + 2 > len(data) or depth > _DEPTH:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size = int.from_bytes(data[at : at + width], "big")
            if size < 0x80 or data[at] == 0:  # DER has one way to write a length
                return None
            at += width
        if at + size > len(data):
            return None
        if tag in _NESTED and _elements(data[at : at + size], depth + 1) is None:
            return None
        found.append((tag, size))
        at += size
    return found


def is_der(data: bytes | None) -> bool:
    """One sequence that begins with a version number, as private keys do, or with a sequence or number."""
    if not data or len(data) < 32 or data[0] != 0x30:
        return False
    outer = _elements(data)
    if not outer or len(outer) != 1:
        return False
    inner = _elements(data[len(data) - outer[0][1] :], 1)
    return bool(inner) and len(inner) > 1 and inner[0][0] in (0x02, 0x30)


def is_ssh(data: bytes | None) -> bool:
    """Length-prefixed fields that fill the data, the first a known algorithm; or a private key's magic."""
    if not data:
        return False
    if data.startswith(_OPENSSH):
        return True
    at, fields = 0, []
    while at < len(data):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > len(data):
            return False
        fields.append(data[at : at + size])
        at += size
    return len(fields) > 1 and fields[0].startswith(_SSH_NAMES)


def _is_pem(body: str) -> bool:
    """A key of DER or OpenSSH; an encrypted one can only be told by its header and whole cipher blocks."""
    body = _ESCAPED.sub("\n", body).replace("\\/", "/")
    headers = {m[1].lower() for m in _HEADER.finditer(body)}
    data = _decode(_HEADER.sub("", body))
    if data is None:
        return False
    if {"proc-type", "dek-info"} <= headers:
        return len(data) >= 32 and len(data) % 8 == 0
    return is_der(data) or data.startswith(_OPENSSH)


def _wrapped(text: str, start: int, end: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The run and the lines that go on with it, joined; and where each line ends in the joined run, and begins and ends in the text.

    Lines have the width of the second one, and a shorter one is the last.
    """
    parts, size, lines, width = [text[start:end]], end - start, [(end - start, start, end)], 0
    while m := _NEXT.match(text, end):
        if width and len(m[1]) > width:
            break
        parts.append(m[1])
        size, end = size + len(m[1]), m.end()
        lines.append((size, m.start(1), end))
        if len(m[1]) < max(width, 40):
            break
        width = width or len(m[1])
    return "".join(parts), lines


def _field_ends(joined: str, at: int) -> set[int]:
    """How many bytes the first fields fill, each read in place; SSH certificates have 14 fields."""
    size, found = 0, set()
    while len(found) < 32:
        head = _decode(joined[at + size // 3 * 4 : at + size // 3 * 4 + 8]) or b""
        head = head[size % 3 : size % 3 + 4]
        if len(head) < 4:
            break
        size += 4 + int.from_bytes(head, "big")
        if size > (len(joined) - at) * 3 // 4:
            break
        found.add(size)
    return found


def _may_be_der(joined: str, at: int, header: int, size: int) -> bool:
    """Whether the elements inside a sequence fill it, read by their lengths alone; only a few bytes of each are decoded."""
    place, end = header, header + size
    for n in range(_MOST_ELEMENTS):
        if place == end:
            return n > 1
        group = at + place // 3 * 4
        head = (_decode(joined[group : group + 12]) or b"")[place % 3 :]
        if len(head) < 2 or n == 0 and head[0] not in (0x02, 0x30):
            return False
        width = head[1] & 0x7F if head[1] & 0x80 else 0
        if width > 4 or len(head) < 2 + width:
            return False
        place += 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
        if place > end:
            return False
    return True


def _within(text: str, start: int, end: int) -> tuple[list[tuple[int, int, str]], int]:
    """Keys that begin inside a run, or inside the lines that go on with it; and from where lines are yet to be looked at.

    The last two lines may go on otherwise when seen from there, so they are left for later.
    """
    if not _PREFIX.search(text, start, end) and not _NEXT.match(text, end):
        return [], end
    found, done = [], 0
    joined, lines = _wrapped(text, start, end)
    later = lines[max(1, len(lines) - 2)][1] if len(lines) > 1 else end
    ends = [line[0] for line in lines]
    for m in _PREFIX.finditer(joined):
        at = m.start()
        line = bisect.bisect_right(ends, at)
        before = ends[line - 1] if line else 0
        if at < done or m.end() > ends[line] or line and lines[line][1] >= later:
            continue
        head = _decode(joined[at : at + 32]) or b""
        if head[:1] == b"0":
            width = head[1] & 0x7F if head[1] & 0x80 else 0
            size = int.from_bytes(head[2 : 2 + width], "big") if width else head[1]
            if not _may_be_der(joined, at, 2 + width, size):
                continue
            stops = [at + ((2 + width + size) * 4 + 2) // 3]
        elif head.startswith(_OPENSSH):
            stops = [ends[-1]]  # its first fields don't tell its end
        elif head[4:].startswith(_SSH_NAMES):
            sizes = _field_ends(joined, at)
            reached = {at + (size * 4 + 2) // 3: size for size in sizes}
            stops = [stop for stop in sorted(reached) if ends[bisect.bisect_left(ends, stop)] - stop < 3]
            stops = [ends[bisect.bisect_left(ends, stop)] for stop in stops]
            stops = [stop for stop in stops if (stop - at) * 3 // 4 in sizes]
        else:
            continue
        for stop in stops:
            data = _decode(joined[at:stop]) if stop <= len(joined) else None
            kind = "ssh" if is_ssh(data) else "der" if is_der(data) else None
            if kind:
                upto, _, place = lines[bisect.bisect_left(ends, stop)]
                last = place - (upto - stop)
                while stop == upto and last < len(text) and text[last] == "=" and last < place + 2:
                    last += 1
                found.append((lines[line][1] + at - before, last, kind))
                done = stop
                break
    return found, later


def is_signed_token(token: str) -> bool:
    """Header and payload are JSON objects, the header names an algorithm, and unless that is none there is a signature."""
    head, body, signature = token.split(".")
    try:
        header, payload = (json.loads(_decode(part, b"-_") or b"") for part in (head, body))
    except (ValueError, RecursionError):  # not JSON, or nested too deeply to be a token's
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    return bool(signature) or header["alg"].lower() == "none"


def spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in code points, by start and then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for m in _PEM.finditer(text):
        if _is_pem(m[2]):
            found.append((m.start(), m.end(), "pem"))
    armoured = [m.span() for m in _ARMOUR.finditer(text)]  # what is in one is judged as a whole
    armour_ends = [end for _, end in armoured]
    keys: set[tuple[int, int, str]] = set()
    upto = looked = 0
    for m in _BASE64.finditer(text):
        data = _decode(m[0])
        at = bisect.bisect_right(armour_ends, m.start())
        armour = at < len(armoured) and armoured[at][0] <= m.start()
        if is_ssh(data) and (armour or not data.startswith(_OPENSSH)):
            keys.add((m.start(), m.end(), "ssh"))
        elif is_der(data):
            keys.add((m.start(), m.end(), "der"))
        elif m.start() >= max(upto, looked) and not armour:
            more, looked = _within(text, m.start(), m.start() + len(m[0].rstrip("=")))
            keys.update(more)
            upto = max([upto, *[end for _, end, _ in more]])
    found += keys
    for m in _LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_der(bytes.fromhex(m[0])):
            found.append((m.start(), m.end(), "hexder"))
    found += [(m.start(), m.end(), "jwt") for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "spans array<struct<start: long, `end`: long, kind: string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    for batch in batches:
        rows = [[{"start": a, "end": b, "kind": k} for a, b, k in spans(text.as_py() or "")] for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and its spans, none for a null or clean text.

    Whole texts are scanned, each by the task that reads it; nothing is shuffled. Null ids stay
    null, repeated rows are scanned one by one, other columns don't matter, and an empty table
    gives an empty result. The id keeps its type.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    base = KINDS[:3]
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(listed(of_kind(*base)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
