"""Documents packed into token sequences of a fixed size, each beside its lexical neighbours.

Documents are dealt to shards of bounded size. A shard's task builds an inverted BM25 index of its
documents; each document not used yet becomes a seed, and the index returns the unused documents that
share its weightiest tokens, best first. Those that fit fill the seed's window; the best that doesn't
fit is cut to close it, and its rest is the next seed. Documents longer than a window give whole
windows of their own first, so only their ends are packed. A shard's last window is cut into
sequences whose sizes are powers of two, so no sequence needs padding.

A null or empty text has the end token only. Repeated rows and repeated ids are documents of their
own. An empty table gives no rows; other columns are ignored. Recomputed tasks give the same
sequences, whatever order their rows arrive in.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

WINDOW, END = 2048, 1
SHARD_BYTES = 8 << 20  # text of a shard, on average
NEIGHBOURS = 32  # unused documents asked for at a time
QUERY_TOKENS = 32  # a seed's weightiest tokens, which the index is asked with
MOST_KNOWN, MOST_PIECES = 900_000, 300_000  # words and pieces whose ids a worker remembers
# fixed values: how the tokenizer cuts words into pieces
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TOGETHER = 256  # texts whose words are encoded together
STOP = b"\0"  # marks the end of a piece; pieces that hold it go to the tokenizer
LATIN_END = "\u0250"  # letters below are the same to every version of Unicode, and compose with nothing here
K1, B = 1.2, 0.75
SHAPE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Vocabulary:
    """The merges of a tokenizer's file in a form that encodes many pieces at once.

    Merging by the rank of the joined piece is quicker than by the rank of the pair, and the same
    where pairs are joined only as the file's merges have them. A token is always built as it is
    built from its own bytes alone, so trying that on every token tells which are safe for good;
    pieces with any other token are left to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + STOP * ends

        self.ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + STOP: 256 + b for b in range(1, 256)}
        pairs = {key: (key[:1], key[1:]) for key in self.ranks if len(key) == 2}
        for i, (left, right) in enumerate(model["merges"]):
            self.ranks[raw(left) + raw(right)] = 512 + i
            pairs[raw(left) + raw(right)] = raw(left), raw(right)
        size = max(self.ranks.values()) + 1
        self.ids, self.ends, self.safe = np.zeros(size, "<u4"), np.zeros(size, bool), np.zeros(size, bool)
        special = {t for t in model["vocab"] if any(c not in byte_of for c in t.removesuffix(suffix))}
        ids = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        for key, rank in self.ranks.items():
            self.ids[rank] = ids.get(key, 0)
            self.ends[rank] = key.endswith(STOP)
            self.safe[rank] = key in ids and self._built(key, pairs)

    def _built(self, key: bytes, pairs: dict[bytes, tuple[bytes, bytes]]) -> bool:
        """Whether merging ``key`` by ranks takes only the file's own pairs and ends in one token."""
        parts = [key[i : i + 1] for i in range(len(key))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1)]
            rank, i = min(ranked)
            if rank == math.inf or pairs.get(parts[i] + parts[i + 1]) != (parts[i], parts[i + 1]):
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True


class Tokens:
    """Ids of whole texts; words between ASCII white space are looked up, new ones are encoded together.

    White space ends a token of this tokenizer whatever surrounds it, so words can be taken singly.
    Words of Latin letters take the quick way; others, and texts that may hold a special token, go
    to the tokenizer itself.
    """

    def __init__(self, path: str, vocabulary: Vocabulary | None = None) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.marks = [t["content"].encode() for t in json.load(file)["added_tokens"]]
        self.vocabulary = vocabulary or Vocabulary(path)
        self.quick = tiktoken.Encoding("pieces", pat_str="[^ ]+", mergeable_ranks=self.vocabulary.ranks, special_tokens={})
        self.split = regex.compile(PIECES).findall
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.unsafe: set[str] = set()  # pieces for the tokenizer itself

    def _encode(self, words: list[str]) -> list[bytes]:
        done = self.whole.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in done]

    def _learn_pieces(self, pieces: list[str]) -> None:
        v = self.vocabulary
        ranks = np.array(self.quick.encode_ordinary("\0 ".join([*pieces, ""])), np.int64)
        body = v.ids[ranks].tobytes()
        ends = np.flatnonzero(v.ends[ranks]) + 1
        stops = (4 * ends).tolist()
        self.pieces.update(zip(pieces, [body[a:b] for a, b in zip([0, *stops], stops)]))
        if not v.safe[ranks].all():
            unsafe = np.diff(np.concatenate([[0], np.cumsum(~v.safe[ranks])[ends - 1]])) > 0
            self.unsafe.update(pieces[i] for i in np.flatnonzero(unsafe))

    def _learn(self, fresh: set[bytes]) -> None:
        if len(self.known) + len(fresh) > MOST_KNOWN:
            self.known.clear()
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
            self.unsafe.clear()
        words = list(fresh)
        # words hold no white space, and letters are lower-cased one by one where the quick way is taken
        texts = b" ".join(words).decode().lower().split(" ")
        alone, parts, slow = ([], []), [], []
        for word, text in zip(words, texts):
            if text.isalpha() and text.isascii():
                alone[0].append(word)
                alone[1].append(text)
            elif not text.isascii() and max(text) >= LATIN_END or "\0" in text:
                slow.append(word)
            else:
                parts.append((word, self.split(text)))
        pieces = self.pieces
        new = {p for p in alone[1] if p not in pieces}
        new.update(p for _, lot in parts for p in lot if p not in pieces)
        if new:
            self._learn_pieces(list(new))
        self.known.update(zip(alone[0], map(pieces.__getitem__, alone[1])))
        self.known.update((word, b"".join([pieces[p] for p in lot])) for word, lot in parts)
        if self.unsafe:
            slow += [word for word, text in zip(*alone) if text in self.unsafe]
            slow += [word for word, lot in parts if not self.unsafe.isdisjoint(lot)]
        if slow:
            self.known.update(zip(slow, self._encode([w.decode() for w in slow])))

    def ids(self, text: bytes) -> bytes:
        """The ids of a text as little-endian 32-bit numbers, without the end token."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """Of each text; new words of all of them are encoded together."""
        known = self.known
        lots = [
            None if any(mark in text for mark in self.marks) else (text.lower() if text.isascii() else text).split() for text in texts]
        new = {w for words in lots if words for w in words if w not in known}
        if new and len(new) <= MOST_KNOWN:
            self._learn(new)
        done = []
        for text, words in zip(texts, lots):
            try:
                done.append(self._encode([text.decode()])[0] if words is None else b"".join(map(known.__getitem__, words)))
            except KeyError:  # forgotten to make room, or more than there is room for
                missing = {w for w in words if w not in known}
                if len(missing) > MOST_KNOWN // 2:
                    done.append(self._encode([text.decode()])[0])
                else:
                    self._learn(set(words) if len(known) + len(missing) > MOST_KNOWN else missing)
                    done.append(b"".join(map(known.__getitem__, words)))
        return done


def tokens(path: str, vocabulary: Any) -> Tokens:
    """The worker's own tokenizer: kept on the library's module, words stay known from task to task."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_tabloom_known", {})
    if path not in kept:
        kept[path] = Tokens(path, vocabulary.value)  # a broadcast, read by the first task only
    return kept[path]


class Index:
    """An inverted BM25 index of a shard's documents."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        n = len(docs)
        sizes = np.array([len(d) for d in docs])
        lots = []
        for i, ids in enumerate(docs):
            seen, counts = np.unique(ids[:-1], return_counts=True)  # without the end token
            lots.append((seen.astype(np.int64), np.full(len(seen), i, np.int32), counts))
        empty = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
        terms, rows, tf = (np.concatenate(part) for part in zip(*(lots or empty)))
        self.starts = np.concatenate([[0], np.cumsum([len(lot[0]) for lot in lots])])
        df = np.bincount(terms) if len(terms) else np.zeros(0, np.int64)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(sizes.mean(), 1)) if n else np.zeros(0)
        self.weight = (idf[terms] * tf * (K1 + 1) / (tf + norm[rows])).astype(np.float32)
        self.terms = terms
        order = np.argsort(terms, kind="stable")
        self.rows, self.impact = rows[order], self.weight[order]
        self.ends = np.concatenate([[0], np.cumsum(df)])

    def query(self, doc: int, n: int) -> np.ndarray:
        """A document's weightiest tokens."""
        at = slice(self.starts[doc], self.starts[doc + 1])
        order = np.lexsort((self.terms[at], -self.weight[at]))[:n]
        return self.terms[at][order]

    def neighbours(self, doc: int, unused: np.ndarray, k: int) -> list[int]:
        """Unused documents by falling score, equal ones by number."""
        lists = [slice(self.ends[t], self.ends[t + 1]) for t in self.query(doc, QUERY_TOKENS)]
        if not lists:
            return []
        rows = np.concatenate([self.rows[at] for at in lists])
        impact = np.concatenate([self.impact[at] for at in lists])
        scores = np.bincount(rows, weights=impact, minlength=len(unused))
        scores[~unused] = 0
        found = np.flatnonzero(scores)
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
        return found[np.argsort(-scores[found], kind="stable")][:k].tolist()


def plan(docs: list[np.ndarray], window: int = WINDOW, neighbours: int = NEIGHBOURS) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(document, start, length)``: all of ``window`` tokens, the last ones powers of two."""
    sizes = [len(d) for d in docs]
    first = [size - size % window for size in sizes]  # where the part to be packed begins
    done = [[(d, at, window)] for d in range(len(docs)) for at in range(0, first[d], window)]
    unused = np.array([size % window > 0 for size in sizes], bool)
    if not unused.any():
        return done
    index = Index(docs)
    current: list[tuple[int, int, int]] = []
    space, following, seed = window, 0, None
    while True:
        if seed is None:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                break
            seed = following
            unused[seed] = False
        current.append((seed, first[seed], sizes[seed] - first[seed]))
        space -= sizes[seed] - first[seed]
        near = index.neighbours(seed, unused, neighbours) if space else []
        for d in near:
            if 0 < sizes[d] - first[d] <= space:
                unused[d] = False
                current.append((d, first[d], sizes[d] - first[d]))
                space -= sizes[d] - first[d]
        seed = None
        if space:
            rest = [d for d in near if unused[d]]
            if not rest:
                while following < len(docs) and not unused[following]:
                    following += 1
                rest = [following] if following < len(docs) else []
            if not rest:
                break
            cut = rest[0]
            unused[cut] = False
            if sizes[cut] - first[cut] > space:
                current.append((cut, first[cut], space))
                first[cut] += space
                space, seed = 0, cut
            else:  # no neighbour was left, so the next document is the seed of what remains
                seed = cut
                continue
        if not space:
            done.append(current)
            current, space = [], window
    left = window - space
    while left:  # the last window
        size = 1 << left.bit_length() - 1
        sequence, room = [], size
        while room:
            d, start, length = current.pop(0)
            taken = min(room, length)
            sequence.append((d, start, taken))
            room -= taken
            if taken < length:
                current.insert(0, (d, start + taken, length - taken))
        done.append(sequence)
        left -= size
    return done


def _pack(batches: Iterator[pa.RecordBatch], path: str, vocabulary: Any, window: int, neighbours: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    shard = context.partitionId() if context else 0
    encode, kind = None, None
    read: list[tuple[int, bool, Any, bytes]] = []
    for batch in batches:
        kind = batch.column(0).type
        encode = encode or tokens(path, vocabulary)
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            bodies = part.column(1).to_pylist()
            for doc_id, body, ids in zip(part.column(0).to_pylist(), bodies, encode.ids_of(bodies)):
                read.append((xxhash.xxh3_64_intdigest(body), doc_id is not None, doc_id, ids))
    if not read:
        return
    # rows arrive in any order; those equal in all of this are the same
    read.sort(key=lambda r: (r[0], r[1], r[2] if r[1] else 0, r[3]))
    docs = [np.append(np.frombuffer(ids, "<u4"), np.uint32(END)).astype("<u4") for *_, ids in read]
    pieces = []
    for number, sequence in enumerate(plan(docs, window, neighbours)):
        offset = 0
        for d, start, length in sequence:
            pieces.append((d, start, length, number, offset))
            offset += length
    for at in range(0, len(pieces), 1000):
        some = pieces[at : at + 1000]
        column = [np.array(x, np.int64) for x in zip(*some)]
        yield pa.RecordBatch.from_arrays([
            pa.array([read[d][2] for d in column[0]], kind), pa.array(column[1]), pa.array(column[2]),
            pa.array([docs[d][s : s + n].tobytes() for d, s, n, *_ in some], pa.binary()),
            pa.array(np.array([len(docs[d]) for d in column[0]], np.int64)),
            pa.array(column[3] + (shard << 32)), pa.array(column[4]),
        ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, neighbours: int = NEIGHBOURS, shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's little-endian 32-bit token ids, ``start`` its place in its document and
    ``offset`` that in its sequence. ``path`` names the tokenizer's file, which every executor has.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    dealt = rows.repartition(max(1, math.ceil(size / shard_bytes)))  # by count, so copies spread
    kind = rows.schema["doc_id"].dataType.simpleString()
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))  # a file's worth
    packed = dealt.mapInArrow(lambda it: _pack(it, path, vocabulary, window, neighbours), f"id {kind}, {SHAPE}")
    return packed.withColumnRenamed("id", id_col)
