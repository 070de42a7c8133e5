"""LM scoring: masked pseudo-likelihood of a bidirectional window network, written in numpy.

A token is the hash of a lower-cased word, one of 64,000. For each position the network adds up an
embedding of each of the four neighbours (two on either side, a table for each place), applies tanh,
and predicts the token from that in three steps: one of 20 groups, one of the group's 40 parts, and
one of the part's 80 tokens. The sum of the log-probabilities of all tokens, each given its
neighbours, is the document's score.

Training is one pass over the whole corpus. As in masked language models, in each document one
position in sixteen is masked and predicted, and so by sixteen masks in turn until every position
has been a target once. Texts are dealt by hash to copies of the same initial network, so many that
each reads about as many bytes; the copies are averaged, weighted by the positions they were trained
on. So what is gathered grows with the input, scores don't depend on the number of cores, and what
one machine holds doesn't grow: copies travel as blocks that are summed by many tasks, and the
driver gets their averages only.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

LEVELS = {"first": 20, "second": 40, "third": 80}  # choices of a step
TOKENS = math.prod(LEVELS.values())
WIDTH = 16
PLACES = (-2, -1, 1, 2)
SIDE = max(abs(p) for p in PLACES)
EDGE = TOKENS  # stands beyond either end of a text
MASKED = 16  # a mask hides one position in so many; so many masks hide all
BATCH = 1 << 14
RATE = 0.2
CHUNK = 1 << 16
BLOCK = 1 << 12
NEAR, NODES = 1 << 10, 32  # positions and nodes worked on together, so that the cache holds them
COPY_BYTES = 24 << 20  # of text that a copy is trained on, about
_CACHED = 1 << 19


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) % TOKENS
        if len(self) < _CACHED:  # only memory; the value is the same either way
            self[word] = value
        return value


def tokens(text: bytes | None, hashes: dict) -> np.ndarray:
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII blanks
    return np.fromiter(map(hashes.__getitem__, words), np.int32, len(words))


class Network:
    """All parameters in one vector, and views of it by name."""

    SHAPES = {
        "places": (len(PLACES), TOKENS + 1, WIDTH), "hidden": (WIDTH,),
        # a node for each choice before; the last weight is the bias
        "first": (1, 20, WIDTH + 1), "second": (20, 40, WIDTH + 1), "third": (800, 80, WIDTH + 1),
    }
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, values: np.ndarray):
        self.values, self.space = values, np.empty(0, values.dtype)
        at = 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, values[at : at + size].reshape(shape))
            at += size

    @classmethod
    def initial(cls, seed: int) -> Network:
        return cls(np.random.default_rng(seed).normal(0, 0.2, cls.SIZE).astype(np.float32))

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        """The hidden units, and a one for the bias."""
        total = self.places[0].take(context[0], axis=0)
        total += self.hidden
        for k in range(1, len(PLACES)):
            total += self.places[k].take(context[k], axis=0)
        hidden = np.ones((total.shape[0], WIDTH + 1), total.dtype)
        np.tanh(total, out=hidden[:, :WIDTH])
        return hidden

    def _room(self, rows: int, columns: int) -> np.ndarray:
        """The same memory at each call, as fresh pages cost as much as the sums."""
        if self.space.size < rows * columns:
            self.space = np.empty(rows * columns, self.values.dtype)
        return self.space[: rows * columns].reshape(rows, columns)

    def _logits(self, weights: np.ndarray, spans: list[tuple[int, int, int]], hidden: np.ndarray) -> np.ndarray:
        """Of each position's choices at one step; positions come sorted by node, only those of the spans are met."""
        begin, end = spans[0][1], spans[-1][2]
        out = self._room(end - begin, weights.shape[1])
        for node, a, b in spans:
            np.dot(hidden[a:b], weights[node].T, out=out[a - begin : b - begin])
        return out

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each position, in the order given. ``context`` has a row for each place."""
        order = _order(target)
        token, hidden = target[order], self._hidden(context[:, order])
        total = np.zeros(order.size)
        for name, node, choice in _steps(token):
            pieces = [(at, x, min(x + NEAR, b)) for at, a, b in _spans(node) for x in range(a, b, NEAR)]
            for spans in _near(pieces):
                some = slice(spans[0][1], spans[-1][2])
                logits = self._logits(getattr(self, name), spans, hidden)
                total[some] += logits.reshape(-1).take(_flat(logits, choice[some]))
                total[some] -= _exponentials(logits)[2]
        found = np.empty(order.size)
        found[order] = total
        return found

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the batch's negative log-probability, in the layout of the parameters."""
        slope = Network(np.zeros_like(self.values))
        for view, rows, sums in self.slopes(context, target):
            (slope.places[view] if isinstance(view, int) else getattr(slope, view))[rows] = sums
        return slope.values

    def slopes(self, context: np.ndarray, target: np.ndarray) -> Iterator[tuple[str | int, slice | np.ndarray, np.ndarray]]:
        """By name, or number of a place: parameters that the batch meets, and their slopes.

        They come a few nodes at a time, which stay in the cache, and aren't read again: they may be changed at once.
        """
        order = _order(target)
        context, token = context[:, order], target[order]
        hidden = self._hidden(context)
        back = np.zeros_like(hidden)
        for name, node, choice in _steps(token):
            weights = getattr(self, name)
            for spans in _near(_spans(node)):
                begin, end = spans[0][1], spans[-1][2]
                logits = self._logits(weights, spans, hidden)
                _, total, _ = _exponentials(logits, log=False)
                logits /= total
                logits.reshape(-1)[_flat(logits, choice[begin:end])] -= 1
                sums = np.empty((len(spans), *weights.shape[1:]), hidden.dtype)
                part = np.empty((end - begin, hidden.shape[1]), hidden.dtype)
                for i, (at, a, b) in enumerate(spans):
                    own = logits[a - begin : b - begin]
                    np.dot(own.T, hidden[a:b], out=sums[i])
                    np.dot(own, weights[at], out=part[a - begin : b - begin])
                back[begin:end] += part
                first, last = spans[0][0], spans[-1][0] + 1
                yield name, slice(first, last) if last - first == len(spans) else np.array([at for at, _, _ in spans]), sums
        back = back[:, :WIDTH] * (1 - hidden[:, :WIDTH] ** 2)
        yield "hidden", slice(0, WIDTH), back.sum(axis=0)
        for k, ids in enumerate(context):
            at = _order(ids)
            yield k, *_sums(ids[at], back.take(at, axis=0))


class Trainer:
    """Adagrad: each parameter's steps shrink with the slopes it has seen, so rare words keep learning."""

    def __init__(self, seed: int, rate: float):
        self.network, self.rate, self.seen = Network.initial(seed), np.float32(rate), 0
        self.squares = Network(np.full(Network.SIZE, 1e-3, np.float32))

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        """What the batch doesn't meet has no slope and stays as it is."""
        scale = np.sqrt(np.float32(target.size))
        for name, rows, sums in self.network.slopes(context, target):
            values, seen = ((n.places[name] if isinstance(name, int) else getattr(n, name)) for n in (self.network, self.squares))
            sums /= scale
            squares = sums * sums
            if isinstance(rows, slice):  # no copies
                seen = seen[rows]
                seen += squares
                np.sqrt(seen, out=squares)
            else:
                squares += seen.take(rows, axis=0)
                seen[rows] = squares
                np.sqrt(squares, out=squares)
            sums *= self.rate
            sums /= squares
            if isinstance(rows, slice):
                values[rows] -= sums
            else:
                values[rows] = values.take(rows, axis=0) - sums
        self.seen += target.size


def _steps(token: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each step its name, and each token's node and choice there."""
    rest = TOKENS
    for name, fan in LEVELS.items():
        rest //= fan
        prefix = token // rest
        yield name, prefix // fan, prefix % fan


def _order(ids: np.ndarray) -> np.ndarray:
    """Places of the ids in ascending order, equal ones as they come; short numbers are sorted by their digits."""
    return np.argsort(ids.astype(np.uint16), kind="stable")


def _near(spans: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Lots of spans with at most ``NEAR`` positions, or one span with more, and at most ``NODES`` spans."""
    begin = 0
    for i in range(1, len(spans) + 1):
        if i == len(spans) or spans[i][2] - spans[begin][1] > NEAR or i - begin == NODES:
            yield spans[begin:i]
            begin = i


def _spans(node: np.ndarray) -> list[tuple[int, int, int]]:
    """The nodes, which come sorted, and where the positions of each begin and end."""
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if node.size else np.zeros(0, np.int64)
    return list(zip(node[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), node.size]))


def _flat(logits: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Where each row's choice stands among all numbers."""
    return np.arange(0, logits.size, logits.shape[1]) + choice


def _sums(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, which come sorted, and the sum of the rows of each."""
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[starts], np.add.reduceat(rows, starts, axis=0)


def _exponentials(logits: np.ndarray, log: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of each row in proportion, in place; their sum; and, if asked for, the logarithm of the true sum."""
    most = 0
    if not -50 < logits.min() <= logits.max() < 50:  # else no sum leaves the range of a float
        most = logits.max(axis=1, keepdims=True)
        logits -= most
    np.exp(logits, out=logits)
    total = logits @ np.ones((logits.shape[1], 1), logits.dtype)
    return logits, total, (np.log(total) + most)[:, 0] if log else None


def _contexts(ids: np.ndarray, where: np.ndarray | slice) -> np.ndarray:
    """The neighbours of the given positions, a row for each place."""
    padded = _padded(ids)
    return np.stack([padded[SIDE + p : SIDE + p + ids.size][where] for p in PLACES])


def _padded(ids: np.ndarray) -> np.ndarray:
    padded = np.full(ids.size + 2 * SIDE, EDGE, np.int32)
    padded[SIDE : SIDE + ids.size] = ids
    return padded


def masked(ids: np.ndarray) -> np.ndarray:
    """Every position once, mask after mask: each hides one in ``MASKED``, the first from one that depends on the text."""
    first = int(ids[: MASKED * 2].sum())
    return np.concatenate([np.arange((first + k) % MASKED, ids.size, MASKED) for k in range(MASKED)])


def _train(texts: Iterator[bytes], seed: int, rate: float) -> Iterator[pa.RecordBatch]:
    trainer, hashes = Trainer(seed, rate), _Hashes()
    contexts, targets, held = [], [], 0
    for text in texts:
        ids = tokens(text, hashes)
        where, padded = masked(ids), _padded(ids)
        for at in range(0, where.size, BATCH):
            part = where[at : at + BATCH]
            contexts.append(np.stack([padded[part + (SIDE + p)] for p in PLACES]))
            targets.append(ids[part])
            held += part.size
            if held >= BATCH:
                trainer.step(np.concatenate(contexts, axis=1), np.concatenate(targets))
                contexts, targets, held = [], [], 0
    if held:
        trainer.step(np.concatenate(contexts, axis=1), np.concatenate(targets))
    if trainer.seen:
        yield from _blocks(trainer.network.values.astype(np.float64) * trainer.seen, trainer.seen)


def _train_copy(table: pa.Table, seed: int, rate: float) -> pa.Table:
    """One copy, on its texts in an order of their own."""
    table = table.sort_by([("place", "ascending"), ("text", "ascending")])
    done = list(_train((text.as_py() for text in table["text"]), seed, rate))
    return pa.Table.from_batches(done, schema=EMPTY)


def _blocks(values: np.ndarray, weight: float) -> Iterator[pa.RecordBatch]:
    starts = range(0, values.size, BLOCK)
    parts = pa.array([values[a : a + BLOCK].astype(np.float32) for a in starts], pa.list_(pa.float32()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(starts)), pa.int32()), pa.array([float(weight)] * len(starts)), parts], names=["block", "weight", "part"]
    )


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One running sum for each block met, so a task never holds more than one network."""
    sums: dict[int, tuple[float, np.ndarray]] = {}
    for batch in batches:
        for block, weight, part in zip(*(batch.column(i) for i in range(3))):
            values = part.values.to_numpy().astype(np.float64)
            old = sums.get(block.as_py(), (0.0, 0.0))
            sums[block.as_py()] = (old[0] + weight.as_py(), old[1] + values)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([w for w, _ in sums.values()]),
             pa.array([(v / w).astype(np.float32) for w, v in sums.values()], pa.list_(pa.float32()))],
            names=["block", "weight", "part"],
        )


SCHEMA = "block int, weight double, part array<float>"
EMPTY = pa.schema([("block", pa.int32()), ("weight", pa.float64()), ("part", pa.list_(pa.float32()))])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 4, rate: float = RATE, copy_bytes: int = COPY_BYTES) -> np.ndarray:
    """The averaged parameters, a fixed number of them; of a corpus without a word, the initial ones."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(body)), F.lit(0))).first()[0]
    copies = max(1, math.ceil(size / copy_bytes))
    place = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    texts = docs.select(F.pmod(F.shiftright(place, 8), F.lit(copies)).cast("int").alias("copy"), place.alias("place"), body.alias("text"))
    trained = texts.groupBy("copy").applyInArrow(lambda table: _train_copy(table, seed, rate), SCHEMA)
    mean = keep(trained.repartition("block").mapInArrow(_sum, SCHEMA), "network")
    parts = mean.orderBy("block").select("part").toArrow().column(0)
    return np.concatenate([c.flatten().to_numpy() for c in parts.chunks]) if len(parts) else Network.initial(seed).values


def _log_sums(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """The sum of each text's log-probabilities. Texts are scored together, long ones in pieces."""
    sums = np.zeros(len(texts))
    contexts, targets, owners, held = [], [], [], 0
    for i, ids in enumerate(texts):
        for at in range(0, ids.size, CHUNK):
            where = slice(at, at + CHUNK)
            contexts.append(_contexts(ids, where))
            targets.append(ids[where])
            owners.append(np.full(targets[-1].size, i))
            held += targets[-1].size
            if held >= CHUNK:
                sums += _summed(network, contexts, targets, owners, len(texts))
                contexts, targets, owners, held = [], [], [], 0
    return sums + _summed(network, contexts, targets, owners, len(texts)) if held else sums


def _summed(network: Network, contexts: list, targets: list, owners: list, n: int) -> np.ndarray:
    each = network.log_probabilities(np.concatenate(contexts, axis=1), np.concatenate(targets))
    return np.bincount(np.concatenate(owners), weights=each, minlength=n)


def _score(batches: Iterator[pa.RecordBatch], values: np.ndarray) -> Iterator[pa.RecordBatch]:
    network, hashes = Network(values), _Hashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            texts = [tokens(text.as_py(), hashes) for text in part.column(1)]
            sizes = pa.array([ids.size for ids in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(_log_sums(network, texts))], names=["doc_id", "n_tokens", "log_prob"])


def score(docs: DataFrame, values: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob`` of each row, under the given parameters.

    Null and blank texts have no tokens, a sum of zero and a null mean. Null ids stay null,
    repeated rows are scored one by one, other columns don't matter, an empty table gives none.
    Every token is predicted, in texts of any length, by pieces of bounded size.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(values)  # Network.SIZE numbers, whatever the corpus
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(lambda it: _score(it, shared.value), f"doc_id {kind}, n_tokens long, log_prob double")
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
