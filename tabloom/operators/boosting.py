"""Gradient boosting on histograms of gradients, with trees grown by level or by best leaf.

Features are binned once, at quantiles, and kept as blocks of bytes. For each level of a round the
tasks sum gradient, second derivative and count by node, feature and bin; these sums, whose size
depends on the features alone, are added up by node, and the task that has a node's sums picks its
split: the driver gets one split per node. A feature has as many sums as it has bins. Of features with
two bins, like those of one-hot levels, only the cells in the second are visited; the first has the rest.
Several classes are boosted together: one tree per class and round, on the same passes.

Growth by leaf always splits the leaf that gains most until the leaves are used up. Which leaves that
will be isn't known in advance, but what a split would give is the same whenever it is made; so the
children of all promising leaves are summed in one pass and the order is played through afterwards.

A table that a single task can hold is boosted inside that task by the same steps, so that it needs no
job for each level; the trees are the same. That task keeps its rows sorted by node while a tree grows.

Row samples are drawn by block, round and seed, so a task that runs again draws the same rows.
"""

from __future__ import annotations

import heapq
import json
import math
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.trees import LEAF, FlatTree, predict

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

BINS = 256
SKETCH_ACCURACY = 10_000
SLOTS_PER_SCAN = 120  # above 128 groups Spark sorts where a sketch is aggregated
CELLS_PER_TASK = 1 << 23
MOST_KEPT = 1 << 24  # numbers in the sums that a task keeps of a round's nodes
LEAST_REST = 1e-3  # share of the sums it was taken from that a rest has at least
TASKS_IN_ONE = 8  # as many tasks' cells are boosted by a single one, which is faster than a job for each pass
BLOCK_ROWS = 1 << 16  # small blocks of a task are joined up to this
# rounds after which the blocks' scores are brought up to date and kept; trees grown by leaf take more passes
REFRESH, REFRESH_LEAVES = 10, 4
# Fixed value: hessians never fall below this.
LEAST_HESSIAN = 1e-16


@dataclass(frozen=True)
class Rules:
    """What a split must keep to and how it is rated."""

    l2: float = 0.0
    min_weight: float = 0.0  # of second derivatives on each side
    min_rows: int = 1
    unit_gain: bool = False  # rate splits by rows in place of second derivatives
    leaf_scale: float = 1.0


# ---------------------------------------------------------------- in tasks


class Layout:
    """Where the bins of some features lie among a node's sums, side by side.

    ``sizes`` are the bins of all features. ``cuts`` are the places of all bins but each feature's last.
    """

    def __init__(self, features: list[int], sizes: np.ndarray) -> None:
        own = sizes[features]
        self.features = features
        self.first = np.concatenate([[0], np.cumsum(own)])
        self.width = int(self.first[-1])
        self.many = np.flatnonzero(own > 2)
        self.few = np.flatnonzero(own <= 2)
        self.pairs = np.flatnonzero(own == 2)
        self.pair_of = np.full(len(sizes), len(self.pairs))  # of features that are no pair here: one more
        self.pair_of[np.asarray(features)[self.pairs]] = np.arange(len(self.pairs))
        is_cut = np.ones(self.width, bool)
        is_cut[self.first[1:] - 1] = False
        self.cuts = np.flatnonzero(is_cut)
        self.place = np.repeat(np.arange(len(features)), own)[self.cuts]

    def bins(self, j: int) -> slice:
        return slice(self.first[j], self.first[j + 1])


@dataclass
class Block:
    """Some rows: bins (features x rows), labels, scores (classes x rows) and the pieces it was joined from.

    A piece has a number that is its own, and its rows. ``ones`` are the features of the cells in the
    second of two bins, row by row, and where each row's begin.
    """

    bins: np.ndarray
    labels: np.ndarray
    scores: np.ndarray
    pieces: list[tuple[int, int]]
    ones: tuple[np.ndarray, np.ndarray]

    def ones_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of the rows' cells in the second of two bins, and how many each row has."""
        feature, first = self.ones
        same = len(feature) // (len(first) - 1)
        if same and (np.diff(first) == same).all():  # as with one-hot levels
            return feature.reshape(-1, same).take(rows, axis=0).ravel(), np.array([same])
        start = first[rows]
        n = first[rows + 1] - start
        before = np.cumsum(n) - n
        return feature[np.repeat(start - before, n) + np.arange(n.sum())], n


class Parted:
    """Rows of a block sorted by the nodes of a tree that grows; a node's rows lie side by side."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.span = rows, {0: (0, len(rows))}

    def follow(self, tree: "BinnedTree", bins: np.ndarray) -> None:
        """Part the rows of all nodes that were split since the last call."""
        for node, feature in enumerate(tree.feature):  # children come after their parents
            if feature != LEAF and tree.left[node] not in self.span:
                start, stop = self.span[node]
                rows = self.rows[start:stop]
                goes_left = bins[feature].take(rows) <= tree.cut[node]
                left, right = rows[goes_left], rows[~goes_left]
                middle = start + len(left)
                self.rows[start:middle], self.rows[middle:stop] = left, right
                self.span[tree.left[node]], self.span[tree.right[node]] = (start, middle), (middle, stop)

    def of(self, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some nodes, and each row's place among the nodes."""
        spans = [self.span[node] for node in nodes]
        return np.concatenate([self.rows[a:b] for a, b in spans]), np.repeat(np.arange(len(nodes)), [b - a for a, b in spans])


def _joined(pieces: Iterator[tuple[np.ndarray, np.ndarray, int]], start: np.ndarray, sizes: np.ndarray) -> Iterator[Block]:
    """Blocks of the pieces (bins, labels, number) of a task, which may be many and small."""
    pairs = np.flatnonzero(sizes == 2)

    def block(some):
        bins, labels = np.concatenate([b for b, _, _ in some], axis=1), np.concatenate([y for _, y, _ in some])
        feature, row = np.nonzero(bins[pairs])
        ones = (
            pairs[feature].astype(np.int32)[np.argsort(row, kind="stable")],
            np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(labels)))]))
        return Block(bins, labels, np.repeat(start[:, None], len(labels), axis=1), [(number, len(y)) for _, y, number in some], ones)

    some, rows = [], 0
    for piece in pieces:
        if some and rows + len(piece[1]) > BLOCK_ROWS:
            yield block(some)
            some, rows = [], 0
        some.append(piece)
        rows += len(piece[1])
    if some:
        yield block(some)


@dataclass
class BinnedTree:
    """A tree on bins; grows by ``split``."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    value: list[float]

    @classmethod
    def stump(cls) -> "BinnedTree":
        return cls([LEAF], [0], [0], [0], [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        left = len(self.feature)
        for name, more in (("feature", LEAF), ("cut", 0), ("left", 0), ("right", 0), ("value", 0.0)):
            getattr(self, name).extend([more, more])
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, left, left + 1
        return left, left + 1

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left, right = (np.array(a) for a in (self.feature, self.cut, self.left, self.right))
        node = np.zeros(bins.shape[1], np.int32)
        rows = np.flatnonzero(feature[node] != LEAF)
        while len(rows):  # only rows that aren't in a leaf yet go on
            at = node[rows]
            at = np.where(bins[feature[at], rows] <= cut[at], left[at], right[at])
            node[rows] = at
            rows = rows[feature[at] != LEAF]
        return node

    def values_of(self, bins: np.ndarray) -> np.ndarray:
        """The value of each row's leaf."""
        parted, values = Parted(np.arange(bins.shape[1])), np.empty(bins.shape[1])
        parted.follow(self, bins)
        for node, feature in enumerate(self.feature):
            if feature == LEAF:
                start, stop = parted.span[node]
                values[parted.rows[start:stop]] = self.value[node]
        return values


def derivatives(objective: str, labels: np.ndarray, scores: np.ndarray, hessian_scale: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, classes x rows."""
    if objective == "squared":
        return scores - labels, np.ones_like(scores)
    if objective == "logistic":
        p = 1 / (1 + np.exp(-scores))
        return p - labels, np.maximum(p * (1 - p), LEAST_HESSIAN)
    p = softmax(scores)
    hot = np.arange(len(scores))[:, None] == labels[None, :]
    return p - hot, np.maximum(hessian_scale * p * (1 - p), LEAST_HESSIAN)


def softmax(scores: np.ndarray) -> np.ndarray:
    """Along the first axis."""
    e = np.exp(scores - scores.max(axis=0))
    return e / e.sum(axis=0)


def _brought_up(block: Block, rounds: list[list[BinnedTree]]) -> np.ndarray:
    """The block's scores with the given rounds of trees added."""
    if not rounds:
        return block.scores
    scores = block.scores.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[k] += tree.values_of(block.bins)
    return scores


def _histograms(
    blocks: Iterator[Block], objective: str, hessian_scale: float, rounds: list[list[BinnedTree]],
    growing: list[BinnedTree], wanted: list[tuple[int, int]], layout: Layout, sample: float, seed: int, number: int, seen: dict | None = None,
) -> np.ndarray:
    """``wanted nodes x bins of the layout x 3``: sums of gradient, second derivative and rows.

    ``seen`` keeps what doesn't change within a round, and the rows by node, for its next pass.
    """
    total = np.zeros((3, len(wanted), layout.width))
    unit = objective == "squared"  # second derivatives are counts
    for place_of, block in enumerate(blocks):
        state = seen.get(place_of) if seen is not None else None
        if state is None:
            drawn = np.arange(len(block.labels))
            if sample < 1:
                drawn = np.flatnonzero(np.concatenate([np.random.default_rng([seed, number, own]).random(n) < sample for own, n in block.pieces]))
            g, h = derivatives(objective, block.labels, _brought_up(block, rounds), hessian_scale)
            state = g, h, [Parted(drawn.copy()) for _ in growing]
            if seen is not None:
                seen[place_of] = state
        g, h, parted = state
        for k, tree in enumerate(growing):
            mine = [(i, node) for i, (of, node) in enumerate(wanted) if of == k]
            if not mine:
                continue
            parted[k].follow(tree, block.bins)
            rows, at = parted[k].of([node for _, node in mine])
            slots, size, base = [i for i, _ in mine], len(mine), at * BINS
            weights = [(0, g[k].take(rows)), (2, None)] + ([] if unit else [(1, h[k].take(rows))])
            for j in layout.many:
                bins = layout.bins(j)
                code = base + block.bins[layout.features[j]].take(rows)
                for s, weight in weights:
                    total[s, slots, bins] += np.bincount(code, weight, size * BINS).reshape(size, BINS)[:, : bins.stop - bins.start]
            if not len(layout.few):
                continue
            n_pairs = len(layout.pairs)
            if n_pairs:
                feature, n = block.ones_of(rows)
                code = np.repeat(at * (n_pairs + 1), n) + layout.pair_of[feature]  # the last is of features left out
            for s, weight in weights:
                few = np.zeros((size, layout.width))
                few[:, layout.first[layout.few]] = np.bincount(at, weight, size)[:, None]
                if n_pairs:
                    ones = np.bincount(code, weight if weight is None else np.repeat(weight, n), size * (n_pairs + 1)).reshape(size, n_pairs + 1)[:, :-1]
                    second = layout.first[layout.pairs] + 1
                    few[:, second] = ones
                    few[:, second - 1] -= ones
                total[s, slots] += few
    if unit:
        total[1] = total[2]
    return np.ascontiguousarray(total.transpose(1, 2, 0))


def _refreshed(block: Block, rounds: list[list[BinnedTree]]) -> Block:
    return replace(block, scores=_brought_up(block, rounds))


def _ranges(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """By slot: whether all values are 0 or 1."""
    binary = np.ones(width, bool)
    for batch in batches:
        x = _matrix(batch, width)
        binary &= ((x == 0) | (x == 1)).all(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(binary)], names=["slot", "binary"])


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _binned(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bins.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary())], names=["bins", "labels"])


# ---------------------------------------------------------------- splits


@dataclass
class Split:
    """``left``: the sums of the rows that go there."""

    gain: float
    feature: int
    cut: int
    left: np.ndarray


def best_split(sums: np.ndarray, layout: Layout, rules: Rules) -> tuple[np.ndarray, Split | None]:
    """The total of a node's ``bins x 3`` and the split that gains most; on ties the first feature and cut.

    Sums differ in their last bits with the order of the tasks, so gains that come as near as that
    count as equal, and a rerun picks the same split.
    """
    total = sums[layout.bins(0)].sum(axis=0)
    if not len(layout.cuts):
        return total, None
    left = sums.copy()
    for j in layout.many:
        np.cumsum(sums[layout.bins(j)], axis=0, out=left[layout.bins(j)])
    left = left[layout.cuts]
    right = total - left

    def rated(part):
        weight = part[..., 2] if rules.unit_gain else part[..., 1]
        return part[..., 0] ** 2 / np.maximum(weight + rules.l2, LEAST_HESSIAN)

    gain = rated(left) + rated(right) - rated(total)
    allowed = np.ones(gain.shape, bool)
    for side in (left, right):
        allowed &= (side[..., 2] >= max(rules.min_rows, 1)) & (side[..., 1] >= rules.min_weight)
    gain = np.where(allowed, gain, -np.inf)
    most = float(gain.max())
    # below this share of the node's own rating a gain is rounding
    if not most > 1e-12 * max(float(rated(total)), 1e-300):
        return total, None
    at = int(np.argmax(gain >= most * (1 - 1e-9)))
    j = layout.place[at]
    return total, Split(float(gain[at]), layout.features[j], int(layout.cuts[at] - layout.first[j]), left[at])


class Growing:
    """A tree that grows: which nodes need sums, and what is done with them."""

    def __init__(self, rules: Rules, rate: float, depth: int, leaves: int | None) -> None:
        self.tree, self.rules, self.rate, self.depth, self.leaves = BinnedTree.stump(), rules, rate, depth, leaves
        self.level, self.sums, self.splits = {0: 0}, {}, {}
        self.children: dict[int, tuple[int, int]] = {}
        self.chosen: list[int] = []
        self.done = False

    def wanted(self) -> list[int]:
        """Nodes whose sums are needed next; none when the tree is grown."""
        if not self.sums:
            return [0]
        if self.leaves is None:
            fresh = [n for n in self.splits if self.splits[n] and n not in self.children and self.level[n] < self.depth]
            for n in fresh:
                self._open(n)
            # the last level needs no split, its totals follow from the level above
            return [c for n in fresh for c in self.children[n] if self.level[c] < self.depth]
        frontier = self._play()
        for n in frontier:
            self._open(n)
        return [c for n in frontier for c in self.children[n]]

    def _open(self, node: int) -> None:
        split = self.splits[node]
        self.children[node] = self.tree.split(node, split.feature, split.cut)
        for child in self.children[node]:
            self.level[child] = self.level[node] + 1

    def _play(self) -> list[int]:
        """Split best leaves first, as far as is known; then the leaves worth opening."""
        heap, self.chosen = [], []

        def push(node):
            if self.splits.get(node) and self.level[node] < self.depth:
                heapq.heappush(heap, (-self.splits[node].gain, node))

        push(0)
        room = self.leaves - 1
        while heap and room:
            if heap[0][1] not in self.children:
                return [node for _, node in heapq.nsmallest(room, heap) if node not in self.children]
            _, node = heapq.heappop(heap)
            self.chosen.append(node)
            room -= 1
            for child in self.children[node]:
                push(child)
        return []

    def take(self, node: int, total: np.ndarray, split: Split | None) -> None:
        self.sums[node], self.splits[node] = total, split

    def _total(self, node: int, parent: int | None, side: str) -> np.ndarray:
        if node in self.sums:
            return self.sums[node]
        left = self.splits[parent].left
        return left if side == "left" else self.sums[parent] - left

    def finish(self) -> tuple[BinnedTree, np.ndarray, np.ndarray]:
        """The grown tree with its leaf values, and the rows and gain of each node."""
        kept = set(self.children) if self.leaves is None else set(self.chosen)
        grown = BinnedTree.stump()
        cover, gain = [0.0], [0.0]
        waiting = [(0, 0, None, "left")]
        while waiting:
            old, new, parent, side = waiting.pop()
            g, h, n = self._total(old, parent, side)
            cover[new] = n
            if old in kept:
                split = self.splits[old]
                gain[new] = split.gain
                children = grown.split(new, split.feature, split.cut)
                cover += [0.0, 0.0]
                gain += [0.0, 0.0]
                waiting += [(c, d, old, s) for c, d, s in zip(self.children[old], children, ("left", "right"))]
            else:
                weight = h + self.rules.l2
                grown.value[new] = -self.rate * self.rules.leaf_scale * g / weight if weight > LEAST_HESSIAN else 0.0
        return grown, np.array(cover), np.array(gain)


# ---------------------------------------------------------------- rounds


@dataclass(frozen=True)
class Plan:
    """All settings of a fit."""

    objective: str
    hessian_scale: float
    rounds: int
    rate: float
    depth: int
    leaves: int | None
    rules: Rules
    row_share: float
    feature_share: float
    sizes: np.ndarray  # bins of each feature
    outputs: int
    seed: int

    @property
    def width(self) -> int:
        return len(self.sizes)


class Spread:
    """Blocks of many tasks: sums are added up and split among them, and scores are kept by the executors."""

    def __init__(self, blocks: RDD) -> None:
        self.blocks, self.older = blocks, None

    def splits(self, wanted: list, layout: Layout, rules: Rules, *args: Any) -> list[tuple[np.ndarray, Split | None]]:
        sums = self.blocks.mapPartitions(lambda it: enumerate(_histograms(it, *args)))
        parts = min(len(wanted), self.blocks.getNumPartitions())
        best = dict(sums.reduceByKey(np.add, parts).mapValues(lambda one: best_split(one, layout, rules)).collect())
        if self.older is not None:  # this pass has filled the newer one
            self.older.unpersist()
            self.older = None
        return [best[i] for i in range(len(wanted))]

    def refresh(self, rounds: list[list[BinnedTree]]) -> None:
        self.older = self.blocks
        self.blocks = self.older.map(lambda b: _refreshed(b, rounds)).persist(StorageLevel.MEMORY_AND_DISK)

    def refresh_after(self, plan: Plan) -> int:
        return REFRESH if plan.leaves is None else REFRESH_LEAVES

    def release(self) -> None:
        for blocks in (self.blocks, self.older):
            if blocks is not None:
                blocks.unpersist()


class Local:
    """Blocks of one task.

    Of two children only the one with fewer rows is summed, the other has the rest of its parent's sums.
    """

    def __init__(self, blocks: list[Block]) -> None:
        self.blocks, self.round, self.seen = blocks, None, {}
        self.sums: dict[tuple[int, int], np.ndarray] = {}  # of nodes whose children may be wanted
        self.most: dict[tuple[int, int], np.ndarray] = {}  # the largest sums that theirs were taken from

    def splits(self, wanted: list, layout: Layout, rules: Rules, *args: Any) -> list[tuple[np.ndarray, Split | None]]:
        if args[-1] != self.round:
            self.round, self.seen, self.sums, self.most = args[-1], {}, {}, {}
        found = self._sums(wanted, layout, *args)
        return [best_split(found[one], layout, rules) for one in wanted]

    def _sums(self, wanted: list, layout: Layout, objective: str, scale: float, rounds: list, growing: list[BinnedTree], _: list, *args: Any) -> dict:
        found = {}

        def summed(some: list) -> None:
            if some:
                found.update(zip(some, _histograms(iter(self.blocks), objective, scale, rounds, growing, some, *args, self.seen)))
                self.most.update((one, np.abs(found[one][:, :2]).max(axis=0)) for one in some)

        rest = self._larger(wanted, layout, growing)
        summed([one for one in wanted if one not in rest])
        for one, (parent, other) in rest.items():
            left = self.sums[parent] - found[other]
            left[left[:, 2] == 0] = 0
            # what is far smaller than the sums it was taken from would be rounding for the most part
            if (np.abs(left[:, :2]).max(axis=0) >= LEAST_REST * self.most[parent]).all():
                found[one], self.most[one] = left, self.most[parent]
        summed([one for one in rest if one not in found])
        for parent, _other in rest.values():
            del self.sums[parent]
        for one in wanted:
            if (len(self.sums) + 1) * found[one].size <= MOST_KEPT:
                self.sums[one] = found[one]
        return found

    def _larger(self, wanted: list, layout: Layout, growing: list[BinnedTree]) -> dict:
        """Of children whose parent's sums are known the larger ones, with the parent and the other child."""
        larger, among = {}, set(wanted)
        for k, tree in enumerate(growing):
            for node, feature in enumerate(tree.feature):
                if feature == LEAF or (k, node) not in self.sums or not {(k, tree.left[node]), (k, tree.right[node])} <= among:
                    continue
                rows = self.sums[k, node][layout.bins(layout.features.index(feature)), 2]
                pair = (k, tree.left[node]), (k, tree.right[node])
                small, large = pair if 2 * rows[: tree.cut[node] + 1].sum() <= rows.sum() else pair[::-1]
                larger[large] = (k, node), small
        return larger

    def refresh(self, rounds: list[list[BinnedTree]]) -> None:
        self.blocks = [_refreshed(b, rounds) for b in self.blocks]

    def refresh_after(self, plan: Plan) -> int:
        return 1


def grow(data: Spread | Local, plan: Plan) -> list[list[tuple[BinnedTree, np.ndarray, np.ndarray]]]:
    """For each round the trees of all classes, with the rows and gain of each node."""
    draw = np.random.default_rng(plan.seed)
    everything = list(range(plan.width))
    grown, fresh = [], 0
    for number in range(plan.rounds):
        features = everything
        if plan.feature_share < 1:
            features = sorted(draw.choice(plan.width, max(1, int(plan.feature_share * plan.width)), replace=False).tolist())
        layout = Layout(features, plan.sizes)
        trees = [Growing(plan.rules, plan.rate, plan.depth, plan.leaves) for _ in range(plan.outputs)]
        recent = [[tree for tree, _, _ in done] for done in grown[fresh:]]
        while wanted := [(k, node) for k, tree in enumerate(trees) for node in tree.wanted()]:
            found = data.splits(
                wanted, layout, plan.rules, plan.objective, plan.hessian_scale, recent, [t.tree for t in trees], wanted, layout,
                plan.row_share, plan.seed, number)
            for (k, node), (total, split) in zip(wanted, found):
                trees[k].take(node, total, split)
        grown.append([tree.finish() for tree in trees])
        if plan.row_share == 1 and len(features) == plan.width and all(len(tree.feature) == 1 for tree, _, _ in grown[-1]):
            break  # no split helps, now or later
        if len(grown) - fresh == data.refresh_after(plan) and number + 1 < plan.rounds:
            data.refresh([[tree for tree, _, _ in done] for done in grown[fresh:]])
            fresh = len(grown)
    return grown


# ---------------------------------------------------------------- estimator


class _BoostingParams(HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    objective = Param(Params._dummy(), "objective", "squared, logistic or softmax", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a tree that is added", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree grown best leaf first, 0: by level", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "penalty on leaf values", TypeConverters.toFloat)
    minWeight = Param(Params._dummy(), "minWeight", "second derivatives on each side of a split", TypeConverters.toFloat)
    minRows = Param(Params._dummy(), "minRows", "rows on each side of a split", TypeConverters.toInt)
    unitGain = Param(Params._dummy(), "unitGain", "rate splits by rows", TypeConverters.toBoolean)
    leafScale = Param(Params._dummy(), "leafScale", "factor of leaf values", TypeConverters.toFloat)
    hessianScale = Param(Params._dummy(), "hessianScale", "factor of softmax's second derivatives", TypeConverters.toFloat)
    rowShare = Param(Params._dummy(), "rowShare", "share of rows drawn for a round", TypeConverters.toFloat)
    featureShare = Param(Params._dummy(), "featureShare", "share of features drawn for a tree", TypeConverters.toFloat)

    def _defaults(self) -> None:
        self._setDefault(
            objective="squared", classes=2, rounds=100, rate=0.1, maxDepth=3, maxLeaves=0, l2=0.0, minWeight=0.0, minRows=1,
            unitGain=False, leafScale=1.0, hessianScale=1.0, rowShare=1.0, featureShare=1.0)


class HistogramBoosting(Estimator, _BoostingParams):
    """Fits ``features`` to ``label``: a number, 0/1, or the number of a class."""

    @keyword_only
    def __init__(
        self, *, objective="squared", classes=2, rounds=100, rate=0.1, maxDepth=3, maxLeaves=0, l2=0.0, minWeight=0.0,
        minRows=1, unitGain=False, leafScale=1.0, hessianScale=1.0, rowShare=1.0, featureShare=1.0, seed=42,
    ):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "HistogramBoostingModel":
        get = lambda name: self.getOrDefault(getattr(self, name))
        objective, n_classes = get("objective"), get("classes")
        outputs = n_classes if objective == "softmax" else 1
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
        # one row per class, whose names the caller has, or a single one
        facts = rows.groupBy(F.col("y") if objective != "squared" else F.lit(0.0).alias("y")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.max(F.size("x")).alias("width")).collect()
        if not facts:
            raise ValueError("no rows to learn from")
        n_rows, width = sum(r["n"] for r in facts), max(r["width"] for r in facts)
        start = self._start(objective, outputs, {int(r["y"]): r["n"] / n_rows for r in facts}, facts[0]["mean"])
        edges = bin_edges(rows, width)
        blocks = self._blocks(rows, edges, start, n_rows)
        plan = Plan(
            objective, get("hessianScale"), get("rounds"), get("rate"), get("maxDepth"), get("maxLeaves") or None,
            Rules(get("l2"), get("minWeight"), get("minRows"), get("unitGain"), get("leafScale")),
            get("rowShare"), get("featureShare"), _sizes(edges), outputs, self.getSeed())
        if blocks.getNumPartitions() == 1:
            # what a single task holds is grown inside it, by the same steps: a job for all rounds
            grown = blocks.mapPartitions(lambda it, p=plan: [grow(Local(list(it)), p)]).collect()[0]
        else:
            data = Spread(blocks)
            grown = grow(data, plan)
            data.release()
        model = HistogramBoostingModel()
        self._copyValues(model)
        flat = [
            {
                "output": k, "feature": tree.feature, "left": tree.left, "right": tree.right, "value": tree.value,
                "threshold": [float(edges[f][c]) if f != LEAF else 0.0 for f, c in zip(tree.feature, tree.cut)],
                "cover": cover.tolist(), "gain": gain.tolist(),
            }
            for done in grown for k, (tree, cover, gain) in enumerate(done)
        ]
        return model._set(trees=json.dumps(flat), start=start.tolist(), width=width)

    def _start(self, objective: str, outputs: int, shares: dict[int, float], mean: float) -> np.ndarray:
        """Scores before the first tree: the mean, or the classes' log-odds or logarithms."""
        if objective == "squared":
            return np.array([mean])
        tiny = 1e-15
        if objective == "logistic":
            p = min(max(shares.get(1, 0.0), tiny), 1 - tiny)
            return np.array([math.log(p / (1 - p))])
        return np.array([math.log(max(shares.get(k, 0.0), tiny)) for k in range(outputs)])

    def _blocks(self, rows: DataFrame, edges: list[np.ndarray], start: np.ndarray, n_rows: int) -> RDD:
        """The binned rows, kept on the executors; what is lost is computed anew from the table."""
        width, outputs = len(edges), len(start)

        sizes = _sizes(edges)

        def load(row) -> tuple[np.ndarray, np.ndarray, int]:
            labels = np.frombuffer(row["labels"])
            bins = np.frombuffer(row["bins"], np.uint8).reshape(width, len(labels))
            return bins, labels, zlib.crc32(row["labels"], zlib.crc32(row["bins"]))

        binned = rows.mapInArrow(lambda it: _binned(it, edges), "bins binary, labels binary")
        parts = math.ceil(n_rows * (width + 8 * outputs) / CELLS_PER_TASK)
        pieces = binned.rdd.map(load)
        tasks = 1 if parts <= TASKS_IN_ONE else parts
        if parts > 1 and (tasks == 1 or tasks > pieces.getNumPartitions()):
            # binned by many tasks; pieces come in any order, but are taken in the same
            pieces = pieces.coalesce(tasks, shuffle=True).mapPartitions(lambda it: sorted(it, key=lambda piece: piece[2]))
        loaded = pieces.coalesce(max(1, tasks)).mapPartitions(lambda it: _joined(iter(it), start, sizes))
        return loaded.persist(StorageLevel.MEMORY_AND_DISK) if tasks > 1 else loaded


def _sizes(edges: list[np.ndarray]) -> np.ndarray:
    return np.array([len(e) + 1 for e in edges], np.int64)


def bin_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Upper edges of all bins but the last of each slot of ``x``: one half for 0/1, else quantiles."""
    binary = dict(rows.select("x").mapInArrow(lambda it: _ranges(it, width), "slot int, binary boolean").groupBy("slot").agg(
        F.every("binary").alias("binary")).collect())
    edges = [np.array([0.5])] * width
    wanted = [j for j in range(width) if not binary.get(j, True)]
    marks = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    for at in range(0, len(wanted), SLOTS_PER_SCAN):
        some = wanted[at : at + SLOTS_PER_SCAN]
        cells = rows.select(F.inline(F.array(*[F.struct(F.lit(j).alias("slot"), F.get("x", F.lit(j)).alias("v")) for j in some])))
        found = cells.groupBy("slot").agg(
            F.percentile_approx("v", marks, F.lit(SKETCH_ACCURACY)).alias("marks"), F.max("v").alias("most")).collect()
        for row in found:
            values = np.unique(row["marks"])
            edges[row["slot"]] = values[values < row["most"]]
    return edges


class HistogramBoostingModel(Model, _BoostingParams):
    """Adds ``prediction``, and for classes ``rawPrediction`` and ``probability``."""

    trees = Param(Params._dummy(), "trees", "the trees as JSON", TypeConverters.toString)
    start = Param(Params._dummy(), "start", "scores before the first tree", TypeConverters.toListFloat)
    width = Param(Params._dummy(), "width", "number of features", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._defaults()

    def _stored(self) -> list[dict]:
        return json.loads(self.getOrDefault(self.trees))

    def flatTrees(self) -> list[FlatTree]:
        """The trees with their values in the column of their class."""
        outputs = len(self.getOrDefault(self.start))
        flat = []
        for t in self._stored():
            value = np.zeros((len(t["value"]), outputs))
            value[:, t["output"]] = t["value"]
            flat.append(FlatTree(
                np.array(t["feature"]), np.array(t["threshold"]), np.array(t["left"]), np.array(t["right"]), value,
                np.array(t["cover"])))
        return flat

    @property
    def leafCounts(self) -> list[int]:
        return [t["feature"].count(LEAF) for t in self._stored()]

    @property
    def featureImportances(self) -> DenseVector:
        """Each feature's share of all gains; growth by leaf counts splits instead."""
        total = np.zeros(self.getOrDefault(self.width))
        count = self.getOrDefault(self.maxLeaves) > 0
        for t in self._stored():
            for feature, gain in zip(t["feature"], t["gain"]):
                if feature != LEAF:
                    total[feature] += 1 if count else gain
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, start = self.flatTrees(), np.array(self.getOrDefault(self.start))
        objective, width = self.getOrDefault(self.objective), self.getOrDefault(self.width)

        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(start + predict(trees, np.stack(x.to_numpy()).reshape(len(x), width), len(start))))

        scorer = F.pandas_udf(score, "array<double>")
        scored = df.withColumn("__score", scorer(vector_to_array("features")))
        if objective == "squared":
            return scored.withColumn("prediction", F.get("__score", F.lit(0))).drop("__score")
        if objective == "logistic":
            margin = F.get("__score", F.lit(0))
            p = 1 / (1 + F.exp(-margin))
            raw, probability = F.array(-margin, margin), F.array(1 - p, p)
        else:
            top = F.array_max("__score")
            raised = F.transform("__score", lambda s: F.exp(s - top))
            total = F.aggregate(raised, F.lit(0.0), lambda a, b: a + b)
            raw, probability = F.col("__score"), F.transform(raised, lambda e: e / total)
        best = F.array_position(raw, F.array_max(raw)) - 1
        return scored.withColumns({
            "rawPrediction": array_to_vector(raw), "probability": array_to_vector(probability), "prediction": best.cast("double"),
        }).drop("__score")
