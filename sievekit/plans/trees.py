"""Tree learners on binned features: boosting of second and first order and a random forest.

Both grow on histograms. The features are cut into at most 256 bins once
(approximate quantiles, one pass) and the binned rows are written to the shared
folder. Nodes of many rows grow level by level, one job a level: every task
adds up its rows by (node, feature, bin), the sums meet by feature, and what
comes back is the best cut of each node. As soon as a node has ``LOCAL_ROWS``
rows or fewer, its rows are dealt to one task, which grows all that lies below
it in memory by the same rule. Boosting sums gradients and hessians of the
logistic loss; leaves are Newton steps with an L2 term. The forest sums
bootstrap weights, drawn by Poisson's law from a seeded hash of row and tree,
and grows many trees in one pass.

Sums are whole numbers (gradients in fixed point), so they depend neither on
the order in which tasks finish nor on where a node is grown; equal gains go to
the lower feature, then to the lower cut. The driver holds the trees and one
row per node and reducing task; a level of more than ``JOB_NODES`` nodes takes
several jobs. Margins of a boosted model are stored every ``REFRESH`` rounds, so a pass
evaluates few trees however many there are.

Where the session can run barrier stages, ``STAGE_TREES`` trees take one stage
instead: each of its tasks holds its share of the rows for the whole stage and
moves them down as nodes are split, sums of a level meet by feature through
files in the shared folder, and every task enters the same best cuts. Trees are
the same either way.
"""

from __future__ import annotations

import itertools
import json
import os
import pickle
import tempfile
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.types import DoubleType

from ..session import shared_path, written

BINS = 256               # bins of a feature, at most
SKETCH = 2048            # values of a feature that a task sends
SLOTS = 1 << 20          # stride of a node's number in keys
JOB_NODES = 4096         # nodes whose cuts one job finds
LOCAL_ROWS = 200_000     # rows of a node that one task grows to its end
REFRESH = 10             # rounds after which margins are stored
TREES_AT_ONCE = 50       # trees of a forest grown in one pass
STAGE_TREES = 50         # trees that one barrier stage grows
CREW_ROWS = 20_000       # rows for which a barrier stage gets one more task
BLOCK = 1 << 14          # rows whose sums are added at once
HELD_TREES = 1 << 23     # rows of a forest's trees that a task follows at once
ONE = 1 << 24            # fixed point of gradients; BLOCK hessians of a quarter stay below 1 << PACK
PACK = 37                # bits of the third sum where it shares a number with the first
DENSE = 1 << 22          # cells up to which sums are held as one array
LEAST_GAIN = 1e-6
BEST = ("slot int, gain double, feature int, cut int, n_left long, a_left long, b_left long, "
        "n_right long, a_right long, b_right long")


@dataclass
class Tree:
    """Nodes as columns; ``feature`` -1 marks a leaf. A row goes right if its
    bin is above ``cut``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    n: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0),
                              (self.n, 0)):
            column += [empty, empty]
        return self.left[node], self.right[node]

    def graft(self, node: int, below: dict) -> None:
        """Put a tree grown elsewhere in the place of a leaf."""
        base = len(self.feature) - 1  # its root becomes ``node``, its other nodes follow

        def place(i):
            return node if i == 0 else base + i

        for i in range(len(below["feature"])):
            inner = below["feature"][i] >= 0
            own = (below["feature"][i], below["cut"][i], place(below["left"][i]) if inner else 0,
                   place(below["right"][i]) if inner else 0, below["value"][i], below["n"][i])
            for column, x in zip((self.feature, self.cut, self.left, self.right, self.value, self.n), own):
                if i == 0:
                    column[node] = x
                else:
                    column.append(x)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int32), np.array(self.cut), np.array(self.left, np.int32),
                np.array(self.right, np.int32), np.array(self.value))


def descend(x: np.ndarray, tree) -> np.ndarray:
    """The node each row of ``x`` ends in."""
    feature, cut, left, right, _ = tree
    node, rows = np.zeros(len(x), np.int32), np.arange(len(x))
    while True:
        own = feature[node]
        inner = own >= 0
        if not inner.any():
            return node
        above = x[rows, np.maximum(own, 0)] > cut[node]
        node = np.where(inner, np.where(above, right[node], left[node]), node)


def margins(x: np.ndarray, trees) -> np.ndarray:
    out = np.zeros(len(x))
    for tree in trees:
        out += tree[4][descend(x, tree)]
    return out


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logistic loss, in fixed point."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - label) * ONE), np.rint(p * (1 - p) * ONE)


#: Poisson(1): chance of at most 0, 1, ... 12 draws.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 13)]))


def bootstrap(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the tree draws each row."""
    h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree) % (1 << 62))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), "right")


# --- one level ------------------------------------------------------------------------

def _add_up(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal keys become one, in key order."""
    if not len(keys):
        return keys, sums
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(sums, first, axis=0)


class Layout:
    """Where the bins of each feature lie in one row of cells.

    Rows are added up only where they are off the ``common`` bin of a feature;
    the sums of that one are those of the node less the others (``complete``).
    """

    def __init__(self, cuts: list[np.ndarray], common: np.ndarray | None = None):
        held = np.array([len(c) + 1 for c in cuts], np.int64)
        self.offset, self.width = np.cumsum(held) - held, int(held.sum())
        self.feature = np.repeat(np.arange(len(cuts), dtype=np.int64), held)
        self.bin = np.arange(self.width) - np.repeat(self.offset, held)
        self.common = np.zeros(len(cuts), np.uint8) if common is None else common.astype(np.uint8)

    def cells(self, bins: np.ndarray, slot: np.ndarray, features: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell (slot, feature, bin) of each feature that a row's node
        may use and where the row is off the common bin."""
        if features is None:
            row, f = np.nonzero(bins != self.common)
        else:
            own = features[slot]
            row, k = np.nonzero(np.take_along_axis(bins, own, axis=1) != self.common[own])
            f = own[row, k]
        return row, slot[row].astype(np.int64) * self.width + self.offset[f] + bins[row, f]

    def complete(self, cells: np.ndarray, sums: np.ndarray, totals: np.ndarray, features: np.ndarray | None):
        """Added-up, ordered cells and those of the common bins; ``totals`` by slot."""
        n_slots, n_features = len(totals), len(self.offset)
        others = np.zeros((n_slots * n_features, 3), np.int64)
        if len(cells):
            group = cells // self.width * n_features + self.feature[cells % self.width]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            others[group[first]] = np.add.reduceat(sums, first, axis=0)
        rest = totals[:, None, :] - others.reshape(n_slots, n_features, 3)
        some = rest[:, :, 0] > 0
        if features is not None:
            usable = np.zeros_like(some)
            usable[np.arange(n_slots)[:, None], features] = True
            some &= usable
        slot, f = np.nonzero(some)
        return (np.concatenate([cells, slot * self.width + self.offset[f] + self.common[f]]),
                np.concatenate([sums, rest[slot, f]]))

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """Cells as (feature, slot, bin) numbers."""
        slot, at = cells // self.width, cells % self.width
        return (self.feature[at] * SLOTS + slot) * BINS + self.bin[at]


def _sums(at: np.ndarray, size: int, *columns) -> np.ndarray:
    return np.stack([np.bincount(at, x, size).astype(np.int64) for x in columns], 1)


def _cell_sums(row: np.ndarray, cells: np.ndarray, size: int, n, a, b) -> tuple[np.ndarray, np.ndarray]:
    """The cells that occur among ``size`` possible ones, and the sums of their rows."""
    values = None
    if size > DENSE:
        values, cells = np.unique(cells, return_inverse=True)
        size = len(values)
    sums = _sums(cells, size, n[row], a[row], b[row])
    if values is None:
        values = np.flatnonzero(sums[:, 0])
        sums = sums[values]
    return values, sums


def _sum_rows(layout: Layout, n_features: int, n_slots: int, stats):
    """Map side: one row for each feature, with the sums over the task's rows.

    ``stats(bins, batch)`` yields (rows, n, a, b, slot, features). Few cells are
    held as one array, many as the ones that occur.
    """
    dense = n_slots * layout.width <= DENSE

    def run(batches):
        held = np.zeros((n_slots * layout.width if dense else 0, 3), np.int64)
        keys, sums = np.empty(0, np.int64), np.empty((0, 3), np.int64)
        totals, features = np.zeros((n_slots, 3), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
            for rows, n, a, b, slot, features in stats(bins, batch):
                totals += _sums(slot, n_slots, n, a, b)
                cells, more = _cell_sums(*layout.cells(bins[rows], slot, features), n_slots * layout.width, n, a, b)
                if dense:
                    held[cells] += more
                else:
                    keys, sums = _add_up(np.concatenate([keys, cells]), np.concatenate([sums, more]))
        if dense:
            keys = np.flatnonzero(held[:, 0])
            sums = held[keys]
        keys, sums = layout.complete(keys, sums, totals, features)
        keys, sums = _add_up(layout.keys(keys), sums)
        edges = np.searchsorted(keys, np.arange(n_features + 1, dtype=np.int64) * SLOTS * BINS)
        some = [f for f in range(n_features) if edges[f] < edges[f + 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([keys[edges[f]:edges[f + 1]].tobytes() for f in some], pa.binary()),
             pa.array([sums[edges[f]:edges[f + 1]].tobytes() for f in some], pa.binary())],
            names=["feature", "keys", "sums"])

    return run


def best_cuts(keys: np.ndarray, sums: np.ndarray, gain, allowed):
    """The best cut of each (feature, slot) of added-up, ordered cells."""
    group = keys // BINS
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    held = np.diff(np.append(first, len(keys)))
    run = np.cumsum(sums, axis=0)
    before = np.concatenate([np.zeros((1, 3), np.int64), run])[first]
    left = run - np.repeat(before, held, axis=0)
    total = left[first + held - 1]
    right = np.repeat(total, held, axis=0) - left
    gains = np.where(allowed(left) & allowed(right) & (right[:, 0] > 0), gain(left, right), -np.inf)
    top = np.maximum.reduceat(gains, first)
    at = np.flatnonzero(gains == np.repeat(top, held))
    at = at[np.append(True, group[at][1:] != group[at][:-1])]  # the lowest cut of equal ones
    return group[at] % SLOTS, top, group[at] // SLOTS, keys[at] % BINS, left[at], right[at]


def _choose(slot, top, feature, *rest):
    """Of the cuts of each slot the one of largest gain, then lowest feature."""
    order = np.lexsort((feature, -top, slot))
    order = order[np.append(True, slot[order][1:] != slot[order][:-1])]
    return [x[order] for x in (slot, top, feature, *rest)]


def level(binned: DataFrame, layout: Layout, n_slots: int, columns: list[str], stats, rule: "Rule") -> dict[int, tuple]:
    """slot → (gain, feature, cut, left sums, right sums); the sums of a node
    without an allowed cut are to be added."""

    def find(batches):
        keys, sums = [], []
        for batch in batches:
            keys += [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            sums += [np.frombuffer(x, np.int64).reshape(-1, 3) for x in batch.column(2).to_pylist()]
        if not keys:
            return
        slot, top, feature, cut, left, right = _choose(
            *best_cuts(*_add_up(np.concatenate(keys), np.concatenate(sums)), rule.gain, rule.allowed))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip((slot, top, feature, cut, *left.T, *right.T),
                                            [pa.int32(), pa.float64(), pa.int32(), pa.int32()] + [pa.int64()] * 6)],
            names=[c.split()[0] for c in BEST.split(", ")])

    n_features = len(layout.offset)
    sums = binned.select("bins", *columns).mapInArrow(
        _sum_rows(layout, n_features, n_slots, stats), "feature int, keys binary, sums binary")
    rows = sums.repartition("feature").mapInArrow(find, BEST).collect()  # a row per node and reducing task
    out: dict[int, tuple] = {}
    for r in sorted(rows, key=lambda r: (r.slot, -r.gain, r.feature)):
        out.setdefault(r.slot, (r.gain, r.feature, r.cut, (r.n_left, r.a_left, r.b_left), (r.n_right, r.a_right, r.b_right)))
    return out


# --- growing --------------------------------------------------------------------------

class Rule:
    """How trees grow: ``gain`` and ``allowed`` over sums (n, a, b) of cells,
    ``value`` of a leaf, ``may_split`` of a node, its ``features`` (None: all)."""

    depth: int

    def gain(self, left, right):
        raise NotImplementedError

    def allowed(self, sums):
        raise NotImplementedError

    def value(self, sums) -> float:
        raise NotImplementedError

    def may_split(self, sums) -> bool:
        raise NotImplementedError

    def features(self, tree: int, path: int, n_features: int):
        return None


def _settle(tree: Tree, node: int, path: int, best: tuple, rule: Rule) -> list[tuple[int, int, tuple]]:
    """Enter the best cut of a node; its children (node, path, sums) that may be split."""
    top, feature, cut, left, right = best
    if path == 1:
        total = tuple(x + y for x, y in zip(left, right))
        tree.value[node], tree.n[node] = rule.value(total), total[0]
        if not rule.may_split(total):
            return []
    if not top > LEAST_GAIN:
        return []
    out = []
    for side, (child, sums) in enumerate(zip(tree.split(node, feature, cut), (left, right))):
        tree.value[child], tree.n[child] = rule.value(sums), sums[0]
        if rule.may_split(sums):
            out.append((child, 2 * path + side, sums))
    return out


def _slot_features(rule: Rule, open_, n_features: int):
    """Features by slot for (tree, path) nodes, or None for all."""
    own = [rule.features(t, path, n_features) for t, path in open_]
    return None if not own or own[0] is None else np.stack(own)


def grow_local(bins, n, a, b, layout: Layout, rule: Rule, number: int, path: int, depth: int) -> Tree:
    """The tree below one node, from its rows in memory."""
    tree, open_ = Tree(), [(0, path)]
    total = (int(n.sum()), int(a.sum()), int(b.sum()))
    tree.value[0], tree.n[0] = rule.value(total), total[0]
    if not rule.may_split(total):
        return tree
    at = np.zeros(len(bins), np.int64)  # the node of each row that may still move
    for _ in range(depth):
        slots = np.full(len(tree.feature), -1)
        slots[[node for node, _ in open_]] = np.arange(len(open_))
        rows = np.flatnonzero(slots[at] >= 0)
        bins, n, a, b, at = bins[rows], n[rows], a[rows], b[rows], at[rows]
        slot, features = slots[at], _slot_features(rule, [(number, w) for _, w in open_], len(layout.offset))
        values, sums = _cell_sums(*layout.cells(bins, slot, features), len(open_) * layout.width, n, a, b)
        values, sums = layout.complete(values, sums, _sums(slot, len(open_), n, a, b), features)
        best = _choose(*best_cuts(*_add_up(layout.keys(values), sums), rule.gain, rule.allowed))
        following = []
        for s, top, feature, cut, left, right in zip(*best):
            node, own = open_[s]
            children = _settle(tree, node, own, (top, int(feature), int(cut), tuple(left.tolist()), tuple(right.tolist())), rule)
            following += [(child, w) for child, w, _ in children]
        open_ = following
        if not open_:
            break
        feature, cut, left, right, _ = tree.arrays()
        own = feature[at]
        above = bins[np.arange(len(bins)), np.maximum(own, 0)] > cut[at]
        at = np.where(own >= 0, np.where(above, right[at], left[at]), at)
    return tree


def _grow_rows(binned: DataFrame, layout: Layout, nodes, trees: dict, columns: list[str], weigh, rule: Rule) -> list:
    """The trees below (tree, node, path, depth left) nodes, each grown in one task."""
    n_features = len(layout.offset)
    slots = {t: np.full(len(trees[t].feature), -1, np.int64) for t, *_ in nodes}
    for i, (t, node, _, _) in enumerate(nodes):
        slots[t][node] = i
    known = [(t, trees[t].arrays(), own) for t, own in slots.items()]

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
            for t, arrays, own in known:
                n, a, b = weigh(bins, batch, t)
                slot = own[descend(bins, arrays)]
                rows = np.flatnonzero((slot >= 0) & (n > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot[rows]), batch.column(0).take(pa.array(rows)),
                     *[pa.array(x[rows].astype(np.int64)) for x in (n, a, b)]], names=["slot", "bins", "n", "a", "b"])

    def grow(table: pa.Table) -> pa.Table:
        i = table["slot"][0].as_py()
        t, _, path, depth = nodes[i]
        bins = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(len(table), n_features)
        below = grow_local(bins, *[table[c].to_numpy() for c in ("n", "a", "b")], layout, rule, t, path, depth)
        return pa.table({"slot": pa.array([i], pa.int64()), "tree": [json.dumps(below.__dict__)]})

    rows = binned.select("bins", *columns).mapInArrow(deal, "slot long, bins binary, n long, a long, b long")
    return rows.groupBy("slot").applyInArrow(grow, "slot long, tree string").collect()  # the nodes of the model


def grow_trees(binned: DataFrame, layout: Layout, numbers, rule: Rule, columns: list[str], weigh, n_rows: int) -> list[Tree]:
    """One tree for each number. ``weigh(bins, batch, number)`` gives (n, a, b)
    of the batch's rows; rows of n 0 are not in the tree."""
    trees = {t: Tree() for t in numbers}
    open_, local = [(t, 0, 1, n_rows) for t in numbers], []
    for depth in range(rule.depth):
        local += [(t, node, path, rule.depth - depth) for t, node, path, n in open_ if n <= LOCAL_ROWS]
        open_ = [o for o in open_ if o[3] > LOCAL_ROWS]
        following = []
        for at in range(0, len(open_), JOB_NODES):
            some = open_[at:at + JOB_NODES]
            slots = {t: np.full(len(trees[t].feature), -1, np.int64) for t, *_ in some}
            for slot, (t, node, _, _) in enumerate(some):
                slots[t][node] = slot
            features = _slot_features(rule, [(t, path) for t, _, path, _ in some], len(layout.offset))
            known = [(t, trees[t].arrays(), own) for t, own in slots.items()]

            def stats(bins, batch):
                for t, arrays, own in known:
                    n, a, b = weigh(bins, batch, t)
                    slot = own[descend(bins, arrays)]
                    rows = np.flatnonzero((slot >= 0) & (n > 0))
                    if len(rows):
                        yield rows, n[rows], a[rows], b[rows], slot[rows], features

            for slot, best in level(binned, layout, len(some), columns, stats, rule).items():
                t, node, path, _ = some[slot]
                following += [(t, child, w, sums[0]) for child, w, sums in _settle(trees[t], node, path, best, rule)]
        open_ = sorted(following)
        if not open_:
            break
    for at in range(0, len(local), JOB_NODES):
        some = local[at:at + JOB_NODES]
        found = {r.slot: json.loads(r.tree) for r in _grow_rows(binned, layout, some, trees, columns, weigh, rule)}
        for i, (t, node, _, _) in enumerate(some):  # in order, so that node numbers do not depend on the tasks
            if i in found:
                trees[t].graft(node, found[i])
    return list(trees.values())


# --- trees grown in one stage ------------------------------------------------------------

class Alone:
    """A stage of one task."""

    rank, size = 0, 1

    def exchange(self, parts: list[bytes]) -> list[bytes]:
        return parts

    def share(self, part: bytes) -> list[bytes]:
        return [part]


class Crew:
    """The tasks of a barrier stage. What they tell each other goes through two
    files a task, written in turn and waited for by their number (Spark's own
    barriers take a second each): a task writes number k + 1 when it has read
    number k of all, so all have read k - 1 and its file may be written again."""

    def __init__(self, folder: str):
        context = BarrierTaskContext.get()
        self.rank, self.size = context.partitionId(), len(context.getTaskInfos())
        self.folder = f"{folder}/{context.allGather(uuid.uuid4().hex)[0]}"  # another one for each attempt
        os.makedirs(self.folder, exist_ok=True)
        self.turn = 0

    def _told(self, parts: list[bytes], mine: int) -> list[bytes]:
        self.turn += 1
        ends = np.cumsum([0, *map(len, parts)])
        head = np.append(self.turn, ends).astype(np.int64).tobytes()
        path = f"{self.folder}/{self.rank}-{self.turn % 2}"
        with open(f"{path}.new", "wb") as f:
            f.write(head)
            f.writelines(parts)
        os.replace(f"{path}.new", path)
        return [self._heard(f"{self.folder}/{rank}-{self.turn % 2}", mine, len(head)) for rank in range(self.size)]

    def _heard(self, path: str, mine: int, n_head: int) -> bytes:
        for wait in (min(0.0002 * 1.1 ** i, 0.02) for i in itertools.count()):
            try:
                with open(path, "rb") as f:
                    head = np.frombuffer(f.read(n_head), np.int64)
                    if head[0] == self.turn:
                        f.seek(n_head + int(head[1 + mine]))
                        return f.read(int(head[2 + mine] - head[1 + mine]))
            except FileNotFoundError:
                pass
            time.sleep(wait)

    def exchange(self, parts: list[bytes]) -> list[bytes]:
        """Part i of every task, at task i."""
        return self._told(parts, self.rank)

    def share(self, part: bytes) -> list[bytes]:
        """The part of every task, at every task."""
        return self._told([part], 0)


def crew_size(spark, n_rows: int) -> int:
    """Tasks of a stage that grows trees of ``n_rows`` rows; 0 if they cannot
    run together or share no folder."""
    context = spark.sparkContext
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    inner = context._jsc.sc()
    slots = inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile())
    slots //= int(context.getLocalProperty(SIDE_BY_SIDE) or 1)
    size = max(1, min(slots, -(-n_rows // CREW_ROWS)))
    return size if size == 1 or _folder(shared_path(spark, "crew")) else 0


SIDE_BY_SIDE = "sievekit.fits.side_by_side"  # fits that share the session's slots


def _folder(path: str) -> str | None:
    """The path as tasks open it, if it is one of a mounted file system."""
    plain = "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in plain else plain


def in_one_stage(binned: DataFrame, columns: list[str], n_features: int, size: int, grow) -> list[Tree]:
    """The trees of ``grow(crew, bins, *columns)``, run by ``size`` tasks that hold the rows between them."""
    folder = _folder(shared_path(binned.sparkSession, "crew"))

    def run(batches):
        crew = Alone() if size == 1 else Crew(folder)
        with tempfile.TemporaryFile() as held:
            own = [[np.empty(0)] for _ in columns]
            for batch in batches:
                if batch.num_rows:
                    bins = batch.column(0)
                    ends = np.frombuffer(bins.buffers()[1], np.int32)[bins.offset:bins.offset + len(bins) + 1]
                    held.write(bins.buffers()[2][ends[0]:ends[-1]])
                    for i, to in enumerate(own):
                        to.append(batch.column(i + 1).to_numpy())
            held.flush()
            own = [np.concatenate(x[len(x) > 1:]) for x in own]
            bins = (np.asarray(np.memmap(held, np.uint8, "r", shape=(len(own[0]), n_features))) if len(own[0])
                    else np.empty((0, n_features), np.uint8))
            trees = grow(crew, bins, *own)
        if crew.rank == 0:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(trees)), pa.int32()),
                                              pa.array([json.dumps(t.__dict__) for t in trees], pa.string())],
                                             names=["i", "tree"])

    rows = binned.select("bins", *columns).repartition(size).mapInArrow(run, "i int, tree string", barrier=size > 1)
    return [Tree(**json.loads(r.tree)) for r in sorted(rows.collect(), key=lambda r: r.i)]  # the nodes of the model


def _block_cells(bins, slot, layout: Layout, features) -> tuple[np.ndarray, np.ndarray]:
    """As ``Layout.cells``."""
    if features is None:
        at = np.flatnonzero(bins != layout.common)
        row = at // bins.shape[1]
        return row, (slot * layout.width)[row] + layout.offset[at - row * bins.shape[1]] + bins.ravel()[at]
    return layout.cells(bins, slot, features)


def node_sums(bins, rows, slot, n, a, b, layout: Layout, n_slots: int, features) -> tuple[np.ndarray, np.ndarray]:
    """Ordered keys (feature, slot, bin) of a task's rows and their sums. Rows
    come by slot; ``n`` is 0 or 1, ``b`` from 0 to ONE / 4."""
    held, cells, sums = None, [np.empty(0, np.int64)], [np.empty((0, 3), np.int64)]
    if n_slots * layout.width <= DENSE // 4:
        held = np.zeros((n_slots * layout.width, 3), np.int64)
    totals = np.zeros((n_slots, 3), np.int64)
    for at in range(0, len(rows), BLOCK):
        own = slice(at, at + BLOCK)
        first, last = int(slot[own][0]), int(slot[own][-1])
        totals[first:last + 1] += _sums(slot[own] - first, last + 1 - first, n[own], a[own], b[own])
        row, cell = _block_cells(bins[rows[own]], slot[own] - first, layout,
                                 None if features is None else features[first:last + 1])
        size, where = (last + 1 - first) * layout.width, None
        if size > 4 * len(cell) + layout.width:
            where, cell = np.unique(cell, return_inverse=True)
            size = len(where)
        packed = np.bincount(cell, (n[own] * (1 << PACK) + b[own])[row], size).astype(np.int64)
        found = np.stack([packed >> PACK, np.bincount(cell, a[own][row], size).astype(np.int64),
                          packed & ((1 << PACK) - 1)], 1)
        if where is None and held is not None:
            held[first * layout.width:first * layout.width + size] += found
            continue
        if where is None:
            where = np.flatnonzero(found[:, 0])
            found = found[where]
        if held is not None:
            held[where + first * layout.width] += found
        else:
            cells.append(where + first * layout.width)
            sums.append(found)
    if held is not None:
        cells = np.flatnonzero(held[:, 0])
        sums = held[cells]
    else:
        cells, sums = _add_up(np.concatenate(cells), np.concatenate(sums))
    cells, sums = layout.complete(cells, sums, totals, features)
    return _add_up(layout.keys(cells), sums)


def _met(crew, keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all tasks over the features that this one answers for."""
    owner = keys // (SLOTS * BINS) % crew.size
    parts = [pickle.dumps((keys[owner == r], sums[owner == r])) for r in range(crew.size)]
    found = [pickle.loads(x) for x in crew.exchange(parts)]
    return _add_up(np.concatenate([k for k, _ in found]), np.concatenate([s for _, s in found]))


def _agreed(crew, keys: np.ndarray, sums: np.ndarray, rule: Rule) -> list:
    """(slot, best cut) of every slot, the same at all tasks."""
    mine = best_cuts(keys, sums, rule.gain, rule.allowed) if len(keys) else None
    found = [x for x in map(pickle.loads, crew.share(pickle.dumps(mine))) if x is not None]
    if not found:
        return []
    slot, top, feature, cut, left, right = _choose(*map(np.concatenate, zip(*found)))
    return list(zip(slot.tolist(), zip(top.tolist(), feature.tolist(), cut.tolist(), map(tuple, left.tolist()),
                                       map(tuple, right.tolist()))))


def _moved(bins, rows, node, tree: Tree) -> np.ndarray:
    """Nodes of the rows one level down; leaves stay."""
    feature, cut, left, right, _ = tree.arrays()
    own = feature[node]
    above = bins[rows, np.maximum(own, 0)] > cut[node]
    return np.where(own >= 0, np.where(above, right[node], left[node]), node)


def _slots(n_nodes: int, nodes) -> np.ndarray:
    out = np.full(n_nodes, -1, np.int64)
    out[nodes] = np.arange(len(nodes))
    return out


def grow_one(crew, bins, n, a, b, layout: Layout, rule: Rule) -> tuple[Tree, np.ndarray]:
    """A tree whose nodes may use all features, and the leaf of each row.

    Of two children the smaller one is summed; the other's sums are those of
    the node less these.
    """
    tree, rows, node = Tree(), np.arange(len(bins)), np.zeros(len(bins), np.int32)
    leaf = np.zeros(len(bins), np.int32)
    open_, summed, less = [(0, 1)], [0], []  # less: (open node, slot of its parent, the other child)
    keys = sums = None  # of the open nodes of the level above, by their slot
    for _ in range(rule.depth):
        slots, at = _slots(len(tree.feature), [v for v, _ in open_]), _slots(len(tree.feature), summed)
        own = at[node]
        some = np.flatnonzero(own >= 0)
        some = some[np.argsort(own[some], kind="stable")]
        r = rows[some]
        new, more = _met(crew, *node_sums(bins, r, own[some], n[r], a[r], b[r], layout, len(summed), None))
        slot = new // BINS % SLOTS
        to = slots[summed][slot]
        parts = [(new + (to - slot) * BINS, more, to >= 0)]
        if less:
            child, parent, other = map(np.array, zip(*less))
            from_ = np.full(len(summed), -1, np.int64)
            from_[at[other]] = slots[child]
            parts.append((new + (from_[slot] - slot) * BINS, -more, from_[slot] >= 0))
            old = keys // BINS % SLOTS
            from_ = np.full(int(max(old.max(initial=0), parent.max())) + 1, -1, np.int64)
            from_[parent] = slots[child]
            parts.append((keys + (from_[old] - old) * BINS, sums, from_[old] >= 0))
        keys, sums = _add_up(np.concatenate([k[w] for k, _, w in parts]), np.concatenate([s[w] for _, s, w in parts]))
        keys, sums = keys[sums[:, 0] > 0], sums[sums[:, 0] > 0]
        following, summed, less = [], [], []
        for slot, best in _agreed(crew, keys, sums, rule):
            v, path = open_[slot]
            children = _settle(tree, v, path, best, rule)
            if not children:
                continue
            following += [(c, w) for c, w, _ in children]
            small, large = sorted((tree.left[v], tree.right[v]), key=lambda c: tree.n[c])
            summed.append(small)
            if large in {c for c, *_ in children}:
                less.append((large, slot, small))
        node = _moved(bins, rows, node, tree)
        leaf[rows] = node
        open_ = following
        if not open_:
            break
        needed = np.zeros(len(tree.feature), bool)
        needed[[v for v, _ in open_]] = True
        needed[summed] = True
        stay = needed[node]
        rows, node = rows[stay], node[stay]
    return tree, leaf


def grow_several(crew, bins, layout: Layout, rule: Rule, numbers, weigh) -> list[Tree]:
    """Trees whose nodes use features of their own. ``weigh(number)`` gives
    (n, a, b) of all rows."""
    trees, held = {t: Tree() for t in numbers}, {}
    for t in numbers:
        n, a, b = weigh(t)
        rows = np.flatnonzero(n)
        held[t] = [rows.astype(np.int32), np.zeros(len(rows), np.int32), a[rows].astype(np.uint8), b[rows].astype(np.uint8)]
    open_ = [(t, 0, 1) for t in numbers]
    for _ in range(rule.depth):
        following = []
        for at in range(0, len(open_), JOB_NODES):
            some, by_tree = open_[at:at + JOB_NODES], {}
            for slot, (t, node, _) in enumerate(some):
                by_tree.setdefault(t, ([], []))[0].append(node)
                by_tree[t][1].append(slot)
            features = _slot_features(rule, [(t, path) for t, _, path in some], len(layout.offset))
            keys, sums = [np.empty(0, np.int64)], [np.empty((0, 3), np.int64)]
            for t, (nodes, slots) in by_tree.items():  # the slots of a tree follow each other
                rows, node, a, b = held[t]
                own = _slots(len(trees[t].feature), nodes)[node]
                order = np.flatnonzero(own >= 0)
                order = order[np.argsort(own[order], kind="stable")]
                k, s = node_sums(bins, rows[order], own[order], np.ones(len(order)), a[order].astype(float),
                                 b[order].astype(float), layout, len(nodes), None if features is None else features[slots])
                keys.append(k + slots[0] * BINS)
                sums.append(s)
            for slot, best in _agreed(crew, *_met(crew, np.concatenate(keys), np.concatenate(sums)), rule):
                t, node, path = some[slot]
                following += [(t, child, w) for child, w, _ in _settle(trees[t], node, path, best, rule)]
        open_ = sorted(following)
        if not open_:
            break
        for t, (rows, node, a, b) in held.items():
            node = _moved(bins, rows, node, trees[t])
            needed = np.zeros(len(trees[t].feature), bool)
            needed[[v for u, v, _ in open_ if u == t]] = True
            stay = needed[node]
            held[t] = [x[stay] for x in (rows, node, a, b)]
    return list(trees.values())


# --- binning --------------------------------------------------------------------------

def _condensed(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal values added up; if more than ``most`` remain, those at even ranks
    (the largest included), each with the counts since the one before."""
    values, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, counts, len(values))
    if len(values) <= most:
        return values, counts
    rank = np.cumsum(counts)
    keep = np.unique(np.searchsorted(rank, np.arange(1, most + 1) * (rank[-1] / most), "left").clip(max=len(values) - 1))
    return values[keep], np.diff(rank[keep], prepend=0)


def cut_points(train: DataFrame, n_features: int, features: str = "features") -> list[np.ndarray]:
    """Rising cut values of each feature, the largest value left out."""
    return sketched(train, n_features, features)[0]


def sketched(train: DataFrame, n_features: int, features: str = "features") -> tuple[list[np.ndarray], np.ndarray]:
    """The cut points, and the bin of each feature that holds most rows.

    One pass: a task sends at most ``SKETCH`` values of a feature with their
    counts, exact below that, and the sketches meet by feature.
    """

    def sketch(batches):
        held = [(np.empty(0), np.empty(0))] * n_features
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, n_features)
                held = [_condensed(np.append(v, x[:, i]), np.append(c, np.ones(len(x))), SKETCH)
                        for i, (v, c) in enumerate(held)]
        some = [i for i in range(n_features) if len(held[i][0])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), *[pa.array([held[i][k].tolist() for i in some], pa.list_(pa.float64()))
                                           for k in (0, 1)]], names=["feature", "v", "n"])

    def cuts(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for i, v, n in zip(*[c.to_pylist() for c in batch.columns]):
                old = held.get(i, ((), ()))
                held[i] = _condensed(np.append(old[0], v), np.append(old[1], n), 4 * SKETCH)
        out = []
        for i, (v, n) in held.items():
            rank = np.cumsum(n)
            at = np.searchsorted(rank, np.arange(1, BINS) * (rank[-1] / BINS), "left")
            found = np.unique(v[at][v[at] < v[-1]])
            out.append((i, found.tolist(), int(np.bincount(np.searchsorted(found, v, "left"), n).argmax())))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.float64())),
             pa.array([o[2] for o in out], pa.int32())], names=["feature", "cuts", "common"])

    x = train.select(vector_to_array(features).alias("x"))
    rows = (x.mapInArrow(sketch, "feature int, v array<double>, n array<double>").repartition("feature")
            .mapInArrow(cuts, "feature int, cuts array<double>, common int").collect())  # a row per feature
    found = {r.feature: (r.cuts, r.common) for r in rows}
    return ([np.array(found.get(i, ([], 0))[0], float) for i in range(n_features)],
            np.array([found.get(i, ([], 0))[1] for i in range(n_features)]))


def binned_rows(train: DataFrame, cuts: list[np.ndarray], features: str = "features") -> DataFrame:
    """(bins, label, row, margin), written once; ``row`` is a number of its own."""

    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in bins], pa.binary()), batch.column(1), batch.column(2),
                 pa.array(np.zeros(len(x)))], names=["bins", "label", "row", "margin"])

    rows = train.select(vector_to_array(features).alias("x"), F.col("label").cast("double"),
                        F.monotonically_increasing_id().alias("row"))
    return written(rows.mapInArrow(run, "bins binary, label double, row long, margin double"), "binned")


def _thresholds(tree: Tree, cuts: list[np.ndarray]) -> dict:
    """The tree on feature values instead of bins."""
    at = [float(cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
    return {"feature": tree.feature, "cut": at, "left": tree.left, "right": tree.right, "value": tree.value, "n": tree.n}


# --- boosting -------------------------------------------------------------------------

@dataclass(frozen=True)
class Boosting(Rule):
    rounds: int = 200
    depth: int = 10
    step: float = 0.1
    l2: float = 1.0
    least_hessian: float = 1.0

    def start(self, share: float) -> float:
        """The margin before the first tree, given the share of positives."""
        return 0.0

    def gain(self, left, right):
        def score(s):
            g, h = s[:, 1] / ONE, s[:, 2] / ONE
            return g * g / (h + self.l2)

        return (score(left) + score(right) - score(left + right)) / 2

    def allowed(self, sums):
        return sums[:, 2] >= int(self.least_hessian * ONE)

    def value(self, sums):
        return -self.step * (sums[1] / ONE) / (sums[2] / ONE + self.l2)

    def may_split(self, sums):
        return sums[0] >= 2 and sums[2] >= 2 * int(self.least_hessian * ONE)


@dataclass(frozen=True)
class GradientBoosting(Boosting):
    """First-order boosting: trees fit the residuals by least squares from the
    log-odds of the labels on, and leaves are Newton steps without an L2 term."""

    min_split: int = 2      # rows of a node that may be split
    min_leaf: int = 1       # rows of a leaf

    def start(self, share):
        eps = float(np.finfo(np.float32).eps)  # one class alone has no log-odds
        share = min(max(share, eps), 1 - eps)
        return float(np.log(share / (1 - share)))

    def gain(self, left, right):
        def score(s):
            g = s[:, 1] / ONE
            return g * g / np.maximum(s[:, 0], 1)

        return (score(left) + score(right) - score(left + right)) / 2

    def allowed(self, sums):
        return sums[:, 0] >= self.min_leaf

    def value(self, sums):
        return -self.step * sums[1] / sums[2] if sums[2] else 0.0

    def may_split(self, sums):
        return sums[0] >= self.min_split


def _prepared(train: DataFrame, features: str):
    first = train.select(vector_to_array(features).alias("x")).first()
    if first is None:
        raise ValueError("no training rows")
    cuts, common = sketched(train, len(first["x"]), features)
    binned = binned_rows(train, cuts, features)
    return cuts, Layout(cuts, common), binned, binned.count()


def fit_boosting(train: DataFrame, p: Boosting = Boosting(), features: str = "features") -> "TreeModel":
    """Boosted trees for the logistic loss; a start other than 0 is a tree of one leaf."""
    cuts, layout, binned, n_rows = _prepared(train, features)
    first = Tree(value=[p.start(binned.agg(F.avg("label")).first()[0])])
    begun = [first.arrays()] if first.value[0] else []
    trees, size = [_thresholds(first, cuts)] * len(begun), crew_size(train.sparkSession, n_rows)
    for at in range(0, p.rounds if size else 0, STAGE_TREES):
        def rounds(crew, bins, label, margin, n=min(STAGE_TREES, p.rounds - at), begun=tuple(begun)):
            out, margin = [], margin + margins(bins, begun)
            for _ in range(n):
                tree, leaf = grow_one(crew, bins, np.ones(len(bins)), *gradients(margin, label), layout, p)
                margin = margin + np.array(tree.value)[leaf]
                out.append(tree)
            return out

        grown = in_one_stage(binned, ["label", "margin"], len(cuts), size, rounds)
        trees += [_thresholds(t, cuts) for t in grown]
        if at + STAGE_TREES < p.rounds:
            binned, begun = _with_margins(binned, len(cuts), [*begun, *(t.arrays() for t in grown)]), []
    recent = begun
    for _ in range(0 if size else p.rounds):
        def weigh(bins, batch, _number, recent=tuple(recent)):
            g, h = gradients(batch.column(2).to_numpy() + margins(bins, recent), batch.column(1).to_numpy())
            return np.ones(len(g)), g, h

        [tree] = grow_trees(binned, layout, [0], p, ["label", "margin"], weigh, n_rows)
        trees.append(_thresholds(tree, cuts))
        recent.append(tree.arrays())
        if len(recent) >= REFRESH:
            binned, recent = _with_margins(binned, len(cuts), recent), []
    return TreeModel.of("boosting", trees, len(cuts))


def _with_margins(binned: DataFrame, n_features: int, recent) -> DataFrame:
    def run(batches):
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
            margin = batch.column(3).to_numpy() + margins(bins, recent)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin)], names=batch.schema.names)

    return written(binned.select("bins", "label", "row", "margin").mapInArrow(run, binned.schema), "margins")


# --- forest ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Forest(Rule):
    """a and b are the weight of a node and that of its positives."""

    trees: int = 200
    depth: int = 20
    min_split: int = 5      # rows of a node that may be split
    min_leaf: int = 2       # rows of a leaf
    seed: int = 42

    def gain(self, left, right):
        """Fall of the weighted Gini impurity."""
        def impurity(s):
            w, y = s[:, 1], s[:, 2]
            return 2.0 * y * (w - y) / np.maximum(w, 1)

        return impurity(left + right) - impurity(left) - impurity(right)

    def allowed(self, sums):
        return sums[:, 0] >= self.min_leaf

    def value(self, sums):
        return sums[2] / sums[1] if sums[1] else 0.0

    def may_split(self, sums):
        return sums[0] >= self.min_split and 0 < sums[2] < sums[1]

    def features(self, tree, path, n_features):
        k = max(1, int(n_features ** 0.5))
        return np.sort(np.random.default_rng([self.seed, tree, path]).choice(n_features, k, replace=False))


def fit_forest(train: DataFrame, p: Forest = Forest(), features: str = "features") -> "TreeModel":
    """Random forest: bootstrap rows per tree, sqrt(d) features per node."""
    cuts, layout, binned, n_rows = _prepared(train, features)
    trees, size = [], crew_size(train.sparkSession, n_rows)

    def drawn(row, label, number):
        times = bootstrap(row, number, p.seed).astype(np.float64)
        return np.minimum(times, 1), times, times * label

    def weigh(bins, batch, number):
        return drawn(batch.column(2).to_numpy(), batch.column(1).to_numpy(), number)

    if size:
        for at in range(0, p.trees, STAGE_TREES):
            def some(crew, bins, label, row, numbers=range(at, min(p.trees, at + STAGE_TREES))):
                row, out, together = row.astype(np.int64), [], max(1, HELD_TREES * size // n_rows)
                for i in range(0, len(numbers), together):
                    out += grow_several(crew, bins, layout, p, numbers[i:i + together],
                                        lambda number: drawn(row, label, number))
                return out

            trees += in_one_stage(binned, ["label", "row"], len(cuts), size, some)
    else:
        for at in range(0, p.trees, TREES_AT_ONCE):
            some = range(at, min(p.trees, at + TREES_AT_ONCE))
            trees += grow_trees(binned, layout, some, p, ["label", "row"], weigh, n_rows)
    return TreeModel.of("forest", [_thresholds(t, cuts) for t in trees], len(cuts))


# --- the model ------------------------------------------------------------------------

class TreeModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds probability and prediction columns; saved and loaded like any stage."""

    kind = Param(Params._dummy(), "kind", "boosting (margins) or forest (mean share)",
                 typeConverter=TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "the trees as JSON", typeConverter=TypeConverters.toString)
    numFeatures = Param(Params._dummy(), "numFeatures", "number of features", typeConverter=TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "features column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, kind="boosting", trees="[]", numFeatures=0, featuresCol="features"):
        super().__init__()
        self._setDefault(kind="boosting", trees="[]", numFeatures=0, featuresCol="features")
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, kind: str, trees: list[dict], n_features: int) -> "TreeModel":
        return cls(kind=kind, trees=json.dumps(trees, separators=(",", ":")), numFeatures=n_features)

    def tree_list(self) -> list[dict]:
        return json.loads(self.getOrDefault(self.trees))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class of each row of feature values."""
        trees = [(np.array(t["feature"], np.int32), np.array(t["cut"]), np.array(t["left"], np.int32),
                  np.array(t["right"], np.int32), np.array(t["value"])) for t in self.tree_list()]
        total = margins(x, trees)
        return 1 / (1 + np.exp(-total)) if self.getOrDefault(self.kind) == "boosting" else total / max(1, len(trees))

    def _transform(self, df: DataFrame) -> DataFrame:
        packed = df.sparkSession.sparkContext.broadcast((self.getOrDefault(self.kind), self.getOrDefault(self.trees)))

        def run(batches):
            kind, trees = packed.value
            model = None
            for xs in batches:
                arrays = model or [(np.array(t["feature"], np.int32), np.array(t["cut"]), np.array(t["left"], np.int32),
                                    np.array(t["right"], np.int32), np.array(t["value"])) for t in json.loads(trees)]
                model = arrays
                total = margins(np.stack(xs.to_numpy()), arrays) if len(xs) else np.empty(0)
                yield pd.Series(1 / (1 + np.exp(-total)) if kind == "boosting" else total / max(1, len(arrays)))

        p = F.pandas_udf(run, DoubleType(), PandasUDFType.SCALAR_ITER)(vector_to_array(self.getOrDefault(self.featuresCol)))
        scored = df.withColumn("_p", p)
        return (scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
                .withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p"))
