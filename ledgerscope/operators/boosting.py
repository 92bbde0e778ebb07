"""Boosted trees with monotone constraints on binned rows, several models at once.

Rows of equal values are one vector with its rows and events per part. The vectors are binned once and kept in blocks of at most BLOCK of them, a column of which is one array. A scan
grows one level of the next tree of every model: each task sums rows, gradients and curvatures per (model, leaf, feature, bin), and at most models * leaves * bins numbers a task
reach the driver, summed in Spark where there are many tasks. Of two children only the smaller is summed; the other is what is left of its parent. Models are fits without one part
of the rows each (the folds of a calibration) and the fit on all; they share the scans. A node carries bounds for its value: a split on a feature of a declared sign must keep that
order, and the middle of its two values becomes a bound of both sides, so the score never moves against a sign.

Blocks, the margins after every KEPT trees and the gradients of one tree are kept by the executors, in memory or on their disks, and made again from the stored vectors where an
executor is lost. Where all vectors, by their count, are no more than a task holds anyway (MOST), every model has a task of its own that runs the same scans over its blocks, without a
Spark job a level; the trees are the same. Gradients are summed as whole numbers of 2**-24 (exact while a block stands for fewer than 2**29 rows), so a re-run grows the same trees. Missing values count as
lowest. Ties go to the first feature and the lowest cut. With a patience, a model stops when the loss on its validation rows has not fallen for so many trees, and keeps the
trees up to the lowest loss; without one all trees are grown on all rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.operators import ranks
from ledgerscope.operators import trees as T
from ledgerscope.sources.scratch import settle

SCALE, KEPT, WIDTH = 1 << 24, 40, T.BINS + 1
#: Vectors of a block, of a task at most, and of a task at least where there are fewer tasks than cores.
BLOCK, MOST, LEAST = 1 << 14, 1 << 17, 1 << 11
#: Tasks whose sums the driver adds itself.
FEW_TASKS = 32
#: Multiplied by it, the 64 powers of two differ in their six highest bits.
DE_BRUIJN = 0x03F79D71B4CB0A89


@dataclass
class BoostedTree:
    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    bounds: list[tuple[float, float]] = field(default_factory=lambda: [(-math.inf, math.inf)])
    depth: int = 0

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            below = bins[row, feature[node]] <= cut[node]
            node = np.where(left[node] < 0, node, np.where(below, left[node], right[node]))
        return node

    def value_of(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.node_of(bins)]

    def ends(self) -> list[int]:
        return [node for node, left in enumerate(self.left) if left < 0]

    def split(self, node: int, found: Found, sign: int) -> tuple[int, int]:
        low, high = self.bounds[node]
        middle = (found.below + found.above) / 2
        first, second = (low, high), (low, high)
        if sign > 0:
            first, second = (low, middle), (middle, high)
        elif sign < 0:
            first, second = (middle, high), (low, middle)
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = found.feature, found.cut, at, at + 1
        for value, bounds in ((found.below, first), (found.above, second)):
            for column, v in zip((self.feature, self.cut, self.left, self.right, self.value, self.bounds), (0, 0, -1, -1, value, bounds)):
                column.append(v)
        return at, at + 1


class Word:
    """A few trees side by side in a 64-bit word, a bit per leaf: every feature's bin clears the leaves it rules out, one leaf of each tree is left."""

    def __init__(self, trees: list[BoostedTree]):
        self.reach: dict[int, np.ndarray] = {}
        self.lanes: list[tuple[int, int, np.ndarray]] = []
        at, self.start = 0, 0
        for tree in trees:
            ends = tree.ends()
            below = [0] * len(tree.left)
            node_at = np.zeros(64, np.int64)
            for i, node in enumerate(ends):
                below[node] = 1 << i
                node_at[(DE_BRUIJN << i) % (1 << 64) >> 58] = node
            for node in reversed(range(len(below))):
                if tree.left[node] >= 0:
                    below[node] = below[tree.left[node]] | below[tree.right[node]]
                    kept = self.reach.setdefault(tree.feature[node], np.full(256, (1 << 64) - 1, np.uint64))
                    kept[: tree.cut[node] + 1] &= np.uint64(~(below[tree.right[node]] << at) % (1 << 64))
                    kept[tree.cut[node] + 1 :] &= np.uint64(~(below[tree.left[node]] << at) % (1 << 64))
            self.lanes.append((at, (1 << len(ends)) - 1, node_at))
            self.start |= (1 << len(ends)) - 1 << at
            at += len(ends)

    def nodes(self, bins: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of every row, tree after tree, as its node."""
        for (_, _, node_at), place in zip(self.lanes, self.places(bins)):
            yield node_at[place]

    def values(self, bins: np.ndarray, trees: list[BoostedTree]) -> Iterator[np.ndarray]:
        for tree, (_, _, node_at), place in zip(trees, self.lanes, self.places(bins)):
            yield np.array(tree.value)[node_at][place]

    def places(self, bins: np.ndarray) -> Iterator[np.ndarray]:
        word = np.full(len(bins), self.start, np.uint64)
        for f, kept in self.reach.items():
            word &= kept[bins[:, f]]
        for at, lane, _ in self.lanes:
            yield ((word >> np.uint64(at) & np.uint64(lane)) * np.uint64(DE_BRUIJN) >> np.uint64(58)).astype(np.intp)


class Sums:
    """The values of many trees, packed once and added in their order."""

    def __init__(self, trees: list[BoostedTree]):
        self.packs: list[tuple[Word | None, list[BoostedTree]]] = []
        first = 0
        while first < len(trees):
            last, used = first, 0
            while last < len(trees) and used + len(trees[last].ends()) <= 64:
                used += len(trees[last].ends())
                last += 1
            # without a word: more leaves than bits
            self.packs.append((Word(trees[first:last]), trees[first:last]) if last > first else (None, [trees[first]]))
            first = max(last, first + 1)

    def of(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros(len(bins))
        for word, trees in self.packs:
            if word is None:
                total += trees[0].value_of(bins)
            else:
                for value in word.values(bins, trees):
                    total += value
        return total


def summed_values(trees: list[BoostedTree], bins: np.ndarray) -> np.ndarray:
    return Sums(trees).of(bins)


@dataclass
class Boosted:
    """cuts and trees; losses holds the mean validation loss before each tree (none without validation rows)."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    rate: float
    trees: list[BoostedTree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    stopped: bool = False

    def added(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """What the trees from the given one on add to the margin."""
        return self.rate * summed_values(self.trees[first:], bins)

    def bins_of(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), -np.inf, x)
        return np.stack([np.searchsorted(np.array(c), x[:, f], side="right") for f, c in enumerate(self.cuts)]).T

    @property
    def widths(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]

    def without_trees(self) -> Boosted:
        return Boosted(self.features, self.cuts, self.base, self.rate)

    def settle_on_best(self) -> None:
        if self.losses:
            del self.trees[int(np.argmin(self.losses)) :]
        self.stopped = True


@dataclass
class Found:
    gain: float
    feature: int
    cut: int
    below: float
    above: float


def best_split(sums: np.ndarray, allowed: np.ndarray, signs: np.ndarray, bounds: tuple[float, float], penalty: float, min_leaf: int) -> Found | None:
    """The split of the largest drop in loss; sums are rows, gradients and curvatures per feature and bin, values lie within the bounds."""
    left = sums.cumsum(axis=2)[:, :, :-1]
    whole = sums[:, int(allowed.argmax())].sum(axis=1)[:, None, None]
    right = whole - left

    def fitted(s):
        w = np.clip(-s[1] / (s[2] + penalty), *bounds)
        return w, s[1] * w + (s[2] + penalty) * w * w / 2

    (below, loss_below), (above, loss_above), (_, loss) = fitted(left), fitted(right), fitted(whole)
    good = (left[0] >= min_leaf) & (right[0] >= min_leaf) & allowed[:, None] & (signs[:, None] * (above - below) >= 0)
    gain = np.where(good, loss - loss_below - loss_above, -1.0)
    f, c = divmod(int(gain.argmax()), gain.shape[1])
    return Found(float(gain[f, c]), f, c, float(below[f, c]), float(above[f, c])) if gain[f, c] > 1e-9 else None


def share_of(keys: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """A number in [0, 1) per key and turn."""
    h = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + turn) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, mix in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mix)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def columns_of(features: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, f in enumerate(features)]


def cuts_of(vectors: DataFrame, n_features: int) -> list[list[float]]:
    """The exact BINS-quantiles of every feature over n rows a vector (x0, x1, ..., n); the values that hold one reach the driver."""
    long = vectors.select("n", F.posexplode(F.array(*[f"x{i}" for i in range(n_features)])).alias("f", "v")).filter("not isnan(v)")
    pos = ranks.positions(long, F.col("v"), ["f"], {"n": F.col("n")})
    h = lambda i: i / F.lit(float(T.BINS)) * (F.col("n_all") - 1).cast("double")
    inside = lambda rank: (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
    holds = F.exists(F.sequence(F.lit(1), F.lit(T.BINS)), lambda i: inside(F.floor(h(i))) | inside(F.ceil(h(i))))
    out: list[list[float]] = [[] for _ in range(n_features)]
    for f, own in pos.filter(holds).select("f", "value", "n_before", "n_all").toPandas().sort_values("value").groupby("f"):
        at = np.array([i / T.BINS for i in range(1, T.BINS + 1)]) * float(own["n_all"].iloc[0] - 1)
        low, high = (own["value"].to_numpy()[np.searchsorted(own["n_before"].to_numpy(), side(at), side="right") - 1] for side in (np.floor, np.ceil))
        out[f] = sorted({*(low + (high - low) * (at - np.floor(at))).tolist()})
    return out


class Block(NamedTuple):
    key: np.ndarray  # (vectors)
    rows: np.ndarray  # (groups, vectors): a group is a part, or the validation rows of one
    bad: np.ndarray  # (groups, vectors)
    bins: np.ndarray  # (features, vectors)
    margins: np.ndarray  # (models, vectors)


class Slopes(NamedTuple):
    block: Block  # without margins
    slopes: np.ndarray  # (models, vectors), of a row without its label, as a whole number of 1 / SCALE
    curves: np.ndarray
    losses: np.ndarray  # (models, 2): validation rows and their loss


def in_blocks(vectors: DataFrame, n_vectors: int, models: list[Boosted], n_groups: int) -> RDD:
    """Vectors (key, x0, x1, ..., n0, n1, ..., b0, b1, ...) as blocks, without margins."""
    width = len(models[0].features)
    names = [[f"{c}{i}" for i in range(k)] for c, k in (("x", width), ("n", n_groups), ("b", n_groups))]
    plain = models[0].without_trees()
    most = BLOCK

    def block(b: pd.DataFrame) -> dict:
        x, rows, bad = (b[c].to_numpy(t) for c, t in zip(names, (np.float64, np.int64, np.float64)))
        return {"key": b["key"].to_numpy(np.int64).tobytes(), "rows": rows.T.tobytes(), "bad": bad.T.tobytes(), "bins": plain.bins_of(x).T.astype(np.uint8).tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            while n >= most:
                whole = pd.concat(held, ignore_index=True)
                yield pd.DataFrame([block(whole[:most])])
                held, n = [whole[most:]], n - most
        if n:
            yield pd.DataFrame([block(pd.concat(held, ignore_index=True))])

    def unpacked(r) -> Block:
        rows, bad = (np.frombuffer(c, t).reshape(n_groups, -1) for c, t in ((r.rows, np.int64), (r.bad, np.float64)))
        return Block(np.frombuffer(r.key, np.int64), rows, bad, np.frombuffer(r.bins, np.uint8).reshape(width, -1), None)

    cores = vectors.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, n_vectors // LEAST), math.ceil(n_vectors / MOST))
    return vectors.repartition(tasks).mapInPandas(run, "key binary, rows binary, bad binary, bins binary").rdd.map(unpacked)


def own_part(b: Block, part: int | None, n_parts: int) -> Block:
    """The block as one model learns from it: all rows but those of its part, as one group (and one of validation rows)."""
    own = np.arange(n_parts + 1) != (-1 if part is None else part)
    return b._replace(**{c: np.stack([v[own].sum(axis=0) for v in np.split(getattr(b, c), len(b.rows) // (n_parts + 1))]) for c in ("rows", "bad")})


def with_margins(blocks: RDD, models: list[Boosted]) -> RDD:
    """Blocks with the margins of all trees so far."""
    fits = [(m.base, m.rate, list(m.trees)) for m in models]

    def run(own: Iterator[Block]) -> Iterator[Block]:
        sums = [(base, rate, Sums(trees)) for base, rate, trees in fits]
        for b in own:
            yield b._replace(margins=np.stack([base + rate * s.of(b.bins.T) for base, rate, s in sums]))

    return blocks.mapPartitions(run)


def with_slopes(blocks: RDD, models: list[Boosted], parts: list[int | None], kept: int, n_parts: int) -> RDD:
    """Slopes, curves and validation losses where the trees from number `kept` on are added to the margins."""
    fits = [(m.rate, m.trees[kept:]) for m in models]

    def run(own: Iterator[Block]) -> Iterator[Slopes]:
        sums = [(rate, Sums(trees)) for rate, trees in fits]
        for b in own:
            yield slopes_of(b, b.margins + np.stack([rate * s.of(b.bins.T) for rate, s in sums]), parts, n_parts)

    return blocks.mapPartitions(run)


def slopes_of(b: Block, z: np.ndarray, parts: list[int | None], n_parts: int) -> Slopes:
    p, learning = 1 / (1 + np.exp(-z)), n_parts + 1
    losses = np.zeros((len(z), 2), np.int64)
    if len(b.rows) > learning:
        for m, part in enumerate(parts):
            own = own_part(b, part, n_parts)
            losses[m] = own.rows[1].sum(), (own.rows[1] * np.rint(np.logaddexp(0, z[m]) * SCALE) - np.rint(own.bad[1] * np.rint(z[m] * SCALE))).sum()
    block = b._replace(rows=b.rows[:learning], bad=b.bad[:learning], margins=None)
    return Slopes(block, np.rint(p * SCALE).astype(np.int32), np.rint(p * (1 - p) * SCALE).astype(np.int32), losses)


def add_node_sums(b: Slopes, rows: np.ndarray, bad: np.ndarray, m: int, tree: BoostedTree, counted: list[int], columns: list[int], widths: list[int], total: np.ndarray) -> None:
    """Rows, slopes and curves per counted node, feature and bin; a feature of few bins takes few cells."""
    bins = b.block.bins
    if len(tree.left) == 1:
        here = np.flatnonzero(rows)
        slot = np.zeros(len(here), np.int64)
    else:
        slot = np.full(len(tree.left), -1)
        slot[counted] = np.arange(len(counted))
        slot = slot[next(Word([tree]).nodes(bins.T)) if len(tree.ends()) <= 64 else tree.node_of(bins.T)]
        here = np.flatnonzero((slot >= 0) & (rows > 0))
        slot = slot[here]
    n = rows[here].astype(np.float64)
    weights = n, n * b.slopes[m, here] - np.rint(bad[here] * SCALE), n * b.curves[m, here]
    at = 0
    for f in columns:
        cells, size = slot * widths[f] + bins[f, here], len(counted) * widths[f]
        for i, w in enumerate(weights):
            total[i, :, at : at + widths[f]] += np.bincount(cells, w, size).reshape(-1, widths[f]).astype(np.int64)
        at += widths[f]


def sums_of(blocks: Iterable[Slopes], parts: list[int | None], growing: dict[int, BoostedTree], counted: dict[int, list[int]], columns: dict[int, list[int]], widths: list[int],
            turn: int, row_share: float, seed: int) -> tuple[dict, np.ndarray]:
    """({model: sums}, losses) of a task."""
    totals = {m: np.zeros((3, len(nodes), sum(widths[f] for f in columns[m])), np.int64) for m, nodes in counted.items() if nodes}
    losses = np.zeros((len(parts), 2), np.int64)
    for b in blocks:
        losses += b.losses
        rows, bad = b.block.rows, b.block.bad
        if row_share < 1:
            learning = share_of(b.block.key, turn, seed) < row_share
            rows, bad = rows * learning, bad * learning
        all_rows, all_bad = rows.sum(axis=0), bad.sum(axis=0)
        for m, total in totals.items():
            part = parts[m]
            own = (all_rows, all_bad) if part is None else (all_rows - rows[part], all_bad - bad[part])
            add_node_sums(b, *own, m, growing[m], counted[m], columns[m], widths, total)
    return totals, losses


def per_node(totals: dict, losses: np.ndarray, counted: dict[int, list[int]], columns: dict[int, list[int]], widths: list[int]) -> tuple[dict, dict]:
    """({(model, node): rows, gradients and curvatures per feature and bin}, {model: (rows, loss)})."""
    found: dict = {}
    for m, own in totals.items():
        for i, node in enumerate(counted[m]):
            if own[0, i].any():
                at, start = np.zeros((3, len(widths), WIDTH)), 0
                for f in columns[m]:
                    at[:, f, : widths[f]] = own[:, i, start : start + widths[f]]
                    start += widths[f]
                at[1:] /= SCALE
                found[m, node] = at
    return found, {m: (int(n), loss / SCALE) for m, (n, loss) in enumerate(losses)}


def level_sums(data: RDD, models: list[Boosted], parts: list[int | None], growing: dict[int, BoostedTree], counted: dict[int, list[int]], columns: dict[int, list[int]],
               turn: int, row_share: float, seed: int) -> tuple[dict, dict]:
    """Sums of the counted nodes of the growing trees, and losses, in one scan."""
    widths = models[0].widths

    def both(a: tuple[dict, np.ndarray], b: tuple[dict, np.ndarray]) -> tuple[dict, np.ndarray]:
        return {m: own + b[0][m] for m, own in a[0].items()}, a[1] + b[1]

    sent = data.mapPartitions(lambda blocks: [sums_of(blocks, parts, growing, counted, columns, widths, turn, row_share, seed)])
    totals, losses = functools.reduce(both, sent.collect()) if data.getNumPartitions() <= FEW_TASKS else sent.treeReduce(both)
    return per_node(totals, losses, counted, columns, widths)


class Scans:
    """The blocks of all models as the executors keep them."""

    def __init__(self, blocks: RDD, models: list[Boosted], parts: list[int | None], n_parts: int):
        self.blocks, self.models, self.parts, self.n_parts = blocks.persist(StorageLevel.MEMORY_AND_DISK), models, parts, n_parts
        self.kept, self.old = 0, []
        self.margins = with_margins(self.blocks, models).persist(StorageLevel.MEMORY_AND_DISK)
        self.data: RDD | None = None

    def start(self, turn: int) -> None:
        if turn - self.kept == KEPT:
            self.old, self.kept = [self.margins], turn
            self.margins = with_margins(self.blocks, self.models).persist(StorageLevel.MEMORY_AND_DISK)
        self.old += [self.data] if self.data else []
        self.data = with_slopes(self.margins, self.models, self.parts, self.kept, self.n_parts).persist(StorageLevel.MEMORY_AND_DISK)

    def level(self, growing: dict[int, BoostedTree], counted: dict, columns: dict, turn: int, row_share: float, seed: int) -> tuple[dict, dict]:
        out = level_sums(self.data, self.models, self.parts, growing, counted, columns, turn, row_share, seed)
        while self.old:  # what is kept in its place was made by this scan
            self.old.pop().unpersist()
        return out

    def end(self) -> None:
        for rdd in (self.blocks, self.margins, self.data):
            if rdd is not None:
                rdd.unpersist()


class OwnBlocks:
    """The blocks of one model inside its task; margins are added up in the order of Scans."""

    def __init__(self, blocks: list[Block], model: Boosted):
        self.model, self.kept, self.data = model, 0, []
        self.held = [(b, *(np.full(len(b.key), v) for v in (0.0, 0.0, model.base))) for b in blocks]  # block, all trees, trees since the kept margins, those

    def start(self, turn: int) -> None:
        if turn:
            tree = self.model.trees[-1:]
            for b, all_trees, since, _ in self.held:
                value = Sums(tree).of(b.bins.T)
                all_trees += value
                since += value
        if turn - self.kept == KEPT:
            self.kept = turn
            for _, all_trees, since, margins in self.held:
                margins[:] = self.model.base + self.model.rate * all_trees
                since[:] = 0
        self.data = [slopes_of(b, (margins + self.model.rate * since)[None], [None], 0) for b, _, since, margins in self.held]

    def level(self, growing: dict[int, BoostedTree], counted: dict, columns: dict, turn: int, row_share: float, seed: int) -> tuple[dict, dict]:
        widths = self.model.widths
        return per_node(*sums_of(self.data, [None], growing, counted, columns, widths, turn, row_share, seed), counted, columns, widths)


def grow(models: list[Boosted], scans: Scans | OwnBlocks, order: np.ndarray, trees: int, leaves: int, min_leaf: int, row_share: float, column_share: float, patience: int | None,
         penalty: float, seed: int) -> None:
    """All trees of the models, a level a scan."""
    width = len(order)
    some = max(1, math.ceil(column_share * width))
    for turn in range(trees + (patience is not None)):
        growing = {m: BoostedTree() for m, model in enumerate(models) if not model.stopped}
        if not growing:
            break
        scans.start(turn)
        fresh = {m: [0] if turn < trees else [] for m in growing}
        drawn = {m: sorted(np.random.default_rng([seed, turn]).permutation(width)[:some].tolist()) for m in growing}
        with_loss = patience is not None
        siblings: dict[int, dict[int, tuple[int, np.ndarray]]] = {m: {} for m in growing}  # node: (the counted child beside it, sums of their parent)
        while any(fresh.values()) or with_loss and growing:
            counted = {m: [at for at in nodes if at not in siblings[m]] for m, nodes in fresh.items()}
            found, losses = scans.level(growing, counted, drawn, turn, row_share, seed)
            for m in [m for m in growing if with_loss and losses[m][0]]:
                own, (n, loss) = models[m], losses[m]
                own.losses.append(loss / n)
                if turn - int(np.argmin(own.losses)) >= patience:
                    own.settle_on_best()
                    del growing[m], fresh[m]
            with_loss = False
            for m, tree in growing.items():
                allowed = np.isin(np.arange(width), drawn[m])
                found |= {(m, at): whole - found[m, beside] for at, (beside, whole) in siblings[m].items()}
                siblings[m] = {}
                ready = {at: best_split(found[m, at], allowed, order, tree.bounds[at], penalty, min_leaf) for at in fresh[m] if (m, at) in found}
                fresh[m] = []
                for at in sorted((a for a in ready if ready[a]), key=lambda a: (-ready[a].gain, a)):
                    if tree.left.count(-1) < leaves:
                        split = ready[at]
                        below, above = tree.split(at, split, order[split.feature])
                        fresh[m] += below, above
                        rows_of = found[m, at][0, split.feature].cumsum()
                        few, many = (below, above) if 2 * rows_of[split.cut] <= rows_of[-1] else (above, below)
                        siblings[m][many] = few, found[m, at]
                tree.depth += bool(fresh[m])
                if tree.left.count(-1) >= leaves or 2**tree.depth > leaves:
                    fresh[m], siblings[m] = [], {}
        if turn < trees:
            for m, tree in growing.items():
                models[m].trees.append(tree)
                if tree.depth == 0:
                    models[m].stopped = not models[m].losses and column_share >= 1 and row_share >= 1
    for model in models:
        if not model.stopped:
            model.settle_on_best()


def boost(rows: DataFrame, key: Column, label: str = "label", features: list[str] = P.FEATURES, signs: dict[str, int] = P.FEATURE_SIGNS, part: str | None = None, n_parts: int = 0,
          valid: Column | None = None, trees: int = P.BOOST_TREES, rate: float = P.BOOST_RATE, leaves: int = P.BOOST_LEAVES, min_leaf: int = P.BOOST_MIN_LEAF, row_share: float = 1.0,
          column_share: float = P.BOOST_SHARE, patience: int | None = None, penalty: float = 1.0, seed: int = 20260603, n: str | None = None) -> list[Boosted]:
    """A model without each of the n_parts parts, and last the one on all rows.

    Every tree sees all rows, unless a row_share below 1 is asked: key (bigint) then decides which. Where valid holds, rows only measure the loss, if there is a patience. Features without
    a sign are free. n may name the rows that a row stands for; label then counts their events.
    """
    width, seen = len(features), valid is not None and patience is not None
    own = F.col(part).cast("int") if part else F.lit(-1)
    group = F.when(own.between(0, n_parts - 1), own).otherwise(n_parts)
    if seen:
        group = group + F.when(valid, n_parts + 1).otherwise(0)
    n_groups = (n_parts + 1) * (2 if seen else 1)
    base = rows.select((key.cast("bigint") if row_share < 1 else F.lit(0).cast("bigint")).alias("key"), F.col(label).cast("double").alias("y"), group.alias("g"),
                       (F.col(n) if n else F.lit(1)).cast("long").alias("n"), *columns_of(features))
    counts = [c for i in range(n_groups) for c in (F.coalesce(F.sum(F.when(F.col("g") == i, F.col("n"))), F.lit(0)).alias(f"n{i}"), F.coalesce(F.sum(F.when(F.col("g") == i, F.col("y"))), F.lit(0.0)).alias(f"b{i}"))]
    vectors = settle(base.groupBy("key", *[f"x{i}" for i in range(width)]).agg(*counts))
    cuts = cuts_of(vectors.select(sum((F.col(f"n{i}") for i in range(n_groups)), F.lit(0)).alias("n"), *[f"x{i}" for i in range(width)]), width)
    tally = vectors.agg(F.count(F.lit(1)).alias("vectors"), *[F.coalesce(F.sum(f"{c}{i}"), F.lit(0)).alias(f"{c}{i}") for c in "nb" for i in range(n_parts + 1)]).first()
    parts: list[int | None] = [*range(n_parts), None]
    models = []
    for p in parts:
        learned, bad = (sum(tally[f"{c}{i}"] for i in range(n_parts + 1) if i != p) for c in "nb")
        models.append(Boosted(features, cuts, math.log((bad + 0.5) / (learned - bad + 0.5)), rate))
    order = np.array([signs.get(f, 0) for f in features])
    how = dict(order=order, trees=trees, leaves=leaves, min_leaf=min_leaf, row_share=row_share, column_share=column_share, patience=patience if seen else None, penalty=penalty, seed=seed)
    blocks = in_blocks(vectors, tally["vectors"], models, n_groups)
    if tally["vectors"] > MOST:
        scans = Scans(blocks, models, parts, n_parts)
        grow(models, scans, **how)
        scans.end()
        return models

    def whole(own: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, Boosted]]:
        held = list(own)
        m = held[0][0]
        grow([models[m]], OwnBlocks([b for _, b in held if b is not None], models[m]), **how)
        yield m, models[m]

    each = blocks.flatMap(lambda b: [(m, own_part(b, part, n_parts)) for m, part in enumerate(parts)])
    first = vectors.sparkSession.sparkContext.parallelize([(m, None) for m in range(len(parts))], 1)  # so that no model is without a task
    return [model for _, model in sorted(first.union(each).partitionBy(len(parts), int).mapPartitions(whole).collect(), key=lambda r: r[0])]


class SeenVectors:
    """Scores of rows in a task, which keeps those of at most about MOST vectors: many rows of a table share one."""

    def __init__(self, model: Boosted):
        self.model, self.seen, self.sums = model, {}, None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        self.sums = self.sums or Sums(self.model.trees)
        if len(self.seen) > MOST:
            self.seen.clear()
        bins = self.model.bins_of(x).astype(np.uint8)
        text, width = bins.tobytes(), bins.shape[1]
        keys = [text[at : at + width] for at in range(0, len(text), width)]
        new = {k: i for i, k in enumerate(keys) if k not in self.seen}
        if new:
            z = self.model.base + self.model.rate * self.sums.of(bins[list(new.values())])
            self.seen.update(zip(new, (1 / (1 + np.exp(-z))).tolist()))
        return np.array([self.seen[k] for k in keys], np.float64)


def probability(model: Boosted) -> Column:
    """The score of a row as a column."""
    from pyspark.sql.functions import pandas_udf

    score_of = SeenVectors(model)

    @pandas_udf("double")
    def score(*x: pd.Series) -> pd.Series:
        return pd.Series(score_of(np.column_stack(x).astype(np.float64)))

    return score(*columns_of(model.features))


def steps_against(rows: DataFrame, model: Boosted, signs: dict[str, int] = P.FEATURE_SIGNS) -> DataFrame:
    """(feature, declared, n, n_moved, n_against): how the score moves when the feature alone goes one bin up, over all rows that have a bin above. Equal rows are moved once."""
    declared = [signs.get(f, 0) for f in model.features]
    names = [f"x{i}" for i in range(len(declared))]
    vectors = rows.select(*columns_of(model.features)).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums = np.zeros((len(declared), 3), np.int64), Sums(model.trees)
        for b in batches:
            n, bins = b["n"].to_numpy(), model.bins_of(b[names].to_numpy(np.float64))
            before = model.rate * sums.of(bins)
            for f, sign in enumerate(declared):
                inner = bins[:, f] < len(model.cuts[f])
                up = bins.copy()
                up[:, f] += inner
                change = model.rate * sums.of(up) - before
                total[f] += n[inner].sum(), n[np.abs(change) > 1e-12].sum(), n[sign * change < -1e-12].sum()
        yield pd.DataFrame({"feature": model.features, "declared": declared} | dict(zip(("n", "n_moved", "n_against"), total.T)))

    moved = vectors.mapInPandas(run, "feature string, declared int, n bigint, n_moved bigint, n_against bigint")
    return moved.groupBy("feature", "declared").agg(*[F.sum(c).alias(c) for c in ("n", "n_moved", "n_against")])
