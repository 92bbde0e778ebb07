"""Binned decision trees grown best leaf first, many weighted replicates at once.

The matrix is binned once. A round is one scan: every task sums rows and events per (replicate, new leaf, feature, bin), the sums are added up
in Spark, and what comes to the driver is bounded by replicates * 2 * features * bins whatever the table's size. There the split with the
largest drop of impurity over all leaves of a replicate is made. A tree of L leaves takes L - 1 scans, and all replicates share them.

Weights of replicates are Poisson(1) draws from a hash of the row's key, so sums are whole numbers and a re-run, also after a lost
executor, grows the same trees. Missing values go left. Ties go to the first feature and the lowest cut.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators import ranks
from ledgerscope.sources.scratch import settle

BINS = 64


@dataclass
class Split:
    leaf: int
    feature: int
    cut: int  # rows in bins up to the cut go left
    gain: float
    n: int
    left: int
    right: int


@dataclass
class Tree:
    splits: list[Split] = field(default_factory=list)
    leaves: list[int] = field(default_factory=lambda: [0])

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int32)
        for s in self.splits:
            here = np.flatnonzero(node == s.leaf)
            node[here] = np.where(bins[here, s.feature] <= s.cut, s.left, s.right)
        return node


def fit_cuts(rows: DataFrame, x: str, n_features: int, bins: int = BINS) -> list[list[float]]:
    """Exact quantiles of every feature of the array column x as cut points; a value below a cut goes left of it."""
    long = rows.select(F.posexplode(x).alias("f", "v")).filter("not isnan(v)")
    found = {r["f"]: list(r)[1:] for r in ranks.quantiles(long, F.col("v"), [i / bins for i in range(1, bins + 1)], ["f"]).collect()}
    return [sorted(set(found.get(f, []))) for f in range(n_features)]


def binned(rows: DataFrame, x: str, cuts: list[list[float]], key: str, *keep: str) -> DataFrame:
    """key, the kept columns and bins, a byte per feature: how many cuts are not above the value."""
    edges = [np.array(c) for c in cuts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.array(b[x].tolist(), np.float64).reshape(len(b), len(edges))
            v = np.where(np.isnan(v), -np.inf, v)
            at = np.stack([np.searchsorted(e, v[:, f], side="right") for f, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield b[[key, *keep]].assign(bins=[row.tobytes() for row in at])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return settle(rows.select(x, key, *keep).mapInPandas(run, f"{schema}, bins binary"))


def poisson_weights(keys: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """Poisson(1) per key; replicate 0 is the table itself."""
    if replicate == 0:
        return np.ones(len(keys), np.int64)
    h = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + replicate) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, mix in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mix)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    below = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
    return np.searchsorted(below, u, side="right").astype(np.int64)


def histograms(data: DataFrame, trees: list[Tree], fresh: list[set[int]], n_features: int, key: str, y: str, seed: int) -> dict:
    """(replicate, leaf) -> (rows, events) per feature and bin, for the fresh leaves, in one scan."""
    width = BINS + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros((2, n_features * width)))
        for b in batches:
            bins = np.frombuffer(b"".join(b["bins"]), np.uint8).reshape(len(b), n_features)
            cells = bins + np.arange(n_features) * width
            keys, events = b[key].to_numpy(), b[y].to_numpy(np.float64)
            for r, tree in enumerate(trees):
                if not fresh[r]:
                    continue
                weight, leaf = poisson_weights(keys, r, seed), tree.leaf_of(bins)
                for node in fresh[r]:
                    here = np.flatnonzero((leaf == node) & (weight > 0))
                    flat, w = cells[here].ravel(), weight[here].astype(np.float64)
                    held[r, node][0] += np.bincount(flat, np.repeat(w, n_features), n_features * width)
                    held[r, node][1] += np.bincount(flat, np.repeat(w * events[here], n_features), n_features * width)
        for (r, node), sums in held.items():
            some = np.flatnonzero(sums[0])
            yield pd.DataFrame({"r": r, "leaf": node, "cell": some, "n": sums[0, some].astype(np.int64), "bad": sums[1, some].astype(np.int64)})

    parts = data.select(key, y, "bins").mapInPandas(count, "r int, leaf int, cell int, n bigint, bad bigint")
    out: dict = defaultdict(lambda: np.zeros((2, n_features, width), np.int64))
    for row in parts.groupBy("r", "leaf", "cell").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect():
        out[row["r"], row["leaf"]][:, row["cell"] // width, row["cell"] % width] = row["n"], row["bad"]
    return out


def best_split(sums: np.ndarray, weights: tuple[float, float], min_leaf: int) -> tuple[float, int, int] | None:
    """(gain, feature, cut) of the largest drop of class-weighted Gini impurity; weights are those of non-events and events."""
    left = sums.cumsum(axis=2)[:, :, :-1]
    whole = sums.sum(axis=2)[:, :, None]
    gain = drop_of(left[0], left[1], whole[0], whole[1], weights)
    allowed = (left[0] >= min_leaf) & (whole[0] - left[0] >= min_leaf)
    gain = np.where(allowed, gain, -1.0)
    at = int(gain.argmax())
    f, c = divmod(at, gain.shape[1])
    return (float(gain[f, c]), f, c) if gain[f, c] > 1e-12 else None


def drop_of(n_left, bad_left, n, bad, weights: tuple[float, float]):
    """Weighted impurity before less after: of a node with weights a and b of the classes it is 2ab / (a + b)."""

    def impurity(n, bad):
        a, b = (n - bad) * weights[0], bad * weights[1]
        return 2 * a * b / np.maximum(a + b, 1e-300)

    return impurity(n, bad) - impurity(n_left, bad_left) - impurity(n - n_left, bad - bad_left)


def grow(data: DataFrame, n_features: int, replicates: int = 1, max_leaves: int = 6, min_leaf: int = 1000, key: str = "loan_id", y: str = "default_flag", seed: int = 20260603) -> list[Tree]:
    """Class-balanced trees on binned rows: replicate 0 on the rows, the others on Poisson resamples of them."""
    trees = [Tree() for _ in range(replicates)]
    fresh = [{0} for _ in range(replicates)]
    ready: list[dict[int, tuple]] = [{} for _ in range(replicates)]
    balance: list[tuple[float, float]] = []
    for _ in range(max_leaves - 1):
        if not any(fresh):
            break
        found = histograms(data, trees, fresh, n_features, key, y, seed)
        if not balance:
            for r in range(replicates):
                n, bad = found[r, 0][:, 0].sum(axis=1).tolist()
                balance.append((n / (2 * (n - bad)) if n > bad else 1.0, n / (2 * bad) if bad else 1.0))
        for r, tree in enumerate(trees):
            for node in sorted(fresh[r]):
                split = best_split(found[r, node], balance[r], min_leaf)
                if split:
                    ready[r][node] = (*split, int(found[r, node][0, 0].sum()))
            fresh[r] = set()
            if ready[r]:
                node = max(ready[r], key=lambda k: (ready[r][k][0], -k))
                gain, f, c, n = ready[r].pop(node)
                left = 1 + 2 * len(tree.splits)
                tree.splits.append(Split(node, f, c, gain, n, left, left + 1))
                tree.leaves = [x for x in tree.leaves if x != node] + [left, left + 1]
                fresh[r] = {left, left + 1}
    return trees


def assigned(data: DataFrame, trees: list[Tree], n_features: int, key: str, *keep: str) -> DataFrame:
    """key, the kept columns and leaves, the leaf in every tree, in one scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins = np.frombuffer(b"".join(b["bins"]), np.uint8).reshape(len(b), n_features)
            yield b[[key, *keep]].assign(leaves=list(np.stack([t.leaf_of(bins) for t in trees], axis=1)))

    schema = ", ".join(f"{c} {data.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return data.mapInPandas(run, f"{schema}, leaves array<int>")


def split_rows(tree: Tree, names: list[str], cuts: list[list[float]]) -> list[tuple]:
    """(step, leaf, feature, threshold, gain, n): a value below the threshold goes left."""
    return [(i + 1, s.leaf, names[s.feature], float(cuts[s.feature][s.cut]), s.gain, s.n) for i, s in enumerate(tree.splits)]
