"""Mixed-type clusters (k-prototypes): several fits at once, a round of all of them in one scan.

A row costs a prototype the squared distance of its numbers plus gamma times the categories in which they differ. Fits differ in k,
in the rows they start from and in the weights of the rows (bootstrap replicates). Rows are written once as whole millionths and
category codes; a round is one job in which every task sums its rows per (fit, cluster), and Spark adds the sums up. All sums are of
whole numbers, so neither the order of rows nor a task run again changes a digit. The driver holds prototypes and their sums only.

Ties go to the lower prototype and to the smaller category value. A prototype without rows stays where it is. Missing numbers are
zero; a missing or unknown category differs from every prototype's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.sources.scratch import settle

UNIT = 1_000_000


@dataclass
class Encoded:
    """data: (key, x: millionths, c: category codes from 1, w: weights, the first of them 1)."""

    data: DataFrame
    key: str
    nums: list[str]
    cats: dict[str, list[str]]


@dataclass
class Fit:
    """centre: (k, numbers) in millionths; modes: (k, categories) as codes; rounds counts assignments, moving says whether the last one changed anything."""

    k: int
    start: int
    weight: int
    centre: np.ndarray
    modes: np.ndarray
    rounds: int = 0
    moving: bool = True
    cost: float = 0.0


@dataclass
class Sums:
    """Per cluster of a fit: weight, cost, sum of squared numbers (both in millionths), sums of the numbers, weight per category value."""

    n: np.ndarray
    cost: np.ndarray
    square: np.ndarray
    x: np.ndarray
    values: list[np.ndarray]


def encode(features: DataFrame, key: str, nums: list[str], cats: dict[str, list[str]], weights: list[Column] | None = None) -> Encoded:
    x = [F.rint(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * UNIT) for c in nums]
    codes = [F.coalesce(F.array_position(F.array(*map(F.lit, vs)), F.col(c).cast("string")), F.lit(0)).cast("int") if vs else F.lit(0) for c, vs in cats.items()]
    w = [F.lit(1), *[w.cast("int") for w in weights or []]]
    data = features.select(
        F.col(key).alias("key"), F.array(*x).cast("array<double>").alias("x"), F.array(*codes).cast("array<int>").alias("c"), F.array(*w).alias("w"))
    return Encoded(settle(data), key, nums, cats)


def starts(rows: Encoded, k: int, seeds: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per seed the k rows of the smallest md5 of seed and key."""
    each = None
    for i, seed in enumerate(seeds):
        turn = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("key").cast("string")))
        one = rows.data.select(F.lit(i).alias("i"), turn.alias("turn"), "key", "x", "c").orderBy("turn", "key").limit(k)
        each = one if each is None else each.unionAll(one)
    taken = sorted(each.collect(), key=lambda r: (r["i"], r["turn"], str(r["key"])))
    out = []
    for i in range(len(seeds)):
        own = [r for r in taken if r["i"] == i]
        out.append((np.array([r["x"] for r in own], float).reshape(len(own), len(rows.nums)), np.array([r["c"] for r in own], int).reshape(len(own), len(rows.cats))))
    return out


def _costs(x: np.ndarray, c: np.ndarray, fit: Fit, gamma: float) -> np.ndarray:
    out = np.empty((len(x), len(fit.centre)))
    for p, (centre, modes) in enumerate(zip(fit.centre, fit.modes, strict=True)):
        d = np.zeros(len(x))
        for j in range(x.shape[1]):  # in the order of the columns, so that ties are the same everywhere
            d += (x[:, j] - centre[j]) ** 2
        miss = ((c != modes) | (c == 0)).sum(1) if c.shape[1] else 0
        out[:, p] = d + gamma * UNIT**2 * miss
    return out


def _arrays(rows: Encoded, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.array(b["x"].tolist(), float).reshape(len(b), len(rows.nums)), np.array(b["c"].tolist(), int).reshape(len(b), len(rows.cats))


def sums(rows: Encoded, fits: list[Fit], gamma: float) -> list[Sums]:
    """One scan: what each cluster of each fit holds under the fit's present prototypes."""
    d, sizes = len(rows.nums), [len(vs) + 1 for vs in rows.cats.values()]
    width, shape = 3 + d + sum(sizes), replace(rows, data=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros((len(f.centre), width), np.int64) for f in fits]
        for b in batches:
            x, c = _arrays(shape, b)
            weights, square = np.array(b["w"].tolist(), float), np.rint((x**2).sum(1) / UNIT)
            for f, t in zip(fits, total, strict=True):
                costs, w, k = _costs(x, c, f, gamma), weights[:, f.weight], len(f.centre)
                pick = costs.argmin(1)
                parts = [w, w * np.rint(costs[np.arange(len(x)), pick] / UNIT), w * square, *(w[:, None] * x).T]
                t[:, : 3 + d] += np.column_stack([np.rint(np.bincount(pick, v, k)).astype(np.int64) for v in parts])
                at = 3 + d
                for j, n in enumerate(sizes):
                    t[:, at : at + n] += np.rint(np.bincount(pick * n + c[:, j], w, k * n)).astype(np.int64).reshape(k, n)
                    at += n
        yield pd.DataFrame([(i, p, row.tolist()) for i, t in enumerate(total) for p, row in enumerate(t)], columns=["fit", "cluster", "v"])

    made = rows.data.select("x", "c", "w").mapInPandas(run, "fit int, cluster int, v array<bigint>")
    whole = made.groupBy("fit", "cluster").agg(F.array(*[F.sum(F.col("v")[i].cast("decimal(38,0)")) for i in range(width)]).alias("v")).collect()
    grid = [np.zeros((len(f.centre), width)) for f in fits]
    for r in whole:
        grid[r["fit"]][r["cluster"]] = [float(v) for v in r["v"]]
    edges = np.cumsum([3 + d, *sizes])
    return [Sums(g[:, 0], g[:, 1], g[:, 2], g[:, 3 : 3 + d], [g[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]) for g in grid]


def moved(fit: Fit, held: Sums) -> Fit:
    """Means of whole millionths and most common values; known values only."""
    some = held.n > 0
    centre = np.where(some[:, None], np.rint(held.x / np.maximum(held.n, 1)[:, None]), fit.centre)
    modes = fit.modes.copy()
    for j, v in enumerate(held.values):
        if v.shape[1] > 1:
            modes[:, j] = np.where(v[:, 1:].sum(1) > 0, v[:, 1:].argmax(1) + 1, fit.modes[:, j])
    same = (centre == fit.centre).all() and (modes == fit.modes).all()
    return replace(fit, centre=centre, modes=modes, rounds=fit.rounds + 1, moving=not same, cost=float(held.cost.sum()) / UNIT)


def fit_all(rows: Encoded, wanted: list[tuple[int, int, int]], max_iter: int = 20, gamma: float = 0.5) -> list[Fit]:
    """wanted: (k, seed, weight). One job a round for all fits that still move; cost is that of the prototypes returned, where they stand still."""
    seeds = sorted({s for _, s, _ in wanted})
    first = dict(zip(seeds, starts(rows, max((k for k, _, _ in wanted), default=0), seeds), strict=True)) if wanted else {}
    fits = [Fit(k, s, w, first[s][0][:k], first[s][1][:k]) for k, s, w in wanted]
    for _ in range(max_iter):
        active = [i for i, f in enumerate(fits) if f.moving and len(f.centre)]
        if not active:
            break
        for i, held in zip(active, sums(rows, [fits[i] for i in active], gamma), strict=True):
            fits[i] = moved(fits[i], held)
    return fits


def cheapest(fits: list[Fit]) -> dict[tuple[int, int], Fit]:
    """Of the starts of each (k, weight) the fit of least cost."""
    best: dict[tuple[int, int], Fit] = {}
    for f in fits:
        if (f.k, f.weight) not in best or f.cost < best[f.k, f.weight].cost:
            best[f.k, f.weight] = f
    return best


def assigned(rows: Encoded, fits: list[Fit], gamma: float = 0.5) -> DataFrame:
    """(key, clusters): the cluster of each row in each fit, or -1 in a fit without prototypes."""
    shape, key = replace(rows, data=None), rows.data.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, c = _arrays(shape, b)
            picks = [_costs(x, c, f, gamma).argmin(1) if len(f.centre) else np.full(len(x), -1) for f in fits]
            yield pd.DataFrame({"key": b["key"], "clusters": np.column_stack(picks).astype(np.int32).tolist()})

    return rows.data.select("key", "x", "c").mapInPandas(run, f"key {key}, clusters array<int>").withColumnRenamed("key", rows.key)


def silhouettes(rows: Encoded, fits: list[Fit], gamma: float = 0.5) -> list[float]:
    """Mean silhouette by squared distances on numbers and one flag per category value, of all fits in two scans: sums, then rows against sums."""
    held, shape = sums(rows, fits, gamma), replace(rows, data=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(fits), 2), np.int64)
        for b in batches:
            x, c = _arrays(shape, b)
            x = x / UNIT
            square = (x**2).sum(1) + (c > 0).sum(1)
            for i, (f, h) in enumerate(zip(fits, held, strict=True)):
                k, at = len(f.centre), np.arange(len(x))
                if not k:
                    continue
                pick = _costs(x * UNIT, c, f, gamma).argmin(1)
                far = square[:, None] * h.n + (h.square / UNIT + sum((v[:, 1:].sum(1) for v in h.values), np.zeros(k))) - 2 * (x @ (h.x / UNIT).T)
                for j, v in enumerate(h.values):
                    far -= 2 * np.where(c[:, j] > 0, v[:, c[:, j]], 0).T
                own = far[at, pick] / np.maximum(h.n[pick] - 1, 1)
                others = np.where(h.n > 0, far / np.maximum(h.n, 1), np.inf)
                others[at, pick] = np.inf
                other = others.min(1)
                good = (h.n[pick] > 1) & np.isfinite(other)
                s = np.where(good, (np.where(good, other, 0) - own) / np.maximum(np.maximum(np.where(good, other, 0), own), 1e-12), 0)
                total[i] += [len(x), int(np.rint(s * UNIT).sum())]
        yield pd.DataFrame({"fit": np.arange(len(fits)), "n": total[:, 0], "s": total[:, 1]})

    made = rows.data.select("x", "c").mapInPandas(run, "fit int, n bigint, s bigint").groupBy("fit").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by = {r["fit"]: r["s"] / UNIT / max(r["n"], 1) for r in made.collect()}
    return [by.get(i, 0.0) for i in range(len(fits))]


def prototypes_of(rows: Encoded, fit: Fit) -> list[dict]:
    """Prototypes as numbers and category values by column name."""
    return [
        {"num": {c: float(v) / UNIT for c, v in zip(rows.nums, centre, strict=True)},
         "cat": {c: vs[m - 1] if m else None for (c, vs), m in zip(rows.cats.items(), modes, strict=True)}}
        for centre, modes in zip(fit.centre, fit.modes, strict=True)
    ]
