"""Monotone boosting against brute force on single rows, its constraints, stopping and folds."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import boosting as B
from ledgerscope.operators import models as M
from ledgerscope.operators import trees as T
from ledgerscope.plans import pipeline

FEATURES, SIGNS = ["u", "v", "w"], {"u": 1, "v": -1}


def rows_of(n, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 10, n), rng.normal(size=n).round(2), rng.integers(0, 3, n)]).astype(float)
    # u turns down at its end and v has a bump: against the declared signs there
    p = 0.1 + 0.05 * np.minimum(x[:, 0], 14 - x[:, 0]) + 0.2 * (np.abs(x[:, 1]) < 0.3) + 0.1 * (x[:, 2] == 1)
    return x, (rng.random(n) < p).astype(int)


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))], "loan_id long, label int, u double, v double, w double").repartition(5)


def brute_force(bins, y, signs, n_trees, rate, leaves, min_leaf, penalty=1.0):
    """Margins after every tree; splits tried one row set at a time."""
    z = np.full(len(y), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        g, h = np.rint((p - y) * B.SCALE) / B.SCALE, np.rint(p * (1 - p) * B.SCALE) / B.SCALE
        done, level = [], [(np.ones(len(y), bool), -math.inf, math.inf, 0.0)]
        while level:
            tried = []
            for at, (rows, low, high, value) in enumerate(level):
                def loss(r):
                    w = min(max(-g[r].sum() / (h[r].sum() + penalty), low), high)
                    return w, g[r].sum() * w + (h[r].sum() + penalty) * w * w / 2
                best = None
                for f in range(bins.shape[1]):
                    for c in range(int(bins[:, f].max()) + 1):
                        a, b = rows & (bins[:, f] <= c), rows & (bins[:, f] > c)
                        if min(a.sum(), b.sum()) < min_leaf:
                            continue
                        (wa, la), (wb, lb) = loss(a), loss(b)
                        gain = loss(rows)[1] - la - lb
                        if signs[f] * (wb - wa) >= 0 and gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, f, a, b, wa, wb)
                tried.append((best, at))
            following = []
            for best, at in sorted(tried, key=lambda t: (-(t[0][0] if t[0] else 0), t[1])):
                rows, low, high, value = level[at]
                if best is None:
                    done.append((rows, value))
                    continue
                _, f, a, b, wa, wb = best
                mid = (wa + wb) / 2
                bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[signs[f]]
                following += [(a, *bounds[0], wa), (b, *bounds[1], wb)]
            if len(done) + len(following) >= leaves:
                done += [(rows, value) for rows, _, _, value in following]
                following = []
            level = following
        for rows, value in done:
            z[rows] += rate * value
    return z


def test_margins_equal_brute_force(spark):
    x, y = rows_of(700, 3)
    df = frame(spark, x, y)
    # four leaves: two full levels, so the leaf limit cuts nothing inside a level
    model = B.boost(df, F.col("loan_id"), features=FEATURES, signs=SIGNS, trees=4, rate=0.5, leaves=4, min_leaf=30, row_share=1, column_share=1)[0]
    bins = model.bins_of(x)
    assert len(model.trees) == 4 and not model.losses
    assert model.base + model.added(bins) == pytest.approx(brute_force(bins, y, [1, -1, 0], 4, 0.5, 4, 30), abs=1e-9)


def test_scores_never_move_against_a_sign(spark):
    x, y = rows_of(3000, 5)
    df = frame(spark, x, y)
    how = dict(trees=12, rate=0.3, leaves=15, min_leaf=20, patience=50)
    bound = B.boost(df, F.col("loan_id"), features=FEATURES, signs=SIGNS, **how)[0]
    free = B.boost(df, F.col("loan_id"), features=FEATURES, signs={}, **how | {"trees": 6})[0]
    steps = {r["feature"]: r for r in B.steps_against(df, bound, SIGNS).collect()}
    assert all(r["n_against"] == 0 for r in steps.values()) and steps["u"]["n_moved"] > 500 and steps["w"]["n_moved"] > 500
    loose = {r["feature"]: r["n_against"] for r in B.steps_against(df, free, SIGNS).collect()}
    assert loose["u"] > 0 and loose["v"] > 0
    grid = bound.bins_of(np.array([[u, v, w] for v in (-2.0, 0.0, 2.0) for w in (0.0, 1.0) for u in range(10)]))
    assert (np.diff(bound.added(grid).reshape(6, 10), axis=1) >= -1e-12).all()
    again = B.boost(df.repartition(3), F.col("loan_id"), features=FEATURES, signs=SIGNS, **how | {"trees": 3})[0]
    assert again.trees and again.trees == bound.trees[: len(again.trees)]


def test_stops_at_the_lowest_loss_and_keeps_folds_apart(spark):
    x, y = rows_of(2500, 7)
    df = frame(spark, x, y)
    how = dict(trees=40, rate=1.0, leaves=15, min_leaf=5, patience=3)
    model, iso, summed = M.calibrate_boosted(df, features=FEATURES, folds=2, **how)
    assert len(model.trees) == int(np.argmin(model.losses)) and len(model.losses) <= len(model.trees) + 4 < 41
    assert summed.agg(F.sum("_w")).first()[0] == 2500
    mean = M.apply_calibration(iso, M.predict_boosted(model, df, "raw"), "raw", "p").agg(F.avg("p"), F.avg("label")).first()
    assert mean[0] == pytest.approx(mean[1], abs=0.05)
    # the model without fold 0 does not see its labels
    turned = df.withColumn("part", F.col("loan_id") % 2)
    less = B.boost(turned, F.col("loan_id"), features=FEATURES, signs=SIGNS, part="part", n_parts=2, trees=3)
    other = B.boost(turned.withColumn("label", F.expr("if(part = 0, 1 - label, label)")), F.col("loan_id"), features=FEATURES, signs=SIGNS, part="part", n_parts=2, trees=3)
    assert less[0].trees == other[0].trees and less[1].trees != other[1].trees and less[2].base != other[2].base


def test_nulls_one_class_and_empty_tables(spark):
    schema = "loan_id long, label int, u double, v double, w double"
    some = spark.createDataFrame([(i, int(i % 3 == 0), None if i % 3 == 0 else float(i % 5), None, 1.0) for i in range(300)], schema)
    model = B.boost(some, F.col("loan_id"), features=FEATURES, signs={}, trees=3, rate=0.5, min_leaf=10, row_share=1, column_share=1)[0]
    p = {r["label"]: r["p"] for r in M.predict_boosted(model, some, "p").groupBy("label").agg(F.avg("p").alias("p")).collect()}
    assert p[1] > p[0] + 0.2
    one = B.boost(some.withColumn("label", F.lit(1)), F.col("loan_id"), features=FEATURES, signs={}, trees=2)[0]
    assert one.base > 5
    none = B.boost(some.limit(0), F.col("loan_id"), features=FEATURES, signs={}, trees=2)[0]
    assert none.base == 0 and M.predict_boosted(none, some, "p").filter("p != 0.5").count() == 0


@pytest.mark.parametrize("n_leaves", [1, 2, 15, 40, 90])
def test_packed_trees_find_the_same_leaves(n_leaves):
    """Trees side by side in words, and one of more leaves than a word has bits, against the walk from the root."""
    rng = np.random.default_rng(n_leaves)
    bins = rng.integers(0, B.WIDTH, (500, 3))
    trees = []
    for _ in range(7):
        tree = B.BoostedTree()
        while tree.left.count(-1) < n_leaves:
            at = int(rng.choice(tree.ends()))
            tree.split(at, B.Found(1.0, int(rng.integers(3)), int(rng.integers(B.WIDTH - 1)), *rng.normal(size=2)), 0)
        tree.depth = n_leaves
        trees.append(tree)
    if n_leaves <= 64:
        assert (next(B.Word(trees[:1]).nodes(bins)) == trees[0].node_of(bins)).all()
    total = np.zeros(500)
    for tree in trees:
        total += tree.value_of(bins)
    assert (B.summed_values(trees, bins) == total).all()


def test_rows_are_blocks_and_only_smaller_children_are_summed(spark, monkeypatch):
    """With blocks of a few rows the trees stay; a split sends the sums of one child."""
    x, y = rows_of(700, 3)
    df = frame(spark, x, y)
    how = dict(features=FEATURES, signs=SIGNS, trees=2, rate=0.5, leaves=4, min_leaf=30, row_share=1, column_share=1)
    whole = B.boost(df, F.col("loan_id"), **how)[0]
    sent, sums = [], B.level_sums
    monkeypatch.setattr(B, "level_sums", lambda *a: sent.append(a[4]) or sums(*a))
    monkeypatch.setattr(B, "BLOCK", 64)
    assert B.boost(df, F.col("loan_id"), **how)[0].trees == whole.trees
    assert all(len(nodes) <= max(1, 2 ** level // 2) for level, of in zip([0, 1, 0, 1], sent) for nodes in of.values())


@pytest.mark.parametrize("how", [dict(column_share=1), dict(patience=4, valid=True), dict(row_share=0.7)])
def test_a_task_per_model_grows_the_trees_of_shared_scans(spark, monkeypatch, how):
    x, y = rows_of(900, 11)
    df = frame(spark, x, y).withColumn("part", F.col("loan_id") % 3)
    how = dict(features=FEATURES, signs=SIGNS, part="part", n_parts=2, trees=7, rate=0.4, leaves=9, min_leaf=15) | how
    if how.get("valid"):
        how["valid"] = F.col("loan_id") % 10 == 0
    own = B.boost(df, F.col("loan_id"), **how)
    for name, value in (("MOST", 100), ("LEAST", 1), ("BLOCK", 40), ("KEPT", 2), ("FEW_TASKS", 3)):
        monkeypatch.setattr(B, name, value)
    shared = B.boost(df, F.col("loan_id"), **how)
    assert [m.trees for m in shared] == [m.trees for m in own] and [m.losses for m in shared] == [m.losses for m in own]
    assert len(own) == 3 and all(m.trees for m in own) and bool(own[0].losses) == ("patience" in how)


def test_equal_rows_are_one_vector(spark, monkeypatch):
    """Three copies of the rows: as many vectors, three times their rows, and the trees of single rows."""
    x, y = rows_of(600, 13)
    x[:, 1] = x[:, 1].round(1)
    df = frame(spark, x, y)
    three = df.union(df).union(df)
    seen, blocks = [], B.in_blocks
    monkeypatch.setattr(B, "in_blocks", lambda vectors, n, *a: seen.append((n, vectors.agg(F.sum("n0")).first()[0])) or blocks(vectors, n, *a))
    how = dict(features=FEATURES, signs=SIGNS, trees=4, rate=0.5, leaves=4, min_leaf=30, column_share=1)
    one, model = (B.boost(d, F.col("loan_id"), **how)[0] for d in (df, three))
    n = len(np.unique(x, axis=0))
    assert n < 600 and seen == [(n, 600), (n, 1800)]
    copies = np.tile(x, (3, 1))
    bins = model.bins_of(copies)
    assert model.base + model.added(bins) == pytest.approx(brute_force(bins, np.tile(y, 3), [1, -1, 0], 4, 0.5, 4, 30), abs=1e-9)
    steps = [{r["feature"]: tuple(r)[2:] for r in B.steps_against(d, one, SIGNS).collect()} for d in (df, three)]
    assert {f: tuple(3 * v for v in c) for f, c in steps[0].items()} == steps[1]


def test_cuts_count_the_rows_of_a_vector(spark):
    rows = [(float(v % 7), float(v), None if v % 3 else float(v), 1 + v % 4) for v in range(211)]
    vectors = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, n long").select(*[F.coalesce(f"x{i}", F.lit(float("nan"))).alias(f"x{i}") for i in range(3)], "n")
    single = vectors.select(F.array("x0", "x1", "x2").alias("x"), F.explode(F.sequence(F.lit(1), "n")))
    assert B.cuts_of(vectors, 3) == T.fit_cuts(single, "x", 3)
    assert B.cuts_of(vectors.limit(0), 3) == [[], [], []]


def test_the_registered_challenger_is_whole(spark, monkeypatch):
    """All trees of all leaves on all rows: nothing shortens the fit of the queries."""
    asked = []
    monkeypatch.setattr(pipeline.models, "calibrate_boosted", lambda train, *a, **how: asked.append((a, how)) or (None, None, None))
    pipeline.Pipeline(spark, "/root/testdata/sf0.001").boosted
    pipeline._challengers.popitem()
    default = {n: p.default for n, p in inspect.signature(B.boost).parameters.items()}
    assert asked == [((), {})]
    assert {n: default[n] for n in ("trees", "rate", "leaves", "min_leaf", "row_share", "patience")} == dict(trees=400, rate=0.03, leaves=31, min_leaf=200, row_share=1.0, patience=None)


def test_rows_of_one_vector_are_scored_once(monkeypatch):
    rng = np.random.default_rng(3)
    cuts = [list(range(1, 5)), list(range(1, 9)), [1.0]]
    model = B.Boosted(FEATURES, cuts, -0.3, 0.1)
    for _ in range(40):
        tree = B.BoostedTree()
        for _ in range(9):
            tree.split(int(rng.choice(tree.ends())), B.Found(1.0, f := int(rng.integers(3)), int(rng.integers(len(cuts[f]))), *rng.normal(size=2)), 0)
        tree.depth = 9
        model.trees.append(tree)
    x = rng.integers(0, 10, (4000, 3)).astype(float)
    x[::50, 1] = np.nan
    want = 1 / (1 + np.exp(-(model.base + model.added(model.bins_of(x)))))
    met, of = [], B.Sums.of
    monkeypatch.setattr(B.Sums, "of", lambda self, bins: met.append(len(bins)) or of(self, bins))
    score = B.SeenVectors(model)
    assert (np.concatenate([score(part) for part in np.split(x, 8)]) == want).all()
    assert sum(met) == len(np.unique(model.bins_of(x), axis=0)) == len(score.seen) < 100
    monkeypatch.setattr(B, "MOST", 10)
    assert (np.concatenate([score(part) for part in np.split(x, 8)]) == want).all()
    assert len(score(x[:0])) == 0 and len(score.seen) < 100
