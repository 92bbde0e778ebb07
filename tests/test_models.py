"""Fits: invariants and small cases."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import models as M
from ledgerscope.operators.segments import adjusted_rand_index


def test_pool_adjacent_violators():
    assert M.monotone([0.1, 0.3, 0.2, 0.4], [1, 1, 3, 1], True) == pytest.approx([0.1, 0.225, 0.225, 0.4])
    assert M.monotone([0.4, 0.1, 0.2], [1, 1, 1], False) == pytest.approx([0.4, 0.15, 0.15])


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        level, run = rng.random(), rng.randrange(4)
        rows.append((i // 3, level * 100, run, int(rng.random() < 0.05 + 0.3 * level + 0.05 * run)))
    return spark.createDataFrame(rows, "loan_id int, utilisation_level double, partial_run int, label int").cache()


def test_bins_and_monotone_woe(spark, train):
    features = ["utilisation_level", "partial_run"]
    bins = M.fit_bins(train, features)
    assert bins["partial_run"].by_value and bins["partial_run"].points == [0, 1, 2, 3]
    assert not bins["utilisation_level"].by_value and len(bins["utilisation_level"].points) == 5
    card = M.fit_logistic(train, M.fit_woe(train, bins))
    for f in features:
        w = [card.woe[f][b] for b in sorted(card.woe[f])]
        assert w == sorted(w) and card.direction_ok[f] and card.iv[f] > 0
    assert all(b > 0 for b in card.betas.values())
    scored = M.predict_scorecard(card, train, "p")
    # the logistic's intercept is free, so predictions average to the base rate
    m = scored.agg(F.avg("p"), F.avg("label")).first()
    assert m[0] == pytest.approx(m[1], abs=1e-3)


def test_fold_bins_equal_bins_on_the_filtered_rows(train):
    features = ["utilisation_level", "partial_run"]
    skip = M.fold_of("loan_id", 3) == 1
    together = M.fit_bins_without(train, [skip, F.lit(False)], features)
    alone = M.fit_bins(train.filter(~skip), features)
    for f in features:
        assert together[0][f].points == pytest.approx(alone[f].points)


def test_calibration_is_monotone_and_bounded(spark, train):
    summed = spark.createDataFrame([(i / 10, min(1.0, i / 8), 10.0) for i in range(11)], "_raw double, _y double, _w double")
    iso = M.fit_isotonic(summed)
    out = M.apply_calibration(iso, spark.createDataFrame([(-1.0,), (0.35,), (0.6,), (9.0,)], "raw double"), "raw", "p").orderBy("raw")
    p = [r["p"] for r in out.collect()]
    assert p == sorted(p) and 0 <= p[0] and p[-1] <= 1


def test_leaves_merge_to_the_limit(spark):
    rows = [(float(leaf), 12, int(i < leaf)) for leaf in range(8) for i in range(10)]
    df = spark.createDataFrame(rows, "leaf double, months_on_book int, default_flag int")
    numbers = M.merge_leaves(df, 4)
    assert set(numbers.values()) == {1, 2, 3, 4}
    assert [numbers[float(i)] for i in range(8)] == sorted(numbers[float(i)] for i in range(8))


def brute_prototypes(x, c, w, centre, modes, rounds, gamma=0.5):
    import numpy as np

    centre, modes = centre.copy(), modes.copy()
    for _ in range(rounds):
        cost = ((x[:, None, :] - centre) ** 2).sum(2) + gamma * 1e12 * (c[:, None, :] != modes).sum(2)
        pick = cost.argmin(1)
        for p in range(len(centre)):
            own = pick == p
            if w[own].sum():
                centre[p] = np.rint((x[own] * w[own, None]).sum(0) / w[own].sum())
                modes[p] = [np.bincount(c[own, j], w[own]).argmax() for j in range(c.shape[1])]
    return centre, modes, pick


def clustered(spark, n=240):
    rng = random.Random(2)
    rows = [(i, (-3 if i % 3 else 3) + rng.random(), rng.gauss(0, 1), "x" if i % 3 else "y", rng.choice("abc")) for i in range(n)]
    return spark.createDataFrame(rows, "customer_id int, z_a double, z_b double, c_a string, c_b string").repartition(5)


def test_prototypes_of_many_fits_equal_brute_force(spark):
    import numpy as np

    from ledgerscope.operators import prototypes

    rows = M.encoded(clustered(spark), [M.poisson_row_weight("customer_id", b, 5) for b in range(2)])
    wanted = [(2, 1, 0), (3, 1, 0), (3, 2, 0), (3, 1, 1), (3, 1, 2)]
    fits = prototypes.fit_all(rows, wanted, 30)
    data = rows.data.orderBy("key").collect()
    x, c, w = (np.array([r[n] for r in data]) for n in ("x", "c", "w"))
    first = dict(zip((1, 2), prototypes.starts(rows, 3, [1, 2])))
    picks = {r["customer_id"]: r["clusters"] for r in prototypes.assigned(rows, fits).collect()}
    for i, ((k, seed, weight), fit) in enumerate(zip(wanted, fits)):
        centre, modes, pick = brute_prototypes(x, c, w[:, weight], first[seed][0][:k], first[seed][1][:k], 30)
        assert not fit.moving and fit.rounds < 30 and (fit.centre == centre).all() and (fit.modes == modes).all()
        assert [picks[r["key"]][i] for r in data] == pick.tolist()
    # the silhouette by all pairs of rows
    flags = np.column_stack([x / 1e6, *[c[:, [j]] == v for j in range(2) for v in np.unique(c[:, j])]]).astype(float)
    far = ((flags[:, None, :] - flags) ** 2).sum(2)
    for i, got in enumerate(prototypes.silhouettes(rows, fits[:3])):
        pick = np.array([picks[r["key"]][i] for r in data])
        s = []
        for r in range(len(x)):
            mean = {q: far[r, pick == q].sum() / max((pick == q).sum() - (q == pick[r]), 1) for q in set(pick)}
            own, other = mean[pick[r]], min(v for q, v in mean.items() if q != pick[r])
            s.append((other - own) / max(own, other) if (pick == pick[r]).sum() > 1 else 0)
        assert got == pytest.approx(np.mean(s), abs=1e-5)


def test_sweep_takes_the_clear_split_and_odd_rows_have_a_cluster(spark):
    from ledgerscope.operators import prototypes

    rows = M.encoded(clustered(spark))
    judged, winner = M.k_sweep(rows, [2, 3, 4])
    assert winner.k == 2 and judged[0][1] == max(s for _, s in judged)
    out = M.cluster_ids(rows, winner).withColumn("truth", (F.col("customer_id") % 3 == 0).cast("int"))
    assert adjusted_rand_index(out, "truth", "cluster_id").first()["ari"] == 1.0
    stable = M.cluster_stability(clustered(spark), 2, 3).collect()
    assert sorted(r["replicate"] for r in stable) == [0, 1, 2] and all(r["ari"] > 0.9 for r in stable)
    odd = prototypes.encode(spark.createDataFrame([(1, None, None), (2, 1.0, "a"), (2, 1.0, "a")], "customer_id int, z_a double, c_a string"), "customer_id", ["z_a"], {"c_a": ["a"]})
    fits = prototypes.fit_all(odd, [(5, 1, 0)])
    assert len(fits[0].centre) == 3 and prototypes.assigned(odd, fits).count() == 3
    empty = prototypes.encode(clustered(spark).limit(0), "customer_id", ["z_a"], {"c_a": []})
    fits = prototypes.fit_all(empty, [(2, 1, 0)])
    assert prototypes.assigned(empty, fits).count() == 0 and prototypes.silhouettes(empty, fits) == [0.0]


def test_columns_of_many_categories_are_refused(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_CATEGORIES", 5)
    df = spark.range(50).select((F.col("id") % 3).alias("few"), F.col("id").alias("many"))
    assert M.categories(df, ["few"]) == {"few": ["0", "1", "2"]}
    with pytest.raises(ValueError, match="many"):
        M.categories(df, ["few", "many"])


def test_outcome_columns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(M, "TREE_NUMERIC", ["value_proxy"])
    df = spark.createDataFrame([(1.0, "A", "A")], "value_proxy double, origination_risk_grade string, credit_quality_indicator string")
    with pytest.raises(ValueError):
        M.design_matrix(df, {})


def test_newton_reaches_a_vanishing_gradient(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3)) * [1, 20, 0.1]
    y = (rng.random(2000) < 1 / (1 + np.exp(-(x @ [1.0, 0.1, -3.0] - 2)))).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "x array<double>, y double").repartition(5)
    fit = M.newton_logistic(df, 3)
    beta = np.array(fit.coefficients)
    p = 1 / (1 + np.exp(-(x @ beta + fit.intercept)))
    gradient = np.array([(p - y).sum(), *(x.T @ (p - y) + beta)])
    assert np.abs(gradient).max() / 2000 < 1e-8 and fit.gradient < 1e-8 and fit.rounds < 15
    # separable rows: the penalty keeps the coefficients finite
    apart = spark.createDataFrame([([float(i)], float(i > 4)) for i in range(10)], "x array<double>, y double")
    assert M.newton_logistic(apart, 1).gradient < 1e-8


def brute_tree(x, y, w, cuts, max_leaves, min_leaf):
    """Best-first splits on single rows: (leaf, feature, threshold)."""
    import numpy as np

    balance = [w.sum() / (2 * w[y == c].sum()) for c in (0, 1)]

    def impurity(rows):
        a, b = w[rows & (y == 0)].sum() * balance[0], w[rows & (y == 1)].sum() * balance[1]
        return 2 * a * b / max(a + b, 1e-300)

    leaves, out = {0: np.ones(len(y), bool)}, []
    for _ in range(max_leaves - 1):
        best = None
        for leaf in sorted(leaves):
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left, right = leaves[leaf] & (x[:, f] < c), leaves[leaf] & (x[:, f] >= c)
                    if min(w[left].sum(), w[right].sum()) < min_leaf:
                        continue
                    gain = impurity(leaves[leaf]) - impurity(left) - impurity(right)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, leaf, f, c, left, right)
        if best is None:
            break
        _, leaf, f, c, left, right = best
        del leaves[leaf]
        leaves[2 * len(out) + 1], leaves[2 * len(out) + 2] = left, right
        out.append((leaf, f, c))
    return out, leaves


def test_trees_of_all_replicates_equal_brute_force(spark):
    import numpy as np

    from ledgerscope.operators import trees

    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 12, 900), rng.normal(size=900), rng.integers(0, 2, 900)]).astype(float)
    y = (rng.random(900) < 0.1 + 0.4 * (x[:, 0] > 7) + 0.3 * (x[:, 1] > 0.5) * x[:, 2]).astype(int)
    df = spark.createDataFrame([(i, r.tolist(), int(t)) for i, (r, t) in enumerate(zip(x, y))], "loan_id long, x array<double>, default_flag int").repartition(6)
    cuts = trees.fit_cuts(df, "x", 3, 16)
    data = trees.binned(df, "x", cuts, "loan_id", "default_flag")
    grown = trees.grow(data, 3, 4, 6, 40)
    leaves = {r["loan_id"]: r["leaves"] for r in trees.assigned(data, grown, 3, "loan_id").collect()}
    for r, tree in enumerate(grown):
        w = trees.poisson_weights(np.arange(900), r, 20260603)
        want, groups = brute_tree(x, y, w, cuts, 6, 40)
        assert [(s.leaf, s.feature, cuts[s.feature][s.cut]) for s in tree.splits] == want
        assert len(tree.leaves) == len(groups) and all(leaves[i][r] == leaf for leaf, rows in groups.items() for i in np.flatnonzero(rows))
    mean = np.mean([trees.poisson_weights(np.arange(900), r, 1).mean() for r in range(1, 20)])
    assert abs(mean - 1) < 0.05 and len({tuple(leaves[i]) for i in leaves}) > 6


def test_rand_index_of_many_assignments(spark):
    from ledgerscope.operators.segments import adjusted_rand_by

    rows = [(r, i % 3, (i * 7 + r) % 5 if r else i % 3) for r in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "r int, a int, b int")
    got = {x["r"]: x["ari"] for x in adjusted_rand_by(df, "r", "a", "b").collect()}
    assert got[0] == 1.0 and all(got[r] == adjusted_rand_index(df.filter(f"r = {r}"), "a", "b").first()["ari"] for r in range(3))


def test_equal_rows_are_written_once_and_bins_counted_together(spark, monkeypatch):
    """A fit on many equal rows scans the distinct ones; counts of several bin sets equal those of each alone."""
    rows = [(i, float(i % 4), float(i % 3), int(i % 5 == 0 or i % 4 == 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, u double, v double, label int")
    written, write = [], M.settle
    monkeypatch.setattr(M, "settle", lambda d: written.append(write(d)) or written[-1])
    M.newton_logistic(df.select(F.array("u", "v").alias("x"), F.col("label").cast("double").alias("y")), 2)
    assert written[0].count() == 12 and written[0].agg(F.sum("n"), F.sum("bad")).first()[:] == (600.0, float(sum(r[3] for r in rows)))
    skips = [F.col("i") % 2 == 0, F.lit(False)]
    sets = [{"u": M.Bins(False, [1.0, 2.0]), "v": M.Bins(True, [0.0, 1.0, 2.0])}, {"u": M.Bins(False, [2.0]), "v": M.Bins(True, [0.0, 1.0, 2.0])}]
    got = sorted(tuple(r) for r in M.bin_counts_without(df, skips, sets).collect())
    want = [(p, *r) for p, (skip, own) in enumerate(zip(skips, sets)) for r in M.bin_counts(df.filter(~skip), own).collect()]
    assert got == sorted(want)
    for part, feature, b, n, bad, mean_x in got:
        cuts = sets[part][feature]
        at = {"u": 1, "v": 2}[feature]
        own = [r for r in rows if (part == 1 or r[0] % 2) and (int(r[at]) if cuts.by_value else sum(r[at] >= c for c in cuts.points)) == b]
        assert (n, bad) == (len(own), sum(r[3] for r in own)) and abs(mean_x - sum(r[at] for r in own) / n) < 1e-6


def test_the_scorecard_is_calibrated_on_vectors(spark, monkeypatch):
    """Rows of equal features are one: the fits and the out-of-fold scores equal those on the rows of each fold, and copies of the loans add no vectors."""
    from ledgerscope import params as P

    rng = random.Random(7)
    rows = [(i // 4, int(rng.random() < 0.2 + 0.1 * (i % 3)), float(i % 3), float(rng.randrange(20)), rng.randrange(3)) for i in range(1200)]
    df = spark.createDataFrame(rows, "loan_id long, label int, a double, b double, c int")
    df = df.select("loan_id", "label", *[F.col({0: "a", 1: "b"}.get(i, "c")).alias(f) for i, f in enumerate(P.FEATURES)])
    written, write = [], M.settle
    monkeypatch.setattr(M, "settle", lambda d: written.append(write(d)) or written[-1])
    card, iso, summed = M.calibrate_scorecard(df)
    n = len({r[2:] for r in rows})
    assert n < 200 and any(w.count() == n and set(P.FEATURES) < set(w.columns) for w in written) and all(w.count() < 1200 for w in written)
    alone = M.fit_scorecard(df)
    assert card.betas == pytest.approx(alone.betas, abs=1e-6) and card.woe == alone.woe and {f: b.points for f, b in card.bins.items()} == {f: b.points for f, b in alone.bins.items()}
    dealt = df.join(M.grouped_folds(df, "loan_id"), "loan_id").cache()
    want = {}
    for k in range(5):
        fold = M.fit_scorecard(dealt.filter(F.col("_fold") != k))
        for r in M.predict_scorecard(fold, dealt.filter(F.col("_fold") == k), "p").select("p", "label").collect():
            want.setdefault(round(r["p"], 4), []).append(r["label"])
    got = {}
    for r in summed.collect():
        events, weight = got.get(round(r["_raw"], 4), (0, 0))
        got[round(r["_raw"], 4)] = events + r["_y"] * r["_w"], weight + r["_w"]
    assert sum(w for _, w in got.values()) == 1200 and sum(e for e, _ in got.values()) == pytest.approx(sum(r[1] for r in rows))
    assert sum(got.get(p, (0, 0))[1] == len(y) for p, y in want.items()) > 0.95 * len(want)  # a score may round across
    twice = M.calibrate_scorecard(df.union(df.withColumn("loan_id", F.col("loan_id") + 300)))[0]
    assert {f: b.points for f, b in twice.bins.items() if b.by_value} == {f: b.points for f, b in card.bins.items() if b.by_value}


def test_the_value_of_a_bin(spark):
    values = spark.createDataFrame([(x,) for x in (-1.0, 1.0, 1.5, 2.0, 9.0, float("nan"), None)], "x double")
    for b in (M.Bins(True, [1.0, 2.0, 3.0]), M.Bins(False, [1.0, 2.0]), M.Bins(True, [1.0]), M.Bins(False, [])):
        picked = values.select(b.index(F.col("x")).alias("i"), b.pick(F.col("x"), [0.5, 1.5, 2.5, 3.5]).alias("v")).collect()
        assert all(r["v"] == r["i"] + 0.5 for r in picked)
