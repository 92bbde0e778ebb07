"""Exact quantiles, AUC, KS and deciles against brute force, with value ranges of a few values each."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import ranks, scoring
from ledgerscope.operators.segments import poisson_draw


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    return pd.DataFrame({
        "id": range(600), "g": [rng.choice("ab") for _ in range(600)],
        # a third of all rows share one score
        "s": [0.5 if rng.random() < 0.34 else round(rng.random(), 2) for _ in range(600)],
        "y": [int(rng.random() < 0.2) for _ in range(600)],
    })


def brute_auc(d):
    p, q = d.s[d.y == 1].to_numpy(), d.s[d.y == 0].to_numpy()
    return ((p[:, None] > q).sum() + (p[:, None] == q).sum() / 2) / (len(p) * len(q))


def brute_ks(d):
    p, q = d.s[d.y == 1], d.s[d.y == 0]
    return max((p >= c).mean() - (q >= c).mean() for c in d.s.unique())


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_quantiles(spark, data, accuracy):
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0]
    rows = ranks.quantiles(spark.createDataFrame(data), F.col("s"), probs, ["g"], accuracy).collect()
    assert len(rows) == 2
    for r in rows:
        want = np.quantile(data.s[data.g == r["g"]], probs)
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want, atol=1e-12)


@pytest.mark.parametrize("per_task", [7, 100_000])
def test_auc_and_ks_with_ties(spark, data, per_task, monkeypatch):
    monkeypatch.setattr(ranks, "VALUES_PER_TASK", per_task)
    for r in ranks.discrimination(spark.createDataFrame(data), "s", "y", ["g"]).collect():
        d = data[data.g == r["g"]]
        assert r["auc"] == pytest.approx(brute_auc(d), abs=1e-6)
        assert r["ks"] == pytest.approx(brute_ks(d), abs=1e-6)


def test_single_class_has_no_auc(spark):
    r = ranks.discrimination(spark.createDataFrame([(0.1, 0), (0.2, 0)], "s double, y int"), "s", "y").first()
    assert r["auc"] is None


@pytest.mark.parametrize("n", [10, 37, 100, 203])
def test_deciles_equal_qcut_of_ranks(spark, n):
    rng = random.Random(n)
    d = pd.DataFrame({"id": range(n), "s": [round(rng.random(), 1) for _ in range(n)]})
    d["want"] = pd.qcut(d.s.rank(method="first"), 10, labels=False)
    out = ranks.deciles(spark.createDataFrame(d), "s", ["id"]).toPandas()
    assert (out.decile == out.want).all()


def test_quantiles_are_selected_inside_brackets(spark):
    """More values than the sketch keeps, many partitions, a hot value, null groups and null values."""
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 40_000), "x": np.where(rng.random(40_000) < 0.3, 7.0, rng.normal(5, 9, 40_000))})
    df = spark.createDataFrame(d).repartition(9).withColumn("g", F.when(F.col("g") != "c", F.col("g"))).unionByName(
        spark.createDataFrame([("a", None), ("only null", None)], "g string, x double"))
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.9995, 1.0]
    rows = {r["g"]: r for r in ranks.quantiles(df, F.col("x"), probs, ["g"], 1000).collect()}
    assert set(rows) == {"a", "b", None}
    for g, r in rows.items():
        want = np.quantile(d.x[d.g == (g or "c")], probs)
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want, atol=1e-12)
    whole = ranks.quantiles(df, F.col("x"), probs, accuracy=1000)
    assert np.allclose(list(whole.first()), np.quantile(d.x, probs), atol=1e-12)
    assert list(ranks.quantiles(df.limit(0), F.col("x"), [0.5]).first()) == [None]


@pytest.mark.parametrize("descending", [False, True])
def test_rank_with_half_the_book_on_one_score(spark, descending):
    rng = random.Random(9)
    d = [(i, None if i % 13 == 0 else 0.5 if rng.random() < 0.5 else round(rng.random(), 3)) for i in range(2000)]
    df = spark.createDataFrame(d, "id long, s double").repartition(6)
    got = {r["id"]: (r["rank"], r["n_all"]) for r in ranks.global_rank(df, "s", ["id"], descending).collect()}
    scored = sorted((x for x in d if x[1] is not None), key=lambda x: (-x[1] if descending else x[1], x[0]))
    want = {i: (None, len(scored)) for i, _ in d} | {i: (k + 1, len(scored)) for k, (i, _) in enumerate(scored)}
    assert got == want
    written = ranks.global_rank(df, "s", ["id"], descending)
    assert "SortMergeJoin" not in written._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] for r in ranks.deciles(df, "s", ["id"]).filter("decile is null").collect()} == {i for i, s in d if s is None}


def test_top_fraction_keeps_exactly_k_rows_and_breaks_ties_by_key(spark):
    d = pd.DataFrame({"id": range(50), "s": [0.9] * 10 + [0.1] * 40})
    got = sorted(r["id"] for r in ranks.top_fraction(spark.createDataFrame(d), "s", ["id"], 0.1).collect())
    assert got == [0, 1, 2, 3, 4]


def test_precision_recall(spark, data):
    out = {r["top_share"]: r for r in scoring.precision_recall(spark.createDataFrame(data.rename(columns={"y": "label"})), "s").collect()}
    for share, r in out.items():
        cut = data.s.quantile(1 - share)
        hit = data.s >= cut
        assert r["n_flagged"] == hit.sum()
        assert r["precision"] == pytest.approx(data.y[hit].mean(), abs=1e-6)


def test_poisson_draw_has_the_right_mean_and_variance():
    u = pd.Series((np.arange(20_000) + 0.5) / 20_000)
    for lam in (0.7, 5.0, 30.0, 400.0):
        k = poisson_draw(pd.Series(np.full(20_000, lam)), u)
        assert k.mean() == pytest.approx(lam, rel=0.01)
        assert k.var() == pytest.approx(lam, rel=0.02)


def test_replicate_auc_equals_weighted_brute_force(spark, data):
    keys = data.id.astype(str).tolist()
    w = scoring.replicate_weights(keys, 30, 7)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    half = data.copy()
    half["s"] = [0.5 if i % 2 else v for i, v in enumerate(np.random.default_rng(2).random(len(data)))]  # half on one score, the rest unrounded
    for d in (data, half):
        got = {r["replicate"]: r["auc"] for r in scoring.replicate_auc(spark.createDataFrame(d).repartition(5), "s", "y", ["id"], 30, 7).collect()}
        for r in range(30):
            again = d.loc[np.repeat(np.arange(len(d)), w[:, r])]
            assert got[r] == pytest.approx(brute_auc(again), abs=1e-6)
    assert scoring.replicate_auc(spark.createDataFrame([(1, 0.1, 0), (2, None, 1)], "id int, s double, y int"), "s", "y", ["id"], 5).count() == 0


def test_bootstrap_interval_covers_the_point_estimate(spark, data):
    df = spark.createDataFrame(data)
    r = scoring.bootstrap_auc(df, "s", "y", ["id"], 60).first()
    assert r["replicates"] == 60 and r["lo"] < brute_auc(data) < r["hi"]
    assert r == scoring.bootstrap_auc(df.repartition(7), "s", "y", ["id"], 60).first()


def test_many_quantiles_meet_each_row_once(spark):
    """64 quantiles, overlapping brackets, a hot value: a row has one place among the brackets and is not paired with each."""
    rng = np.random.default_rng(11)
    x = np.where(rng.random(20_000) < 0.3, 7.0, rng.normal(5, 9, 20_000))
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(20_000) % 2, "x": x})).repartition(5)
    probs = [i / 64 for i in range(1, 65)]
    for r in ranks.quantiles(df, F.col("x"), probs, ["g"], 400).collect():
        assert np.allclose(list(r)[1:], np.quantile(x[r["g"] :: 2], probs), atol=1e-12)
    edges = sorted(set(x[:64]))
    marked = spark.createDataFrame([(float(v), [float(e) for e in edges]) for v in x[:200]], "x double, edges array<double>")
    got = marked.select("x", ranks._places("edges", len(edges), F.col("x")).alias("n")).collect()
    assert [r["n"] for r in got] == [int(np.searchsorted(edges, r["x"], side="right")) for r in got]
