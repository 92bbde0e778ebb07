"""Model fits: WOE scorecard, calibration, boosted challenger, risk tree, mixed-type clusters."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions.bands import grade_rank
from ledgerscope.functions.numeric import half_even, ratio
from ledgerscope.operators import boosting, prototypes, ranks, trees
from ledgerscope.operators.segments import adjusted_rand_by
from ledgerscope.sources.scratch import settle

# ---------------------------------------------------------------- WOE scorecard


@dataclass
class Bins:
    """Either the distinct values of a feature (few) or its interior cut points."""

    by_value: bool
    points: list[float]

    def index(self, x: Column) -> Column:
        return self.pick(x, range(len(self.points) + 1))

    def pick(self, x: Column, values: Sequence[float]) -> Column:
        """The value of x's bin."""
        out = None
        points = self.points[:-1] if self.by_value else self.points
        for v, p in zip(values, points):
            test = x <= F.lit(p) if self.by_value else x < F.lit(p)
            out = F.when(test, v) if out is None else out.when(test, v)
        return F.lit(values[0]) if out is None else out.otherwise(values[len(points)])


@dataclass
class Scorecard:
    bins: dict[str, Bins]
    woe: dict[str, dict[int, float]]
    iv: dict[str, float]
    direction_ok: dict[str, bool]
    betas: dict[str, float] = field(default_factory=dict)
    model: object = None


def fit_bins(df: DataFrame, features: list[str] = P.FEATURES, max_bins: int = P.MAX_BINS) -> dict[str, Bins]:
    """Value bins for features with few values, exact quantile cuts for the others."""
    return fit_bins_without(df, [F.lit(False)], features, max_bins)[0]


def fit_bins_without(
    df: DataFrame, left_out: list[Column], features: list[str] = P.FEATURES, max_bins: int = P.MAX_BINS
) -> list[dict[str, Bins]]:
    """Bins on the rows outside each left-out condition, all from one ranking."""
    return fit_bins_weighted(df, [F.when(c, 0).otherwise(1) for c in left_out], features, max_bins)


def fit_bins_weighted(df: DataFrame, weights: list[Column], features: list[str] = P.FEATURES, max_bins: int = P.MAX_BINS) -> list[dict[str, Bins]]:
    """Bins for every weight: how many rows of its fit a row stands for.

    All features are ranked together, summed per (feature, value) with all weights; a few rows per feature come back.
    """
    kept = {f"w{i}": c for i, c in enumerate(weights)}
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    rows = df.select(*[c.alias(n) for n, c in kept.items()], F.explode(pairs).alias("_s")).select("_s.*", *kept)
    pos = settle(ranks.positions(rows, F.col("x"), ["feature"], {n: F.col(n) for n in kept}))
    probs = [i / max_bins for i in range(1, max_bins)]
    aggs = []
    for w in kept:
        aggs.append(F.count_if(F.col(w) > 0).alias(f"{w}_distinct"))
        aggs.append(F.max(f"{w}_all").alias(f"{w}_n"))
        for i, p in enumerate(probs):
            h = F.lit(p) * (F.col(f"{w}_all") - 1).cast("double")
            for side, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
                inside = (F.col(w) > 0) & (F.col(f"{w}_before") <= rank) & (rank < F.col(f"{w}_before") + F.col(w))
                aggs.append(F.max(F.when(inside, F.col("value"))).alias(f"{w}_{side}{i}"))
    summary = {r["feature"]: r for r in pos.groupBy("feature").agg(*aggs).collect()}
    # per weight, values that count there, of features with few values there: at most features * weights * max_bins rows
    few = {w: [f for f in features if summary[f][f"{w}_distinct"] <= max_bins] for w in kept}
    needed = functools.reduce(lambda x, y: x | y, [F.col("feature").isin(few[w]) & (F.col(w) > 0) for w in kept])
    listed = pos.filter(needed).orderBy("feature", "value").collect()
    out = []
    for w in kept:
        bins = {}
        for f in features:
            r = summary[f]
            if r[f"{w}_distinct"] <= max_bins:
                bins[f] = Bins(True, [v["value"] for v in listed if v["feature"] == f and v[w] > 0])
                continue
            cuts = set()
            for i, p in enumerate(probs):
                h = p * (r[f"{w}_n"] - 1)
                cuts.add(r[f"{w}_lo{i}"] + (r[f"{w}_hi{i}"] - r[f"{w}_lo{i}"]) * (h - math.floor(h)))
            bins[f] = Bins(False, sorted(cuts))
        out.append(bins)
    return out


def bin_counts(df: DataFrame, bins: dict[str, Bins], label: str = "label") -> DataFrame:
    """Bad and good per feature and bin, in one grouped pass over all features."""
    return bin_counts_without(df, [F.lit(False)], [bins], label).filter(F.col("part") == 0).drop("part")


def bin_counts_without(df: DataFrame, left_out: list[Column], bins: list[dict[str, Bins]], label: str = "label") -> DataFrame:
    """The same for several bin sets at once, each on the rows outside its left-out condition."""
    return bin_counts_of(vectors_without(df, left_out, label, list(bins[0])), bins)


def vectors_without(df: DataFrame, left_out: list[Column], label: str = "label", features: list[str] = P.FEATURES) -> DataFrame:
    """Rows of equal features as one (features, n0, bad0, n1, bad1, ...): how many lie outside each left-out condition, and how many of these are bad."""
    kept = [F.when(c, 0).otherwise(1) for c in left_out]
    return df.groupBy(*features).agg(*[c for i, w in enumerate(kept) for c in (F.sum(w).alias(f"n{i}"), F.sum(w * F.col(label)).alias(f"bad{i}"))])


def bin_counts_of(vectors: DataFrame, bins: list[dict[str, Bins]]) -> DataFrame:
    """Bad and good per part, feature and bin, of vectors with n and bad per part; a value is summed before it meets the bins of all parts."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in bins[0]])
    sums = [f"{c}{i}" for i in range(len(bins)) for c in ("n", "bad")]
    values = vectors.select(*sums, F.explode(pairs).alias("_s")).groupBy("_s.feature", "_s.x").agg(*[F.sum(c).alias(c) for c in sums])
    at = functools.reduce(lambda out, f: out.when(F.col("feature") == f, F.array(*[own[f].index(F.col("x")) for own in bins])), bins[0], F.when(F.lit(False), F.array(F.lit(0))))
    each = values.withColumn("_at", at).select("feature", "x", F.posexplode(F.array(*[
        F.struct(F.col("_at")[i].alias("bin"), F.col(f"n{i}").alias("n"), F.col(f"bad{i}").alias("bad")) for i in range(len(bins))])).alias("part", "_s"))
    known = F.when(F.col("x").isNotNull(), F.col("_s.n"))
    return each.filter("_s.n > 0").groupBy("part", "feature", F.col("_s.bin").alias("bin")).agg(
        F.sum("_s.n").alias("n"), F.sum("_s.bad").cast("long").alias("bad"), half_even(F.sum(F.col("x") * F.col("_s.n")) / F.sum(known), 6).alias("mean_x"),
    )


def monotone(values: list[float], weights: list[float], increasing: bool) -> list[float]:
    """Weighted pool-adjacent-violators over a handful of bins."""
    sign = 1 if increasing else -1
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([sign * v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [sign * b[0] for b in blocks for _ in range(b[2])]


def fit_woe(df: DataFrame, bins: dict[str, Bins], label: str = "label", smooth: float = P.WOE_SMOOTHING) -> Scorecard:
    return woe_of_counts(bins, bin_counts(df, bins, label).collect(), smooth)


def woe_of_counts(bins: dict[str, Bins], rows: list, smooth: float = P.WOE_SMOOTHING) -> Scorecard:
    """Monotone weight of evidence per bin, from at most max_bins rows per feature."""
    card = Scorecard(bins, {}, {}, {})
    for f in bins:
        own = sorted((r for r in rows if r["feature"] == f), key=lambda r: (r["mean_x"], r["bin"]))
        bad_all = sum(r["bad"] for r in own) + smooth
        good_all = sum(r["n"] - r["bad"] for r in own) + smooth
        rates = [(r["bad"] + smooth) / (r["n"] + 2 * smooth) for r in own]
        smooth_rates = monotone(rates, [r["n"] for r in own], P.FEATURE_SIGNS.get(f, 1) > 0)
        woes, iv = [], 0.0
        for r, m in zip(own, smooth_rates):
            b, g = (m * r["n"] + smooth) / bad_all, ((1 - m) * r["n"] + smooth) / good_all
            w = math.log(b) - math.log(g)
            woes.append(w)
            iv += (b - g) * w
        card.woe[f] = {r["bin"]: w for r, w in zip(own, woes)}
        card.iv[f] = iv
        card.direction_ok[f] = _direction([r["mean_x"] for r in own], woes) in (0, P.FEATURE_SIGNS.get(f, 1))
    return card


def _direction(xs: list[float], ys: list[float]) -> int:
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    c = sum((x - mx) * (y - my) for x, y in zip(xs, ys))
    return 0 if abs(c) < 1e-9 else (1 if c > 0 else -1)


def woe_columns(card: Scorecard) -> list[Column]:
    """A comparison per bin and feature, so that the rows of a whole table are scored in compiled code."""
    return [b.pick(F.col(f).cast("double"), [card.woe[f].get(i, 0.0) for i in range(len(b.points) + 1)]).alias(f"woe_{f}") for f, b in card.bins.items()]


def fit_scorecard(train: DataFrame, label: str = "label", features: list[str] = P.FEATURES) -> Scorecard:
    return fit_logistic(train, fit_woe(train, fit_bins(train, features), label), label)


@dataclass
class Logistic:
    intercept: float
    coefficients: list[float]
    gradient: float
    rounds: int


def newton_logistic(data: DataFrame, n_features: int, penalty: float = 1.0, tolerance: float = 1e-8, most_rounds: int = 50) -> Logistic:
    """Logistic on rows (x: array of n_features, y), minimising the summed log loss plus penalty / 2 times the squared coefficients.

    With a column n a row stands for n rows, and y is the number of their events. Equal rows are written once, with their number and events. A Newton round is one scan: every task sums loss, X'(p - y) and X'WX of its rows, the sums are added up in Spark, and
    (n_features + 2) ** 2 numbers at most reach the driver. Stops when no part of the mean gradient exceeds the tolerance; a step that does
    not lower the loss is halved.
    """
    k = n_features + 1
    ridge = np.array([0.0] + [penalty] * n_features)
    upper = np.triu_indices(k)
    n = F.sum("n") if "n" in data.columns else F.count(F.lit(1))
    data = settle(data.groupBy("x").agg(n.cast("double").alias("n"), F.sum("y").alias("bad")))

    def sums(beta: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(2 + k + len(upper[0]))
            for b in batches:
                x = np.column_stack([np.ones(len(b)), np.array(b["x"].tolist(), np.float64).reshape(len(b), n_features)])
                n, bad, z = b["n"].to_numpy(np.float64), b["bad"].to_numpy(np.float64), x @ beta
                p = 1 / (1 + np.exp(-z))
                total[0] += n.sum()
                total[1] += (n * np.logaddexp(0, z) - bad * z).sum()
                total[2 : 2 + k] += x.T @ (n * p - bad)
                total[2 + k :] += (x.T @ (x * (n * p * (1 - p))[:, None]))[upper]
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        out = np.zeros(2 + k + len(upper[0]))
        for r in data.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        hessian = np.zeros((k, k))
        hessian[upper] = out[2 + k :]
        hessian = hessian + np.triu(hessian, 1).T + np.diag(ridge)
        return max(out[0], 1.0), out[1] + (ridge * beta**2).sum() / 2, out[2 : 2 + k] + ridge * beta, hessian

    beta, last, loss_before = np.zeros(k), np.zeros(k), math.inf
    for rounds in range(1, most_rounds + 1):
        n, loss, gradient, hessian = sums(beta)
        if loss > loss_before + 1e-9 * abs(loss_before):
            beta = (beta + last) / 2
            continue
        steepest = float(np.abs(gradient).max() / n)
        if steepest < tolerance:
            break
        last, loss_before = beta, loss
        beta = beta - np.linalg.solve(hessian + 1e-9 * np.eye(k), gradient)
    return Logistic(float(beta[0]), beta[1:].tolist(), steepest, rounds)


def fit_logistic(train: DataFrame, card: Scorecard, label: str = "label", n: str | None = None) -> Scorecard:
    """Logistic on the WOE columns with a unit penalty, run until the gradient vanishes. n may name the rows that a row stands for; label then counts their events."""
    data = train.select(
        F.array(*[c.cast("double") for c in woe_columns(card)]).alias("x"), F.col(label).cast("double").alias("y"), (F.col(n) if n else F.lit(1)).alias("n"))
    card.model = newton_logistic(data, len(card.bins))
    card.betas = dict(zip(card.bins, card.model.coefficients))
    return card


def predict_scorecard(card: Scorecard, df: DataFrame, name: str) -> DataFrame:
    """The logistic as a column expression: scoring stays inside generated code."""
    z = F.lit(float(card.model.intercept))
    for f, c in zip(card.bins, woe_columns(card)):
        z = z + F.lit(card.betas[f]) * c
    return df.withColumn(name, 1.0 / (1.0 + F.exp(-z)))


def scorecard_audit(spark, card: Scorecard) -> DataFrame:
    rows = [(f, card.iv[f], P.FEATURE_SIGNS[f], card.direction_ok[f], card.betas.get(f), len(card.woe[f])) for f in card.bins]
    return spark.createDataFrame(rows, "feature string, iv double, declared int, direction_ok boolean, beta double, n_bins int")


# ---------------------------------------------------------------- challenger and calibration


def boosted_models(train: DataFrame, group: str, label: str, features: list[str], part: str | None = None, n_parts: int = 0, **how) -> list[boosting.Boosted]:
    """Monotone boosted models, of all trees on all rows; where a patience is given, a tenth of the groups, by hash, decides when they stop."""
    held = F.pmod(F.xxhash64(F.lit("stop"), F.col(group)), F.lit(10)) == 0
    return boosting.boost(train, F.xxhash64(group, *features), label, features, part=part, n_parts=n_parts, valid=held, **how)


def fit_boosted(train: DataFrame, group: str = "loan_id", label: str = "label", features: list[str] = P.FEATURES, **how) -> boosting.Boosted:
    return boosted_models(train, group, label, features, **how)[0]


def calibrate_boosted(train: DataFrame, group: str = "loan_id", label: str = "label", features: list[str] = P.FEATURES, folds: int = 5, **how):
    """The challenger on all rows, an isotonic map fitted to out-of-fold scores, and those scores summed. The models of all folds grow in the same scans; equal rows of a fold are scored once."""
    train = settle(train.join(grouped_folds(train, group, folds), group).select(group, label, "_fold", *features))
    equal = settle(train.groupBy("_fold", *features).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("double")).alias("_bad")))
    if "patience" in how or "row_share" in how:  # these look at single rows
        fitted = boosted_models(train, group, label, features, "_fold", folds, **how)
    else:
        fitted = boosting.boost(equal, F.lit(0), "_bad", features, part="_fold", n_parts=folds, n="_n", **how)
    parts = [equal.filter(F.col("_fold") == k).select(boosting.probability(m).alias("_raw"), "_n", "_bad") for k, m in enumerate(fitted[:-1])]
    summed = sum_scores(functools.reduce(DataFrame.unionByName, parts))
    return fitted[-1], fit_isotonic(summed), summed


def predict_boosted(model: boosting.Boosted, df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, boosting.probability(model))


def fold_of(key: str, folds: int = 5) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def grouped_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, _fold): groups dealt to folds largest first, to and fro, so that folds differ by less than the largest group."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    turn = F.col("rank") - 1
    place = turn % folds
    back = F.expr(f"((rank - 1) div {folds}) % 2 = 1")
    return ranks.global_rank(sizes, "_n", [group], descending=True).select(group, F.when(back, folds - 1 - place).otherwise(place).cast("int").alias("_fold"))


def calibrate_scorecard(train: DataFrame, group: str = "loan_id", label: str = "label", folds: int = 5):
    """Scorecard on all rows, an isotonic map fitted to out-of-fold scores, and those scores summed.

    Whole groups share a fold, and folds are of nearly equal size. Rows of equal features are one vector with its rows and events per fit; bins and counts of all fits come from
    one ranking and one count of the vectors.
    """
    dealt = train.select(group, label, *P.FEATURES).join(grouped_folds(train, group, folds), group)
    left_out = [F.col("_fold") == k for k in range(folds)] + [F.lit(False)]
    vectors = settle(vectors_without(dealt, left_out, label))
    bins = fit_bins_weighted(vectors, [F.col(f"n{i}") for i in range(folds + 1)])
    counts = bin_counts_of(vectors, bins).collect()
    cards = [
        fit_logistic(vectors.filter(f"n{i} > 0"), woe_of_counts(b, [r for r in counts if r["part"] == i]), f"bad{i}", f"n{i}")
        for i, b in enumerate(bins)
    ]
    inside = [(F.col(f"n{folds}") - F.col(f"n{k}"), F.col(f"bad{folds}") - F.col(f"bad{k}")) for k in range(folds)]
    parts = functools.reduce(DataFrame.unionByName, [
        predict_scorecard(card, vectors.filter(n > 0), "_raw").select("_raw", n.alias("_n"), bad.cast("double").alias("_bad")) for card, (n, bad) in zip(cards, inside)])
    summed = sum_scores(parts)
    return cards[-1], fit_isotonic(summed), summed


def sum_scores(scored: DataFrame) -> DataFrame:
    """One weighted row per distinct score of rows (_raw, _n, _bad), so the isotonic fit does not see single rows."""
    return settle(scored.groupBy(half_even("_raw", 6).alias("_raw")).agg(
        (F.sum("_bad") / F.sum("_n")).alias("_y"), F.sum("_n").cast("double").alias("_w"),
    ))


def fit_isotonic(summed: DataFrame):
    return IsotonicRegression(featuresCol="_raw", labelCol="_y", weightCol="_w").fit(summed)


def apply_calibration(iso, df: DataFrame, raw: str, name: str) -> DataFrame:
    iso = iso.copy({iso.featuresCol: raw, iso.predictionCol: name})
    return iso.transform(df).withColumn(name, half_even(F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0)), 6))


def monotonicity_audit(scored: DataFrame, score: str, bins: dict[str, Bins]) -> DataFrame:
    """Correlation of the mean score per bin with the bin's mean value, against the declared sign."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), b.index(F.col(f).cast("double")).alias("bin"), F.col(f).cast("double").alias("x"))
        for f, b in bins.items()
    ])
    per = scored.select(score, F.explode(pairs).alias("s")).groupBy("s.feature", "s.bin").agg(
        F.avg("s.x").alias("x"), F.avg(score).alias("m")
    )
    return per.groupBy("feature").agg(F.count(F.lit(1)).alias("n_bins"), half_even(F.corr("x", "m"), 4).alias("direction")).withColumn(
        "agrees", F.signum("direction") == F.create_map(*[F.lit(v) for kv in P.FEATURE_SIGNS.items() for v in (kv[0], float(kv[1]))])[F.col("feature")]
    )


# ---------------------------------------------------------------- segmentation models

TREE_NUMERIC = ["ticket_size", "tenure_mo", "interest_rate_apr", "approval_tat_hrs", "age", "first_time_borrower", "loan_sequence"]
TREE_GRADES = ["origination_risk_grade", "credit_quality_indicator"]
TREE_CATEGORIES = ["product_type", "region_type", "income_proxy_band", "employment_type", "acquisition_channel"]
NOT_A_FEATURE = {
    "true_latent_risk", "z", "value_proxy", "default_flag", "loan_status", "worst_delq_bucket", "worst_delq_rank",
    "ever_90plus", "months_on_book", "nii", "fee", "loss", "servicing", "cac_charged", "margin_before_cac",
}

#: Categories of one column at most: each becomes a column of the matrix.
MOST_CATEGORIES = 1000


def categories(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Distinct values of low-cardinality columns; a column of more than about MOST_CATEGORIES values is refused before any are collected."""
    if not columns:
        return {}
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict()
    if wide := sorted(c for c, n in counts.items() if n > MOST_CATEGORIES):
        raise ValueError(f"more than {MOST_CATEGORIES} categories in {wide}")
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    rows = df.select(F.explode(pairs).alias("s")).select("s.*").distinct().collect()
    return {c: sorted(r["v"] for r in rows if r["c"] == c and r["v"] is not None) for c in columns}


def design_matrix(frame: DataFrame, values: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """Numeric, ordinal-grade and one-hot columns in one vector; outcome columns are refused."""
    values = categories(frame, TREE_CATEGORIES) if values is None else values
    cols = {c: F.col(c).cast("double") for c in TREE_NUMERIC}
    cols |= {f"{c}_ord": grade_rank(c).cast("double") for c in TREE_GRADES}
    cols |= {f"{c}={v}": (F.col(c) == v).cast("double") for c, vs in values.items() for v in vs}
    leaked = [n for n in cols if n.split("=")[0].lower() in NOT_A_FEATURE]
    if leaked:
        raise ValueError(f"outcome columns among the features: {leaked}")
    names = list(cols)
    wide = frame.select("*", *[c.alias(f"_x{i}") for i, c in enumerate(cols.values())])
    x = [f"_x{i}" for i in range(len(names))]
    return VectorAssembler(inputCols=x, outputCol="features", handleInvalid="keep").transform(wide).drop(*x), names


@dataclass
class BinnedLoans:
    rows: DataFrame  # loan_id, customer_id, months_on_book, default_flag, value_proxy
    data: DataFrame  # loan_id, months_on_book, default_flag, bins
    names: list[str]
    cuts: list[list[float]]

    @property
    def seasoned(self) -> DataFrame:
        return self.data.filter(F.col("months_on_book") >= P.SEASONED_MOB)

    def grow(self, replicates: int, max_leaves: int, min_leaf: int, seed: int) -> list[trees.Tree]:
        return trees.grow(self.seasoned, len(self.names), replicates, max_leaves, min_leaf, "loan_id", "default_flag", seed)


def binned_loans(frame: DataFrame) -> BinnedLoans:
    """The design matrix in bins; cuts come from seasoned loans, which the trees learn from."""
    matrix, names = design_matrix(frame)
    ids = ["loan_id", "customer_id", "months_on_book", "default_flag", "value_proxy"]
    rows = settle(matrix.select(*ids, vector_to_array("features").alias("x")))
    cuts = trees.fit_cuts(rows.filter(F.col("months_on_book") >= P.SEASONED_MOB), "x", len(names))
    data = trees.binned(rows, "x", cuts, "loan_id", "months_on_book", "default_flag")
    return BinnedLoans(rows.select(*ids), data, names, cuts)


def tree_segments(loans: BinnedLoans, grown: list[trees.Tree]) -> DataFrame:
    """Every loan's leaf of the first tree as its segment, T1 safest by seasoned default rate."""
    leaves = trees.assigned(loans.data, grown[:1], len(loans.names), "loan_id").select("loan_id", F.col("leaves")[0].cast("double").alias("leaf"))
    found = settle(loans.rows.join(leaves, "loan_id"))
    return found.withColumn("segment", segment_of_leaf(merge_leaves(found, len(grown[0].leaves))))


def merge_leaves(assigned: DataFrame, max_segments: int) -> dict[float, int]:
    """Leaf to segment number, by seasoned default rate; at most 2^depth rows are looked at here."""
    s = F.col("months_on_book") >= P.SEASONED_MOB
    rows = assigned.groupBy("leaf").agg(
        F.count_if(s).alias("n"), F.count_if(s & (F.col("default_flag") == 1)).alias("bad")
    ).collect()
    groups = sorted(([r["bad"], r["n"], [r["leaf"]]] for r in rows), key=lambda g: (g[0] / max(g[1], 1), g[2]))
    while len(groups) > max_segments:
        gaps = [groups[i + 1][0] / max(groups[i + 1][1], 1) - groups[i][0] / max(groups[i][1], 1) for i in range(len(groups) - 1)]
        i = gaps.index(min(gaps))
        b = groups.pop(i + 1)
        groups[i] = [groups[i][0] + b[0], groups[i][1] + b[1], groups[i][2] + b[2]]
    return {leaf: i + 1 for i, g in enumerate(groups) for leaf in g[2]}


def segment_of_leaf(numbers: dict[float, int]) -> Column:
    out = None
    for leaf, i in numbers.items():
        t = F.col("leaf") == F.lit(leaf)
        out = F.when(t, f"T{i}") if out is None else out.when(t, f"T{i}")
    return out


def value_drivers(matrix: DataFrame, names: list[str], min_leaf: int = 1000) -> DataFrame:
    """Features ranked by their importance for value on seasoned loans."""
    data = matrix.filter(F.col("months_on_book") >= P.SEASONED_MOB).select("features", F.col("value_proxy").cast("double").alias("_y"))
    tree = DecisionTreeRegressor(
        featuresCol="features", labelCol="_y", maxDepth=4, minInstancesPerNode=min_leaf, maxBins=64, seed=20260603
    ).fit(data)
    weights = tree.featureImportances.toArray().tolist()
    rows = sorted(zip(names, weights), key=lambda r: (-r[1], r[0]))[:6]
    return matrix.sparkSession.createDataFrame([(i + 1, n, w) for i, (n, w) in enumerate(rows)], "rank int, feature string, importance double")


CLUSTER_NUMERIC = [
    "age", "cashflow_consistency_mean", "balance_volatility_mean", "credit_utilisation_mean", "app_engagement_mean",
    "bureau_inquiry_velocity_mean", "nach_bounce_total", "spending_shock_rate", "n_loans", "n_products_held",
]
CLUSTER_CATEGORIES = [
    "region_type", "income_proxy_band", "employment_type", "credit_quality_indicator", "acquisition_channel",
    "primary_product", "first_time_borrower",
]


def standardised(df: DataFrame, columns: list[str]) -> tuple[list[Column], dict[str, tuple[float, float]]]:
    """(x - mean) / population deviation; a missing value sits at the mean."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    stats = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}
    return [
        F.coalesce((F.col(c).cast("double") - m) / s, F.lit(0.0)).alias(f"z_{c}") for c, (m, s) in stats.items()
    ], stats


def mixed_features(customers: DataFrame) -> DataFrame:
    z, _ = standardised(customers, CLUSTER_NUMERIC)
    return customers.select("customer_id", *z, *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(f"c_{c}") for c in CLUSTER_CATEGORIES])


def encoded(features: DataFrame, weights: list[Column] | None = None) -> prototypes.Encoded:
    """Features as written codes; weights are those of bootstrap replicates, numbered from 1."""
    nums = [c for c in features.columns if c.startswith("z_")]
    values = categories(features, [c for c in features.columns if c.startswith("c_")])
    return prototypes.encode(features, "customer_id", nums, values, weights)


def cluster_ids(rows: prototypes.Encoded, fit: prototypes.Fit) -> DataFrame:
    """(customer_id, cluster_id)."""
    return prototypes.assigned(rows, [fit]).select("customer_id", F.col("clusters")[0].alias("cluster_id"))


def k_sweep(
    rows: prototypes.Encoded, ks: list[int] = P.CLUSTER_COUNTS, starts: int = P.CLUSTER_STARTS, max_iter: int = P.CLUSTER_ROUNDS, seed: int = 20260603,
) -> tuple[list[tuple[prototypes.Fit, float]], prototypes.Fit]:
    """All ks and starts grow together. Returns the cheapest start of each k with its silhouette over all customers, and the fit of the best silhouette (ties: fewest clusters)."""
    best = prototypes.cheapest(prototypes.fit_all(rows, [(k, seed + i, 0) for k in ks for i in range(starts)], max_iter))
    fits = [best[k, 0] for k in ks]
    judged = list(zip(fits, prototypes.silhouettes(rows, fits), strict=True))
    return judged, max(judged, key=lambda f: (f[1], -f[0].k))[0]


def poisson_row_weight(key: str, replicate: int, seed: int) -> Column:
    """Poisson(1) weight per row from a hash: the resampling of a bootstrap replicate."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(replicate), F.col(key)), F.lit(2**40)).cast("double") + 0.5) / float(2**40)
    out, cum, term = None, 0.0, math.exp(-1.0)
    for i in range(16):  # beyond it lies less than one step of u
        cum += term
        term /= i + 1
        out = F.when(u < cum, i) if out is None else out.when(u < cum, i)
    return out.otherwise(16).cast("double")


def tree_stability(frame: DataFrame, replicates: int = 25, max_leaves: int = P.TREE_LEAVES, min_leaf: int = P.TREE_MIN_LEAF, seed: int = 20260603) -> DataFrame:
    """(replicate, ari): agreement of the leaves of trees grown on resampled loans with those of the tree on the loans; all trees grow together."""
    loans = binned_loans(frame)
    grown = loans.grow(replicates + 1, max_leaves, min_leaf, seed)
    leaves = trees.assigned(loans.data, grown, len(loans.names), "loan_id")
    each = leaves.select(F.col("leaves")[0].alias("base"), F.posexplode(F.slice("leaves", 2, replicates)).alias("replicate", "leaf"))
    return adjusted_rand_by(each, "replicate", "base", "leaf")


def cluster_stability(features: DataFrame, k: int = 4, replicates: int = 3, max_iter: int = 10, seed: int = 20260603) -> DataFrame:
    """(replicate, ari): agreement of clusters fitted to resampled customers with those fitted to the customers; all fits share each scan."""
    rows = encoded(features, [poisson_row_weight("customer_id", b, seed) for b in range(replicates)])
    both = prototypes.assigned(rows, prototypes.fit_all(rows, [(k, seed, w) for w in range(replicates + 1)], max_iter))
    each = both.select(F.col("clusters")[0].alias("base"), F.posexplode(F.slice("clusters", 2, replicates)).alias("replicate", "other"))
    return adjusted_rand_by(each, "replicate", "base", "other")
