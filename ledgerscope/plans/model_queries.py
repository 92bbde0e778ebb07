"""M1-M13, M22, SG6: fits and what can be checked around them.

Fits have no SQL counterpart; bins, counts, standardisation and profiles of a given assignment do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions.numeric import half_even
from ledgerscope.operators import models as M
from ledgerscope.operators import boosting, prototypes, ranks, scoring, segments, trees
from ledgerscope.plans import sql as S
from ledgerscope.plans import warning_queries  # noqa: F401  (scored views)
from ledgerscope.plans.registry import register
from ledgerscope.sources.scratch import settle

def tree_frame(b):
    cols = ["loan_id", "customer_id", "months_on_book", "default_flag", "value_proxy", "product_type", "ticket_size",
            "tenure_mo", "interest_rate_apr", "approval_tat_hrs", "loan_sequence", "origination_risk_grade"]
    people = b.customers.select("customer_id", "age", "first_time_borrower", "credit_quality_indicator", "region_type",
                                "income_proxy_band", "employment_type", "acquisition_channel")
    return settle(b.loans.select(*cols).join(people, "customer_id"))


def grown(b):
    loans = M.binned_loans(tree_frame(b))
    return loans, loans.grow(1, P.TREE_LEAVES, P.TREE_MIN_LEAF, 20260603)


def _design(b):
    matrix, names = M.design_matrix(tree_frame(b))
    from pyspark.ml.functions import vector_to_array

    wide = matrix.select(vector_to_array("features").alias("v"))
    return wide.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(18,2)")).cast("double").alias("total")).select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("feature"), "total")


_cats = {"product_type": P.PRODUCTS, "region_type": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "income_proxy_band": ["Low", "Mid", "High"],
         "employment_type": ["Salaried", "Self-employed", "Gig", "Informal"], "acquisition_channel": P.CHANNELS}
_rank = {g: i + 1 for i, g in enumerate(P.GRADES)}
_feats = {c: c for c in M.TREE_NUMERIC} | {f"{c}_ord": S.case(c, _rank) for c in M.TREE_GRADES} | {
    f"{c}={v}": f"CAST({c} = {S.lit(v)} AS INT)" for c, vs in _cats.items() for v in vs}
register("m01_design_matrix", _design, "loans customers", " UNION ALL ".join(
    f"SELECT {S.lit(n)} AS feature, {S.total(x)} AS total FROM loans JOIN customers USING (customer_id)" for n, x in _feats.items()))
register("m02_risk_tree", lambda b: segments.segment_metrics(
    M.tree_segments(*grown(b)).join(b.originations.select("loan_id", "ticket_size", "interest_rate_apr"), "loan_id")))


def _splits(b):
    loans, found = grown(b)
    rows = trees.split_rows(found[0], loans.names, loans.cuts)
    out = b.spark.createDataFrame(rows, "step int, leaf int, feature string, threshold double, gain double, n long")
    return out.withColumn("threshold", half_even("threshold", 6)).withColumn("gain", half_even("gain", 4))


def _tree_sql() -> str:
    """The splits, step after step, in SQL: of all leaves and cuts the largest drop of class-weighted impurity."""
    cut = f"SELECT f, c FROM (SELECT DISTINCT f, unnest(quantile_cont(x, {[i / trees.BINS for i in range(1, trees.BINS + 1)]!r})) AS c FROM x0 GROUP BY f)"
    impurity = lambda n, bad: f"(2*(({n})-({bad}))*w0*({bad})*w1/greatest((({n})-({bad}))*w0+({bad})*w1, 1e-300))"
    numbers = S.case("f", {n: i for i, n in enumerate(_feats)})
    parts = [
        "d AS (SELECT * FROM loans JOIN customers USING (customer_id) WHERE months_on_book >= " + str(P.SEASONED_MOB) + ")",
        "x0 AS (" + " UNION ALL ".join(f"SELECT loan_id, {S.lit(n)} AS f, CAST({x} AS DOUBLE) AS x, default_flag AS y FROM d" for n, x in _feats.items()) + ")",
        f"cuts AS ({cut})",
        "w AS (SELECT count(*)/(2e0*count(*) FILTER (default_flag = 0)) AS w0, count(*)/(2e0*count(*) FILTER (default_flag = 1)) AS w1 FROM d)",
        "a1 AS (SELECT loan_id, 0 AS leaf FROM d)",
    ]
    for k in range(1, P.TREE_LEAVES):
        parts.append(f"""g{k} AS (SELECT leaf, f, c, count(*) AS n, sum(y) AS bad, count(*) FILTER (x < c) AS nl, coalesce(sum(y) FILTER (x < c), 0) AS bl
          FROM a{k} JOIN x0 USING (loan_id) JOIN cuts USING (f) GROUP BY 1, 2, 3)""")
        parts.append(f"""s{k} AS (SELECT {k} AS step, leaf, f, c, n, {impurity('n', 'bad')} - {impurity('nl', 'bl')} - {impurity('n-nl', 'bad-bl')} AS gain FROM g{k}, w
          WHERE nl >= {P.TREE_MIN_LEAF} AND n - nl >= {P.TREE_MIN_LEAF} QUALIFY row_number() OVER (ORDER BY gain DESC, leaf, {numbers}, c) = 1)""")
        parts.append(f"""a{k + 1} AS (SELECT a{k}.loan_id, CASE WHEN s.f IS NULL THEN a{k}.leaf WHEN x0.x < s.c THEN {2 * k - 1} ELSE {2 * k} END AS leaf
          FROM a{k} LEFT JOIN (SELECT * FROM s{k} WHERE gain > 1e-12) AS s ON a{k}.leaf = s.leaf LEFT JOIN x0 ON x0.loan_id = a{k}.loan_id AND x0.f = s.f)""")
    rows = " UNION ALL ".join(f"SELECT * FROM s{k} WHERE gain > 1e-12" for k in range(1, P.TREE_LEAVES))
    return ",\n".join(parts), f"SELECT CAST(step AS INT) AS step, CAST(leaf AS INT) AS leaf, f AS feature, {S.he('c', 6)} AS threshold, {S.he('gain', 4)} AS gain, n FROM ({rows})"


_tree_parts, _tree_rows = _tree_sql()
register("m02_tree_splits", _splits, "loans customers", f"SELECT * FROM (WITH {_tree_parts} {_tree_rows})")


def _drivers(b):
    frame = tree_frame(b)
    matrix, names = M.design_matrix(frame)
    return M.value_drivers(matrix, names, P.TREE_MIN_LEAF).withColumn("importance", half_even("importance", 6))


register("m03_value_drivers", _drivers)


def features_of(b):
    return settle(M.mixed_features(settle(b.customer_frame)))


register(
    "m04_standardised_features",
    lambda b: M.mixed_features(settle(b.customer_frame)).select("customer_id", *[half_even(f"z_{c}", 6).alias(f"z_{c}") for c in M.CLUSTER_NUMERIC]),
    "cust_frame",
    "SELECT customer_id, " + ", ".join(
        S.he(f"coalesce((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ())/stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0)", 6) + f" AS z_{c}" for c in M.CLUSTER_NUMERIC)
    + " FROM cust_frame",
)


def _clusters(b):
    """Customers, and their clusters by the winner of the sweep."""
    people = settle(b.customer_frame)
    rows = M.encoded(settle(M.mixed_features(people)))
    return people, settle(M.cluster_ids(rows, M.k_sweep(rows)[1]))


def _prototypes(b):
    rows = M.encoded(features_of(b))
    fit = prototypes.fit_all(rows, [(4, SEED, 0)], P.CLUSTER_ROUNDS)[0]
    out = [(i, n, v, None) for i, p in enumerate(prototypes.prototypes_of(rows, fit)) for n, v in p["num"].items()]
    out += [(i, n, None, v) for i, p in enumerate(prototypes.prototypes_of(rows, fit)) for n, v in p["cat"].items()]
    return b.spark.createDataFrame(out, "cluster int, feature string, number double, category string")


def _prototype_sql(k: int = 4, rounds: int = P.CLUSTER_ROUNDS) -> str:
    """The same rounds one after another, from the same starting rows."""
    nums, cats = [f"z_{c}" for c in M.CLUSTER_NUMERIC], [f"c_{c}" for c in M.CLUSTER_CATEGORIES]
    z = [f"round_even(coalesce((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ())/stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0)*1e6, 0) AS z_{c}" for c in M.CLUSTER_NUMERIC]
    v = [f"coalesce(CAST({c} AS VARCHAR), 'none') AS c_{c}" for c in M.CLUSTER_CATEGORIES]
    steps = [f"x AS MATERIALIZED (SELECT customer_id, {', '.join(z + v)} FROM cust_frame)",
             "c AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT customer_id, '{c}' AS j, {c} AS v FROM x" for c in cats) + ")",
             f"""p0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('{SEED}-' || customer_id), customer_id) - 1 AS p, * EXCLUDE (customer_id)
             FROM x ORDER BY md5('{SEED}-' || customer_id), customer_id LIMIT {k})"""]
    cost = " + ".join(f"(x.{c}-p.{c})*(x.{c}-p.{c})" for c in nums)
    miss = " + ".join(f"CAST(x.{c} <> p.{c} AS INT)" for c in cats)
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT customer_id, p FROM (SELECT customer_id, p, row_number() OVER (PARTITION BY customer_id ORDER BY cost, p) AS r
          FROM (SELECT customer_id, p.p, {cost} + 0.5e0*1e12*({miss}) AS cost FROM x, p{r} p)) WHERE r = 1)""")
        steps.append(f"m{r} AS (SELECT p, " + ", ".join(f"round_even(CAST(sum(CAST({c} AS BIGINT)) AS DOUBLE)/count(*), 0) AS {c}" for c in nums) + f" FROM a{r} JOIN x USING (customer_id) GROUP BY 1)")
        steps.append(f"""t{r} AS (SELECT p, {', '.join(f"max(v) FILTER (WHERE j = '{c}') AS {c}" for c in cats)} FROM (
          SELECT p, j, v, row_number() OVER (PARTITION BY p, j ORDER BY n DESC, v) AS r FROM (SELECT p, j, v, count(*) AS n FROM a{r} JOIN c USING (customer_id) GROUP BY 1, 2, 3)) WHERE r = 1 GROUP BY 1)""")
        steps.append(f"p{r + 1} AS MATERIALIZED (SELECT p, {', '.join(f'coalesce(m.{c}, p.{c}) AS {c}' for c in nums)}, {', '.join(f'coalesce(t.{c}, p.{c}) AS {c}' for c in cats)} "
                     f"FROM p{r} p LEFT JOIN m{r} m USING (p) LEFT JOIN t{r} t USING (p))")
    last = [f"SELECT CAST(p AS INT) AS cluster, '{c}' AS feature, {c}/1e6 AS number, CAST(NULL AS VARCHAR) AS category FROM p{rounds}" for c in nums]
    last += [f"SELECT CAST(p AS INT), '{c}', CAST(NULL AS DOUBLE), {c} FROM p{rounds}" for c in cats]
    return f"SELECT * FROM (WITH {', '.join(steps)} {' UNION ALL '.join(last)})"


SEED = 20260603
register("m05_prototypes_of_four", _prototypes, "cust_frame", _prototype_sql())


def _mixed_clusters(b):
    people, ids = _clusters(b)
    seasoned = F.col("months_on_book") >= P.SEASONED_MOB
    loans = b.stored_loans.join(ids, "customer_id")
    return segments.relabel_by_risk(loans, "cluster_id", "C").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_loans"), F.count_if(seasoned).alias("n_seasoned"))


register("m05_mixed_clusters", _mixed_clusters)


def _sweep(b):
    judged, winner = M.k_sweep(M.encoded(features_of(b)))
    rows = [(f.k, round(s, 6), f.cost / prototypes.UNIT, f.rounds, f.k == winner.k) for f, s in judged]
    return b.spark.createDataFrame(rows, "k int, silhouette double, cost double, rounds int, chosen boolean")


register("m06_cluster_count_sweep", _sweep)


def _cluster_profile(b):
    people, ids = _clusters(b)
    named = people.join(ids.withColumnRenamed("cluster_id", "cluster"), "customer_id")
    return segments.cluster_profile(named, b.stored_loans)


register("sg06_cluster_profile", _cluster_profile)

# the same profile on a fixed assignment, so that it can be checked
_top = lambda c: f"""(SELECT cluster, v AS top_{c}, {S.he('100*n/CAST(tot AS DOUBLE)', 4)} AS top_{c}_pct FROM (SELECT cluster, {c} AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS tot,
  row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {c}) AS r FROM people GROUP BY 1, 2) WHERE r = 1)"""  # noqa: E731
S.view("people", "cust_frame", "SELECT *, customer_id % 4 AS cluster FROM cust_frame WHERE n_loans IS NOT NULL")
register(
    "sg06_profile_of_fixed_groups",
    lambda b: segments.cluster_profile(b.customer_frame.filter(F.col("n_loans").isNotNull()).withColumn("cluster", F.col("customer_id") % 4), b.loans),
    "people loans",
    f"""SELECT p.*, n_loans, loan_default_pct, mean_value, total_value, pct_loss_making, {', '.join(f't{i}.top_{c}, t{i}.top_{c}_pct' for i, c in enumerate(('region_type', 'income_proxy_band', 'employment_type', 'primary_product')))},
  {S.he('100*' + S.ratio('n_customers', 'sum(n_customers) OVER ()'), 4)} AS pct_customers FROM (
  SELECT cluster, count(*) AS n_customers, {S.he(S.mean('age'), 4)} AS mean_age, {S.he(S.mean('cashflow_consistency_mean', 6), 4)} AS mean_cashflow,
    {S.he(S.mean('credit_utilisation_mean', 6), 4)} AS mean_utilisation, {S.he(S.mean('spending_shock_rate', 6), 4)} AS mean_shock_rate,
    {S.he('100*' + S.rate('any_default = 1'), 4)} AS customer_default_pct, {S.he(S.mean('clv'), 2)} AS mean_clv FROM people GROUP BY 1) p JOIN (
  SELECT customer_id % 4 AS cluster, count(*) AS n_loans, {S.he('100*' + S.ratio(S.n_if('months_on_book >= 3 AND default_flag = 1'), S.n_if('months_on_book >= 3')), 4)} AS loan_default_pct,
    {S.he(S.mean('value_proxy'), 2)} AS mean_value, {S.total('value_proxy')} AS total_value, {S.he('100*' + S.rate('value_proxy < 0'), 4)} AS pct_loss_making FROM loans GROUP BY 1) l USING (cluster)
""" + " ".join(f"JOIN {_top(c)} t{i} USING (cluster)" for i, c in enumerate(("region_type", "income_proxy_band", "employment_type", "primary_product"))),
)

# ---------------------------------------------------------------- scorecard
TRAIN = "(SELECT * FROM scored WHERE split_oot = 'train')"


def train_rows(b):
    return b.scored.filter(F.col("split_oot") == "train")


def _bins(b):
    bins = M.fit_bins(train_rows(b))
    rows = [(f, v.by_value, i, round(p, 6)) for f, v in bins.items() for i, p in enumerate(v.points)]
    return b.spark.createDataFrame(rows, "feature string, by_value boolean, i int, point double")


_bin_parts = []
for _f in P.FEATURES:
    _x = f"CAST({_f} AS DOUBLE)"
    _few = f"(SELECT count(DISTINCT {_f}) <= 6 FROM {TRAIN})"
    _bin_parts.append(f"SELECT '{_f}' AS feature, true AS by_value, CAST(row_number() OVER (ORDER BY x) - 1 AS INT) AS i, {S.he('x', 6)} AS point FROM (SELECT DISTINCT {_x} AS x FROM {TRAIN}) WHERE {_few}")
    _bin_parts.append(f"SELECT '{_f}' AS feature, false AS by_value, CAST(row_number() OVER (ORDER BY x) - 1 AS INT) AS i, {S.he('x', 6)} AS point FROM (SELECT DISTINCT unnest(quantile_cont({_x}, {[i / 6 for i in range(1, 6)]!r})) AS x FROM {TRAIN}) WHERE NOT {_few}")
register("m07_bin_points", _bins, "scored", " UNION ALL ".join(_bin_parts))
# counts per bin on fixed cut points, to check the grouped pass
CUTS = {"utilisation_level": [30.0, 50.0, 70.0], "cashflow_consistency_level": [0.4, 0.5, 0.6], "bounce_count_3m": [1.0, 2.0]}
register(
    "m08_bin_counts", lambda b: M.bin_counts(train_rows(b), {f: M.Bins(False, c) for f, c in CUTS.items()}).drop("mean_x"), "scored",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST(" + " + ".join(f"CAST(CAST({f} AS DOUBLE) >= {x}e0 AS INT)" for x in c)
                       + f" AS INT) AS bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS bad FROM {TRAIN} GROUP BY 1, 2" for f, c in CUTS.items()),
)


def _woe(b):
    train = settle(train_rows(b))
    card = M.fit_woe(train, M.fit_bins(train))
    rows = [(f, int(k), round(w, 6)) for f, ws in card.woe.items() for k, w in ws.items()]
    return b.spark.createDataFrame(rows, "feature string, bin int, woe double")


register("m08_woe", _woe)


def _audit(b):
    train = settle(train_rows(b))
    return M.scorecard_audit(b.spark, M.fit_scorecard(train))


register("m09_m10_m13_scorecard", _audit)


def _logistic(b):
    """Two features only, so that SQL can take the same Newton steps."""
    data = train_rows(b).select(F.array(*[F.expr(x) for x in TWO.values()]).alias("x"), F.col("label").cast("double").alias("y"))
    fit = M.newton_logistic(data, len(TWO))
    rows = [(n, round(v, 6), fit.gradient < 1e-8) for n, v in zip(["intercept", *TWO], [fit.intercept, *fit.coefficients])]
    return b.spark.createDataFrame(rows, "term string, beta double, converged boolean")


TWO = {"utilisation": "CAST(utilisation_level AS DOUBLE)/100", "days": "CAST(dpd_current AS DOUBLE)/30"}


def _newton_sql(rounds: int = 15) -> str:
    steps = ["d AS (SELECT CAST(label AS DOUBLE) AS y, " + ", ".join(f"{x} AS x{i + 1}" for i, x in enumerate(TWO.values())) + f" FROM {TRAIN})",
             "b0 AS (SELECT 0e0 AS b0, 0e0 AS b1, 0e0 AS b2)"]
    p = "(1/(1+exp(-(b0+b1*x1+b2*x2))))"
    x = ["1", "x1", "x2"]
    for k in range(rounds):
        sums = ", ".join([f"sum(({p}-y)*{x[i]}) + {int(i > 0)}*any_value(b{i}) AS g{i}" for i in range(3)]
                         + [f"sum({p}*(1-{p})*{x[i]}*{x[j]}) + {int(i == j and i > 0)} AS h{i}{j}" for i in range(3) for j in range(i, 3)])
        steps.append(f"m{k} AS (SELECT {sums}, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2 FROM d, b{k})")
        steps.append(f"""i{k} AS (SELECT *, h11*h22-h12*h12 AS c00, h02*h12-h01*h22 AS c01, h01*h12-h02*h11 AS c02, h00*h22-h02*h02 AS c11, h01*h02-h00*h12 AS c12,
          h00*h11-h01*h01 AS c22 FROM m{k})""")
        det = "(h00*c00+h01*c01+h02*c02)"
        steps.append(f"""b{k + 1} AS (SELECT b0-(c00*g0+c01*g1+c02*g2)/{det} AS b0, b1-(c01*g0+c11*g1+c12*g2)/{det} AS b1, b2-(c02*g0+c12*g1+c22*g2)/{det} AS b2 FROM i{k})""")
    last = " UNION ALL ".join(f"SELECT {S.lit(n)} AS term, {S.he(f'b{i}', 6)} AS beta, true AS converged FROM b{rounds}" for i, n in enumerate(["intercept", *TWO]))
    return f"SELECT * FROM (WITH {', '.join(steps)} {last})"


register("m10_logistic_of_two", _logistic, "scored", _newton_sql())


def _coefficients(b):
    train = settle(train_rows(b))
    card = M.fit_scorecard(train)
    rows = [("intercept", round(card.model.intercept, 6), card.model.gradient < 1e-8)] + [(f, round(v, 6), card.model.gradient < 1e-8) for f, v in card.betas.items()]
    return b.spark.createDataFrame(rows, "term string, beta double, converged boolean")


register("m10_logistic_coefficients", _coefficients)


def _boosted(b):
    model, iso = b.boosted
    test = M.predict_boosted(model, b.test_rows, "raw")
    return scoring.by_population(settle(M.apply_calibration(iso, test, "raw", "gbm").drop("raw")), "gbm")


register("m11_boosted_challenger", _boosted)
register("m11_monotone_steps", lambda b: boosting.steps_against(b.test_rows, b.boosted[0]))


def _monotone(b):
    train = settle(train_rows(b))
    return M.monotonicity_audit(M.predict_boosted(b.boosted[0], b.test_rows, "gbm"), "gbm", M.fit_bins(train))


register("m13_monotonicity_audit", _monotone)


def _calibrated(b):
    data = settle(b.scored)
    train = data.filter(F.col("split_oot") == "train")
    card, iso, oof = M.calibrate_scorecard(train)
    test = M.predict_scorecard(card, data.filter(F.col("split_oot") == "test"), "raw")
    scored = settle(M.apply_calibration(iso, test, "raw", "score_scorecard").drop("raw"))
    return scoring.by_population(scored, "score_scorecard").join(
        scoring.calibration(scored, ["score_scorecard"]).select("mean_predicted", "actual").withColumn("population", F.lit("all")), "population", "left")


register("m12_calibrated_scorecard", _calibrated)


def _tree_stability(b):
    return M.tree_stability(tree_frame(b), P.TREE_REFITS)


register("m22_tree_stability", _tree_stability)
register("m22_cluster_stability", lambda b: M.cluster_stability(features_of(b), 4, P.CLUSTER_REFITS, P.REFIT_ROUNDS))


def _folds(b):
    train = settle(train_rows(b).select("loan_id"))
    dealt = train.join(M.grouped_folds(train, "loan_id"), "loan_id")
    return dealt.groupBy(F.col("_fold").alias("fold")).agg(F.count_distinct("loan_id").alias("n_loans"), F.count(F.lit(1)).alias("n_rows"))


register("m12_grouped_folds", _folds, "scored", f"""SELECT CAST(CASE WHEN (r // 5) % 2 = 1 THEN 4 - r % 5 ELSE r % 5 END AS INT) AS fold, count(*) AS n_loans, CAST(sum(n) AS BIGINT) AS n_rows
  FROM (SELECT n, row_number() OVER (ORDER BY n DESC, loan_id) - 1 AS r FROM (SELECT loan_id, count(*) AS n FROM {TRAIN} GROUP BY 1)) GROUP BY 1""")
