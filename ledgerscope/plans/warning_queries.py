"""EW1-EW22 and M14-M21: the early-warning chain, on a fixed formula score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.operators import gates, ranks, scoring, warning
from ledgerscope.plans import sql as S
from ledgerscope.plans import sql_frames  # noqa: F401
from ledgerscope.plans.pipeline import DECILE_ORDER
from ledgerscope.plans.registry import register
from ledgerscope.sources import views as V

register("ew01_observation_spine", lambda b: b.spine, "spine", "SELECT * FROM spine")
register("ew02_forward_label", lambda b: b.labelled, "labelled", "SELECT * FROM labelled")
register("ew02_label_of_stored_spine", lambda b: warning.forward_label(b.spine, b.repayments, b.originations), "labelled", "SELECT * FROM labelled")


def base_sql(key: str) -> str:
    return f"""SELECT {key}, count(*) AS n_spine, {S.n_if('label = -1')} AS n_censored, {S.n_if('label >= 0')} AS n_labelled,
  {S.n_if('label = 1')} AS n_pos, {S.he(S.ratio(S.n_if('label = 1'), S.n_if('label >= 0')), 6)} AS base_rate FROM outcome_spine GROUP BY 1"""


register("ew03_base_rate_by_segment", lambda b: warning.base_rates(b.outcome_spine, "segment"), "outcome_spine", base_sql("segment"))
register("ew03_base_rate_by_month", lambda b: warning.base_rates(b.outcome_spine, "obs_month"), "outcome_spine", base_sql("obs_month"))
_b = ["bounce_streak", "bounce_count_3m", "spending_shock_recency", "inquiry_velocity_accel", "app_engagement_drop"]
register(
    "ew04_behaviour_features", lambda b: warning.behaviour_features(b.behaviour), "bfeat",
    f"SELECT * EXCLUDE (obs_month, {', '.join(_b)}), obs_month AS month, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _b)} FROM bfeat",
)
register("ew05_repayment_features", lambda b: warning.repayment_features(b.repayments), "rfeat",
         "SELECT * REPLACE (CAST(partial_run AS BIGINT) AS partial_run) FROM rfeat")
_f = P.FEATURES + P.ESCALATION_FEATURES
register(
    "ew06_feature_matrix",
    lambda b: b.matrix.select("loan_id", "customer_id", "obs_month", "months_on_book", "product_type", "segment", "label",
                              *[F.col(f).cast("double").alias(f) for f in _f]),
    "matrix",
    "SELECT loan_id, customer_id, obs_month, months_on_book, product_type, segment, label, "
    + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in _f) + " FROM matrix",
)
_sign = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {s} AS declared, {S.he(f'coalesce(corr(CAST({f} AS DOUBLE), CAST(label AS DOUBLE)), 0)', 6)} AS corr FROM matrix"
    for f, s in P.FEATURE_SIGNS.items()
)
register("ew07_sign_check", lambda b: warning.sign_check(b.matrix), "matrix",
         f"SELECT *, CAST(abs(corr) < 1e-6 OR sign(corr) = declared AS INT) AS matches FROM ({_sign})")
_rules = {
    "two_partials_plus_bounce": "partial_run >= 2 AND coalesce(nach_bounce_count, 0) >= 1", "bounce_streak_2": "bounce_streak >= 2",
    "shock_plus_util_creep": "coalesce(spending_shock_flag, 0) = 1 AND utilisation_creep_3m >= 10", "already_delinquent_30dpd": "dpd_current >= 30",
}
register(
    "ew08_trigger_flags",
    lambda b: warning.trigger_flags(b.matrix).select(
        "loan_id", "months_on_book", *_rules, "escalate", F.concat_ws(",", "fired").alias("fired")),
    "matrix",
    f"""SELECT loan_id, months_on_book, {', '.join(f'CAST({c} AS INT) AS {n}' for n, c in _rules.items())}, CAST(dpd_current >= 30 AS INT) AS escalate,
  concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _rules.items())}) AS fired FROM matrix""",
)
_key = "((loan_id*7919 + 104729) % 1000003)"
S.view("split_rows", "scored", f"""
SELECT m.*, CASE WHEN r <= round_even(0.25e0*n, 0) THEN 'test' ELSE 'train' END AS split_within FROM scored m JOIN (
  SELECT loan_id, row_number() OVER (PARTITION BY segment, any_pos ORDER BY {_key}, loan_id) AS r, count(*) OVER (PARTITION BY segment, any_pos) AS n
  FROM (SELECT loan_id, min(segment) AS segment, max(label) AS any_pos FROM matrix GROUP BY 1)) USING (loan_id)""")


def split_rows(b):
    return warning.within_time_split(b.scored)


register(
    "ew09_within_time_split",
    lambda b: split_rows(b).groupBy("segment", "split_within").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_pos"), F.sum(F.col("loan_id") % 1009).alias("key_sum")),
    "split_rows",
    "SELECT segment, split_within, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(loan_id % 1009) AS BIGINT) AS key_sum FROM split_rows GROUP BY 1, 2",
)
register(
    "ew10_out_of_time_split",
    lambda b: b.scored.groupBy("obs_month", "split_oot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_pos")),
    "scored", "SELECT obs_month, split_oot, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_pos FROM scored GROUP BY 1, 2",
)
_audit = " UNION ALL ".join(
    f"""SELECT '{n}' AS split, {c} AS part, count(*) AS n_rows, count(DISTINCT loan_id) AS n_loans, CAST(sum(label) AS BIGINT) AS n_pos,
  {S.he(S.ratio('sum(label)', 'count(*)'), 6)} AS base_rate, CAST(min(obs_month) AS BIGINT) AS first_month, CAST(max(obs_month) AS BIGINT) AS last_month,
  CAST(max(obs_month) + 3 AS BIGINT) AS window_end FROM split_rows GROUP BY 2"""
    for n, c in (("within", "split_within"), ("oot", "split_oot"))
)
register("ew11_split_audit", lambda b: warning.split_audit(split_rows(b)), "split_rows", _audit)
register(
    "ew11_loans_in_both", lambda b: warning.loans_in_both(split_rows(b), "split_within").select(
        F.lit("within").alias("split"), "n_both").unionByName(
        warning.loans_in_both(b.scored, "split_oot").select(F.lit("oot").alias("split"), "n_both")),
    "split_rows",
    " UNION ALL ".join(f"""SELECT '{n}' AS split, count(*) AS n_both FROM (SELECT loan_id FROM split_rows WHERE {c} = 'train'
  INTERSECT SELECT loan_id FROM split_rows WHERE {c} = 'test')""" for n, c in (("within", "split_within"), ("oot", "split_oot"))),
)

# band cuts: capacities scaled to the size of the views' book
RED, AMBER = 0.05, 0.20


def picked(prob: str) -> str:
    """Interpolated quantile of the operating book's score at a computed probability."""
    h = f"({prob}*(n - 1))"
    at = lambda side: f"max(CASE WHEN r = CAST({side}({h}) AS BIGINT) + 1 THEN score END)"
    return (f"(SELECT {at('floor')} + ({at('ceil')} - {at('floor')})*(max({h}) - floor(max({h}))) FROM (SELECT score, red_frac, amber_frac, "
            "row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM test_rows CROSS JOIN fractions WHERE dpd_current < 30))")


S.view("fractions", "test_rows", f"""
SELECT *, least(red_cap/monthly, 1e0) AS red_frac, least(amber_cap/monthly, 1e0 - least(red_cap/monthly, 1e0)) AS amber_frac FROM (
  SELECT count(DISTINCT obs_month) AS months, {S.n_if('dpd_current < 30')} AS n_operating,
    CAST({S.n_if('dpd_current < 30')} AS DOUBLE)/count(DISTINCT obs_month) AS monthly,
    greatest(round_even({RED}e0*{S.n_if('dpd_current < 30')}/count(DISTINCT obs_month), 0), 1e0) AS red_cap,
    greatest(round_even({AMBER}e0*{S.n_if('dpd_current < 30')}/count(DISTINCT obs_month), 0), 1e0) AS amber_cap FROM test_rows)""")
S.view("cuts", "test_rows fractions", f"""
SELECT months, n_operating, red_frac, amber_frac, {picked('(1e0 - red_frac)')} AS red_cut,
  {picked('greatest(1e0 - red_frac - amber_frac, 0e0)')} AS amber_cut FROM fractions""")


def cuts_of(b):
    t = b.test_rows
    row = t.filter(F.col("dpd_current") < P.ESCALATION_DPD).agg(F.count(F.lit(1)).alias("n")).first()
    months = t.groupBy("obs_month").agg(F.lit(1).alias("_")).count()
    caps = [max(float(round(s * row["n"] / months)), 1.0) for s in (RED, AMBER)]
    return warning.band_cuts(t, "score", *caps)


def cuts_frame(b):
    c = cuts_of(b)
    return b.spark.createDataFrame(
        [(c["months"], c["n_operating"], *[round(c[k], 6) for k in ("red_frac", "amber_frac", "red_cut", "amber_cut")])],
        "months long, n_operating long, red_frac double, amber_frac double, red_cut double, amber_cut double")


register("ew12_band_cuts", cuts_frame, "cuts",
         f"SELECT months, n_operating, {', '.join(S.he(c, 6) + f' AS {c}' for c in ('red_frac', 'amber_frac', 'red_cut', 'amber_cut'))} FROM cuts")
_band = "CASE WHEN dpd_current >= 30 THEN 'ESCALATION' WHEN score >= red_cut THEN 'RED' WHEN score >= amber_cut THEN 'AMBER' ELSE 'GREEN' END"
S.view("banded_test", "test_rows cuts", f"SELECT t.*, months, red_cut, {_band} AS band FROM test_rows t CROSS JOIN cuts")


def lead_sql(threshold: str) -> str:
    return f"""(SELECT loan_id, {S.he('(default_month - first_flag)*30.44e0', 4)} AS lead_days, first_flag FROM (
  SELECT t.loan_id, min(obs_month) FILTER (WHERE score >= {threshold}) AS first_flag, max(default_month) AS default_month
  FROM test_rows t JOIN loan_events e ON t.loan_id = e.loan_id WHERE dpd_current < 30 AND default_month >= 20 GROUP BY 1))"""


_red_lead = f"(SELECT {S.he('avg(lead_days)', 4)} FROM {lead_sql('(SELECT red_cut FROM cuts)')})"
_justified = lambda: P.COST_FALSE_ALARM / (P.COST_FALSE_ALARM + P.COST_MISSED_DEFAULT)
register(
    "ew14_threshold_table",
    lambda b: warning.threshold_table(b.test_rows, b.repayments, "score", cuts_of(b), V.TEST_FROM), "banded_test loan_events cuts",
    f"""SELECT band, n, {S.he('n/CAST(months AS DOUBLE)', 4)} AS vol_per_month,
  {S.he("CASE WHEN band <> 'ESCALATION' THEN " + S.ratio('n', "sum(CASE WHEN band <> 'ESCALATION' THEN n END) OVER ()") + " END", 6)} AS pct_book,
  {S.he(S.ratio('pos', 'n'), 6)} AS precision,
  {S.he("CASE WHEN band <> 'ESCALATION' THEN " + S.ratio('pos', "greatest(sum(CASE WHEN band <> 'ESCALATION' THEN pos END) OVER (), 1)") + " END", 6)} AS recall,
  CASE band WHEN 'RED' THEN {_red_lead} WHEN 'ESCALATION' THEN 0e0 END AS mean_lead_days, {S.case('band', P.BAND_ACTION)} AS action,
  CASE WHEN band = 'RED' THEN CAST({S.ratio('pos', 'n')} >= {_justified()!r} AS INT) END AS cost_justified
FROM (SELECT band, max(months) AS months, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM banded_test GROUP BY 1)""",
)
_distress = "(bounce_streak >= 2 OR bounce_count_3m >= 3 OR (utilisation_level >= 70 AND spending_shock_rate_3m > 0))"
S.view("snap", "banded_test", f"SELECT *, CAST({_distress} AS INT) AS is_behavioural_distress FROM banded_test WHERE obs_month = 22")
SNAP = 22
register(
    "ew15_watchlist", lambda b: warning.watchlist(b.scored, "score", cuts_of(b), SNAP), "snap",
    f"""SELECT loan_id, customer_id, segment, product_type, obs_month, CAST(dpd_current AS INT) AS dpd_current, {S.he('score', 4)} AS ews_score, band, is_behavioural_distress,
  {S.case('band', P.BAND_ACTION)} AS recommended_action FROM snap WHERE band <> 'GREEN'""",
)
register(
    "ew16_flag_rates", lambda b: warning.flag_rates(b.scored, "score", cuts_of(b), SNAP), "snap",
    f"""SELECT segment, count(*) AS n, {S.he(S.rate("band='ESCALATION'"), 4)} AS pct_escalation, {S.he(S.rate("band='RED'"), 4)} AS pct_red,
  {S.he(S.rate("band='AMBER'"), 4)} AS pct_amber, {S.he(S.rate("band IN ('RED','AMBER')"), 4)} AS pct_watchlist FROM snap GROUP BY 1""",
)
_d = "is_behavioural_distress = 1"
_coh = S.ratio(S.n_if(f"{_d} AND label = 1"), S.n_if(_d))
register(
    "ew17_distress_cohort", lambda b: warning.distress_cohort(b.scored, "score", cuts_of(b), SNAP), "snap",
    f"""SELECT count(*) AS n_snapshot, {S.n_if(_d)} AS n_distress, {S.he(_coh, 6)} AS distress_default_rate, {S.he(S.rate('label = 1'), 6)} AS snapshot_default_rate,
  {S.he(S.ratio(_coh, S.rate('label = 1')), 6)} AS lift, {S.he(S.ratio(S.n_if(f"{_d} AND band IN ('RED','ESCALATION')"), S.n_if(_d)), 6)} AS share_red_or_escalation FROM snap""",
)
register(
    "ew18_score_by_months_to_default", lambda b: warning.score_by_months_to_default(b.test_rows, b.repayments, "score", V.TEST_FROM),
    "test_rows loan_events",
    f"""SELECT default_month - obs_month AS months_to_default, count(*) AS n, {S.he(S.mean('score', 6), 6)} AS mean_score FROM test_rows JOIN loan_events USING (loan_id)
WHERE default_month >= 20 AND default_month - obs_month BETWEEN 1 AND 6 GROUP BY 1""",
)


def top_cut(b, share):
    return ranks.quantile_values(b.test_rows.filter(F.col("dpd_current") < P.ESCALATION_DPD), F.col("score"), [1 - share])[0]


def _lead_query(name, share):
    leads = lead_sql(f"(SELECT quantile_cont(score, {1 - share}e0) FROM test_rows WHERE dpd_current < 30)")
    register(
        name, lambda b: warning.lead_summary(warning.lead_times(b.test_rows, b.repayments, "score", F.lit(top_cut(b, share)), V.TEST_FROM)),
        "test_rows loan_events",
        f"""SELECT count(*) AS n_defaulters, count(first_flag) AS flagged_early, {S.he(S.ratio('count(first_flag)', 'count(*)'), 6)} AS early_detection_rate,
  {S.he('avg(lead_days)', 4)} AS mean_lead_days, {S.he('quantile_cont(lead_days, 0.5)', 4)} AS median_lead_days FROM {leads}""",
    )


_lead_query("ew19_lead_time", 0.1)
_lead_query("ew19_lead_time_top_05", 0.05)
_lead_query("ew19_lead_time_top_20", 0.2)
S.view("risk20", "repayments loans behaviour", f"""
SELECT loan_id, max(default_flag) AS default_flag, {S.he('1e0 - CAST(min(cashflow_consistency) AS DOUBLE) + CAST(max(balance_volatility) AS DOUBLE)', 6)} AS score
FROM repayments JOIN loans USING (loan_id) JOIN behaviour b ON b.customer_id = loans.customer_id AND b.month = repayments.obs_month GROUP BY 1""")
register("ew20_behaviour_risk", lambda b: warning.behaviour_risk(b.repayments, b.loans, b.behaviour), "risk20", "SELECT * FROM risk20")
S.view("lead21", "loan_events loans behaviour", """
SELECT e.loan_id, any_value(default_month) AS default_month, max(default_month - b.month) AS onset, max(default_month - b.month)*30 AS lead_days
FROM loan_events e JOIN loans o ON e.loan_id = o.loan_id LEFT JOIN behaviour b ON b.customer_id = o.customer_id
  AND default_month - b.month BETWEEN 1 AND 6 AND b.cashflow_consistency < 0.6 WHERE default_month IS NOT NULL GROUP BY 1""")
register("ew21_deterioration_lead", lambda b: warning.deterioration_lead(b.repayments, b.loans, b.behaviour), "lead21", "SELECT * FROM lead21")
register(
    "ew22_never_defaulted_share", lambda b: warning.never_defaulted_share(b.repayments), "repayments",
    f"""SELECT {S.n_if('w > 0')} AS n_delinquent, {S.he(S.ratio(S.n_if('w > 0 AND w < 90'), S.n_if('w > 0')), 6)} AS share_never_90
FROM (SELECT loan_id, max(dpd) AS w FROM repayments GROUP BY 1)""",
)

# ---------------------------------------------------------------- discrimination on a given score


def disc_sql(source: str, keys: str = "", where: str = "true") -> str:
    """Pairwise-free AUC and KS in SQL: cumulative counts over distinct scores."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""SELECT {k}max(pa + qa) AS n, max(pa) AS pos, {S.he('max(pa)/CAST(max(pa + qa) AS DOUBLE)', 6)} AS base_rate,
  {S.he('CAST(sum(p*(2*qb + q)) AS DOUBLE)/(CASE WHEN max(pa) > 0 AND max(qa) > 0 THEN 2e0*CAST(max(pa) AS DOUBLE)*CAST(max(qa) AS DOUBLE) END)', 6)} AS auc,
  {S.he(f"max({S.ratio('(pa - pb)', 'pa')} - {S.ratio('(qa - qb)', 'qa')})", 6)} AS ks FROM (
  SELECT *, CAST(coalesce(sum(p) OVER w, 0) AS BIGINT) AS pb, CAST(coalesce(sum(q) OVER w, 0) AS BIGINT) AS qb,
    CAST(sum(p) OVER ({part}) AS BIGINT) AS pa, CAST(sum(q) OVER ({part}) AS BIGINT) AS qa FROM (
    SELECT {k}score, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS q FROM ({source}) WHERE {where} GROUP BY {k}score)
  WINDOW w AS ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) {'GROUP BY ' + keys if keys else ''}"""


register("m14_auc_single_feature", lambda b: ranks.discrimination(
    warning.behaviour_risk(b.repayments, b.loans, b.behaviour), "score", "default_flag"), "risk20",
    disc_sql("SELECT *, default_flag AS y FROM risk20"))
register("m15_ks_out_of_time", lambda b: ranks.discrimination(b.test_rows.filter(F.col("dpd_current") == 0), "score", "label"), "test_rows",
         disc_sql("SELECT *, label AS y FROM test_rows", where="dpd_current = 0"))
S.view("clean_deciles", "test_rows", """
SELECT *, CAST(greatest(ceil((r - 1)*10/(n - 1e0)) - 1, 0) AS INT) AS decile FROM (
  SELECT *, row_number() OVER (ORDER BY score, loan_id, months_on_book) AS r, count(*) OVER () AS n FROM test_rows WHERE dpd_current = 0)""")
register(
    "m16_decile_table", lambda b: scoring.lift_table(b.test_rows.filter(F.col("dpd_current") == 0), "score", DECILE_ORDER), "clean_deciles",
    f"SELECT decile, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, {S.he(S.rate('label = 1'), 6)} AS rate FROM clean_deciles GROUP BY 1",
)
register(
    "m16_top_decile_lift", lambda b: scoring.top_decile_lift(b.test_rows.filter(F.col("dpd_current") == 0), "score", DECILE_ORDER), "clean_deciles",
    f"SELECT {S.he(S.ratio(S.ratio(S.n_if('decile = 9 AND label = 1'), S.n_if('decile = 9')), S.rate('label = 1')), 6)} AS lift FROM clean_deciles",
)
_op = "(SELECT * FROM test_rows WHERE dpd_current < 30)"
register(
    "m17_precision_recall", lambda b: scoring.precision_recall(b.test_rows.filter(F.col("dpd_current") < 30), "score"), "test_rows",
    " UNION ALL ".join(
        f"""SELECT {s}e0 AS top_share, {S.he('max(t)', 6)} AS threshold, {S.n_if('score >= t')} AS n_flagged,
  {S.he(S.n_if('score >= t AND label = 1') + '/CAST(greatest(' + S.n_if('score >= t') + ', 1) AS DOUBLE)', 6)} AS precision,
  {S.he(S.n_if('score >= t AND label = 1') + '/CAST(greatest(' + S.n_if('label = 1') + ', 1) AS DOUBLE)', 6)} AS recall
FROM {_op} CROSS JOIN (SELECT quantile_cont(score, {1 - s!r}) AS t FROM {_op})""" for s in (0.05, 0.1, 0.2)),
)
register(
    "m18_by_population", lambda b: scoring.by_population(b.test_rows, "score"), "test_rows",
    disc_sql(" UNION ALL ".join(f"SELECT '{p}' AS population, score, label AS y FROM test_rows WHERE {c}" for p, c in (
        ("clean", "dpd_current = 0"), ("operating", "dpd_current < 30"), ("all", "true"))), "population"),
)
_prio = ", ".join(S.lit(s) for s in P.PRIORITY_SEGMENTS)
register("m18_by_priority_segment", lambda b: scoring.by_segment(b.test_rows, "score"), "test_rows",
         disc_sql("SELECT *, label AS y FROM test_rows", "segment", f"dpd_current < 30 AND segment IN ({_prio})"))
_resampled = f"""
r AS (SELECT score, label, CAST(loan_id AS VARCHAR) || ':' || CAST(months_on_book AS VARCHAR) AS k, unnest(generate_series(0, 199)) AS replicate FROM test_rows WHERE dpd_current < 30),
v AS (SELECT score, label, replicate, CAST('0x' || substr(md5('20260603:' || k || ':' || CAST(replicate // 4 AS VARCHAR)), CAST(replicate % 4 * 8 + 1 AS INT), 8) AS BIGINT) AS v FROM r),
c AS (SELECT replicate, score, coalesce(sum(w) FILTER (label = 1), 0) AS p, coalesce(sum(w) FILTER (label = 0), 0) AS q
      FROM (SELECT *, {' + '.join(f'CAST(v >= {b} AS INT)' for b in scoring.POISSON_BOUNDS)} AS w FROM v) GROUP BY 1, 2),
t AS (SELECT replicate, p, q, coalesce(sum(q) OVER (PARTITION BY replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT replicate, {S.he('CAST(sum(p * (2 * below + q)) AS DOUBLE) / (2e0 * sum(p) * sum(q))', 6)} AS auc FROM t GROUP BY 1 HAVING sum(p) > 0 AND sum(q) > 0)"""
_operating = lambda b: b.test_rows.filter(F.col("dpd_current") < 30)
register("m19_replicate_auc", lambda b: scoring.replicate_auc(_operating(b), "score", "label", ["loan_id", "months_on_book"], 200), "test_rows",
         f"SELECT * FROM (WITH {_resampled} SELECT CAST(replicate AS INT) AS replicate, auc FROM a)")
register("m19_bootstrap_auc", lambda b: scoring.bootstrap_auc(_operating(b), "score", "label", ["loan_id", "months_on_book"], 200), "test_rows",
         f"""SELECT * FROM (WITH {_resampled} SELECT count(*) AS replicates, {S.he(S.ratio(S.total('auc', 6), 'count(*)'), 6)} AS mean_auc,
         {S.he('quantile_cont(auc, 0.025)', 6)} AS lo, {S.he('quantile_cont(auc, 0.975)', 6)} AS hi FROM a)""")
register(
    "m20_calibration", lambda b: scoring.calibration(b.test_rows, ["score"]), "test_rows",
    f"SELECT 'score' AS score, count(*) AS n, {S.he(S.mean('test_rows.score', 6), 6)} AS mean_predicted, {S.he(S.rate('label = 1'), 6)} AS actual FROM test_rows",
)
register(
    "m21_top_coincidence", lambda b: scoring.coincidence(b.test_rows, "score", DECILE_ORDER), "test_rows",
    f"""SELECT count(*) AS n_top, {S.he(S.rate('dpd_current >= 30'), 6)} AS share_30, {S.he(S.rate('dpd_current >= 60'), 6)} AS share_60 FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, loan_id, months_on_book) AS r, count(*) OVER () AS n FROM test_rows) WHERE r <= greatest(n//100, 1)""",
)
register(
    "q11_leakage_audit", lambda b: gates.leakage(b.test_rows, b.latent_risk, "score"), "test_rows latent_risk",
    f"""SELECT corr, 0 AS n_forbidden, corr < 0 AS clean FROM (
  SELECT {S.he('corr(score, true_latent_risk)', 6)} AS corr FROM test_rows LEFT JOIN latent_risk USING (customer_id))""",
)
register("q10_score_gate", lambda b: gates.score_gate(
    b.test_rows, b.repayments, b.latent_risk, "score", V.TEST_FROM, DECILE_ORDER, 200))
