"""SQL views for the frames and the early-warning pipeline."""

from __future__ import annotations

from ledgerscope import params as P
from ledgerscope.operators.frames import BEHAVIOUR_MEANS, PROFILE
from ledgerscope.plans import sql as S

S.view("banded", "loans", f"""
SELECT l.*, {S.per_product('tenure_mo', P.TENURE_BANDS)} AS tenure_band,
  CASE WHEN NOT degenerate THEN {S.per_product('ticket_size', P.TICKET_BANDS)}
       WHEN CAST(ticket_size AS DOUBLE) <= q1 THEN '<' || format('{{:,}}', CAST(q1 AS BIGINT))
       WHEN CAST(ticket_size AS DOUBLE) <= q2 THEN format('{{:,}}', CAST(q1 AS BIGINT)) || '-' || format('{{:,}}', CAST(q2 AS BIGINT))
       ELSE '>' || format('{{:,}}', CAST(q2 AS BIGINT)) END AS ticket_band
FROM loans l JOIN (
  SELECT product_type, count(*) < 3 OR min(n)/CAST(sum(n) AS DOUBLE) < 0.05 AS degenerate FROM (
    SELECT product_type, {S.per_product('ticket_size', P.TICKET_BANDS)} AS doc, count(*) AS n FROM loans GROUP BY 1, 2) GROUP BY 1
) USING (product_type) JOIN (
  SELECT product_type, round_even(quantile_cont(CAST(ticket_size AS DOUBLE), {1/3!r}), 0) AS q1,
    round_even(quantile_cont(CAST(ticket_size AS DOUBLE), {2/3!r}), 0) AS q2 FROM loans GROUP BY 1) USING (product_type)""")

S.view("beh_summary", "behaviour", f"""
SELECT customer_id, {', '.join(S.exact(S.mean(c, 6)) + f' AS {c}_mean' for c in BEHAVIOUR_MEANS)},
  CAST(sum(nach_bounce_count) AS BIGINT) AS nach_bounce_total, {S.exact(S.rate('spending_shock_flag = 1'))} AS spending_shock_rate,
  count(*) AS n_months_observed FROM behaviour GROUP BY 1""")

_rank = S.case("delinquency_bucket", {b: i for i, b in enumerate(P.BUCKETS)})
_bucket_of = lambda x: S.case(x, dict(enumerate(P.BUCKETS)))
S.view("frame", "banded repayments customers beh_summary", f"""
SELECT b.*, coalesce(wr, 0) AS worst_delq_rank, {_bucket_of('coalesce(wr, 0)')} AS worst_delq_bucket,
  CAST(coalesce(wr, 0) >= 4 AS INT) AS ever_90plus, CAST(months_on_book >= 12 AS INT) AS seasoned_mob12,
  {S.dec(S.MARGIN, 6)} AS margin_before_cac, {', '.join('c.' + p for p in PROFILE)},
  {', '.join(f's.{c}_mean' for c in BEHAVIOUR_MEANS)}, s.nach_bounce_total, s.spending_shock_rate, s.n_months_observed
FROM banded b LEFT JOIN (SELECT loan_id, max({_rank}) AS wr FROM repayments GROUP BY 1) USING (loan_id)
  LEFT JOIN customers c USING (customer_id) LEFT JOIN beh_summary s USING (customer_id)""")

S.view("cust_frame", "customers frame beh_summary", f"""
SELECT c.*, r.* EXCLUDE (customer_id), s.* EXCLUDE (customer_id), CAST(s.customer_id IS NOT NULL AS INT) AS has_behaviour
FROM customers c LEFT JOIN (
  SELECT customer_id, count(*) AS n_loans, count(DISTINCT product_type) AS n_products_held,
    min_by(product_type, loan_sequence) AS primary_product, sum(ticket_size) AS total_originated,
    {S.he(S.mean('interest_rate_apr'), 6)} AS mean_apr, min(origination_cohort) AS first_cohort, max(months_on_book) AS max_months_on_book,
    sum(value_proxy) AS clv, sum(nii) AS total_nii, sum(fee) AS total_fee, sum(loss) AS total_loss, sum(servicing) AS total_servicing,
    sum(cac_charged) AS total_cac, sum(margin_before_cac) AS margin_before_cac_total, max(default_flag) AS any_default,
    CAST(sum(default_flag) AS BIGINT) AS n_defaults, {S.n_if("loan_status='Written-off'")} AS n_writeoffs, max(worst_delq_rank) AS worst_delq_rank_ever,
    max(ever_90plus) AS ever_90plus, {_bucket_of('max(worst_delq_rank)')} AS worst_delq_bucket_ever,
    CASE WHEN sum(cac_charged) > 0 THEN {S.he(S.ratio('sum(value_proxy)', 'sum(cac_charged)'), 6)} END AS clv_to_cac,
    CAST(sum(value_proxy) > 0 AS INT) AS net_value_positive FROM frame GROUP BY 1) r USING (customer_id)
  LEFT JOIN beh_summary s USING (customer_id)""")

S.view("spine", "repayments loan_events loans", f"""
SELECT r.loan_id, customer_id, obs_month, period_index AS months_on_book, product_type, {S.segment(P.FROZEN_SEGMENTS)} AS segment
FROM repayments r JOIN loan_events e ON r.loan_id = e.loan_id JOIN loans o ON o.loan_id = r.loan_id
WHERE period_index >= {P.MOB_FLOOR} AND (d IS NULL OR period_index < d)""")

S.view("outcome_spine", "spine loan_events loans", f"""
SELECT s.*, CASE WHEN d <= s.months_on_book + 3 THEN 1 WHEN loan_status <> 'Active' OR l >= s.months_on_book + 3 THEN 0 ELSE -1 END AS label
FROM spine s JOIN loan_events USING (loan_id) JOIN (SELECT loan_id, loan_status FROM loans) USING (loan_id)""")

S.view("labelled", "outcome_spine", "SELECT * FROM outcome_spine WHERE label <> -1")

_lag = lambda c, k: f"({c} - lag({c}, {k}) OVER w)"
S.view("bfeat", "behaviour", f"""
SELECT customer_id, month AS obs_month, sum(CAST(nach_bounce_count > 0 AS INT)) OVER (PARTITION BY customer_id, island ORDER BY month) AS bounce_streak,
  * EXCLUDE (customer_id, month, island) FROM (
SELECT customer_id, month, nach_bounce_count, spending_shock_flag,
  sum(CAST(nach_bounce_count <= 0 AS INT)) OVER w AS island,
  sum(nach_bounce_count) OVER w3 AS bounce_count_3m,
  least(coalesce(row_number() OVER w - last_value(CASE WHEN spending_shock_flag = 1 THEN rn END IGNORE NULLS) OVER w, 24), 24) AS spending_shock_recency,
  {S.he('avg(spending_shock_flag) OVER w3', 6)} AS spending_shock_rate_3m, CAST(credit_utilisation AS DOUBLE) AS utilisation_level,
  {S.he(_lag('credit_utilisation', 3), 6)} AS utilisation_creep_3m, CAST(balance_volatility AS DOUBLE) AS balance_volatility_level,
  CAST(cashflow_consistency AS DOUBLE) AS cashflow_consistency_level, CAST({_lag('cashflow_consistency', 2)} AS DOUBLE)/2e0 AS cashflow_consistency_slope,
  {_lag('bureau_inquiry_velocity', 3)} AS inquiry_velocity_accel, {_lag('app_engagement', 3)} AS app_engagement_drop,
  CAST(nach_bounce_count > 0 AND sum(CAST(nach_bounce_count > 0 AS INT)) OVER w = 1 AS INT) AS first_bounce_flag
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY month) AS rn FROM behaviour)
WINDOW w AS (PARTITION BY customer_id ORDER BY month), w3 AS (PARTITION BY customer_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""")

S.view("rfeat", "repayments", """
SELECT loan_id, period_index AS months_on_book, sum(partial_payment_flag) OVER (PARTITION BY loan_id, island ORDER BY period_index) AS partial_run,
  dpd AS dpd_current, missed_payments_cum AS missed_cum_at_t
FROM (SELECT *, sum(CAST(partial_payment_flag = 0 AS INT)) OVER (PARTITION BY loan_id ORDER BY period_index) AS island FROM repayments)""")

S.view("raw_matrix", "labelled bfeat rfeat", """
SELECT * FROM labelled LEFT JOIN rfeat USING (loan_id, months_on_book) LEFT JOIN bfeat USING (customer_id, obs_month)""")

_ints = [f for f in P.FEATURES + P.ESCALATION_FEATURES if f not in P.LEVEL_FEATURES
         and f not in ("spending_shock_rate_3m", "utilisation_creep_3m", "cashflow_consistency_slope")]
_dbls = ["spending_shock_rate_3m", "utilisation_creep_3m", "cashflow_consistency_slope"]
S.view("matrix", "raw_matrix", f"""
SELECT loan_id, customer_id, obs_month, months_on_book, product_type, segment, label, nach_bounce_count, spending_shock_flag,
  {', '.join(f'CAST(coalesce({f}, 0) AS BIGINT) AS {f}' for f in _ints)}, {', '.join(f'coalesce({f}, 0e0) AS {f}' for f in _dbls)},
  {', '.join(f'coalesce({f}, (SELECT median({f}) FROM raw_matrix)) AS {f}' for f in P.LEVEL_FEATURES)} FROM raw_matrix""")

# fixed stand-in score: a formula of the features, so that what follows a score can be checked without a model
STAND_IN = [
    (0.05, "bounce_streak"), (0.04, "bounce_count_3m"), (0.10, "spending_shock_rate_3m"), (0.002, "utilisation_level"),
    (0.05, "balance_volatility_level"), (0.06, "partial_run"), (0.05, "first_bounce_flag"), (-0.20, "cashflow_consistency_level"),
]
_z = "0.2e0" + "".join(f" + {S.lit(w)}*CAST({f} AS DOUBLE)" for w, f in STAND_IN)
_clipped = f"least(greatest({_z}, 0e0), 1e0)"
S.view("scored", "matrix", f"""
SELECT *, {S.he(_clipped, 4)} AS score,
  CASE WHEN obs_month <= 16 THEN 'train' WHEN obs_month < 20 THEN 'embargo' WHEN obs_month <= 27 THEN 'test' ELSE 'excluded' END AS split_oot
FROM matrix""")
S.view("test_rows", "scored", "SELECT * FROM scored WHERE split_oot = 'test'")
