"""V1-V15: unit economics and portfolio tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions.numeric import half_even
from ledgerscope.operators import economics as E
from ledgerscope.plans import sql as S
from ledgerscope.plans.registry import register
from ledgerscope.functions import bands

register(
    "v01_value_proxy",
    lambda b: b.loans.select(
        "loan_id", "months_on_book", "default_flag",
        *[F.col(c).cast("double").alias(c) for c in [*E.COMPONENTS, "value_proxy"]],
    ),
    "loans",
    "SELECT loan_id, months_on_book, default_flag, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [*E.COMPONENTS, "value_proxy"]) + " FROM loans",
)
_net = f"({S.MARGIN} - cac_charged)"
register(
    "v02_reconcile_value", lambda b: E.reconcile_value(b.loans, b.components), "loans",
    f"SELECT count(*) AS n_loans, CAST(max(abs(value_proxy - {_net})) AS DOUBLE) AS max_gap, "
    f"max(abs(value_proxy - {_net})) <= 1 AS reconciles FROM loans",
)
register(
    "v03_cac_once", lambda b: E.cac_once(b.loans, b.components), "loans",
    f"SELECT {S.n_if('loan_sequence > 1')} AS n_later_loans, "
    f"coalesce({S.total('CASE WHEN loan_sequence > 1 THEN abs(cac_charged) END')}, 0) AS cac_on_later, "
    "coalesce(sum(CASE WHEN loan_sequence > 1 THEN abs(cac_charged) END), 0) = 0 AS charged_once FROM loans",
)

SLICE = f"""count(*) AS n, {S.he(S.rate('default_flag = 1'), 6)} AS default_rate, {S.he(S.mean('value_proxy'), 4)} AS mean_value,
  {S.total('value_proxy')} AS total_value, {S.he(S.mean('months_on_book'), 6)} AS mean_mob, {S.he(S.mean('tenure_mo'), 6)} AS mean_tenure,
  {S.he(S.mean('ticket_size'), 4)} AS mean_ticket, {S.he(S.mean('interest_rate_apr'), 6)} AS mean_apr"""
register(
    "v04_slice_metrics", lambda b: E.slice_metrics(b.loans, ["product_type", "origination_risk_grade"]), "loans",
    f"SELECT product_type, origination_risk_grade, {SLICE} FROM loans GROUP BY 1, 2",
)


def report_sql(keys: str, source: str) -> str:
    return f"""SELECT *, {S.he(S.ratio('n', 'sum(n) OVER ()'), 6)} AS share, {S.he(S.ratio('mean_mob', 'mean_tenure'), 6)} AS maturity,
  CAST(mean_value < 0 AS INT) AS loss_making FROM (SELECT {keys}, {SLICE} FROM {source} GROUP BY {keys})"""


register("v05_slice_a_product", lambda b: E.slice_report(b.loans, ["product_type"]), "loans",
         report_sql("product_type", "loans"))
register(
    "v05_slice_b_tenure",
    lambda b: E.slice_report(b.loans.withColumn("tenure_band", bands.tenure_band()), ["product_type", "tenure_band"]),
    "loans",
    report_sql("product_type, tenure_band",
               f"(SELECT *, {S.per_product('tenure_mo', P.TENURE_BANDS)} AS tenure_band FROM loans)"),
)

register(
    "v05_slice_c_ticket",
    lambda b: E.slice_report(E.ticket_bands_with_fallback(b.loans, basis=b.originations), ["product_type", "ticket_band"]),
    "banded", report_sql("product_type, ticket_band", "banded"),
)

register(
    "v06_equal_mob_default", lambda b: E.equal_mob_default(b.loans, b.repayments, k=6), "loans loan_events",
    f"""SELECT product_type, {S.per_product('tenure_mo', P.TENURE_BANDS)} AS bucket,
  {S.he('100*' + S.rate('default_flag = 1'), 4)} AS raw_default,
  {S.he('100*' + S.ratio(S.n_if('months_on_book >= 6 AND d <= 6'), S.n_if('months_on_book >= 6')), 4)} AS default_at_k,
  {S.n_if('months_on_book >= 6')} AS n_watched
FROM loans LEFT JOIN loan_events USING (loan_id) WHERE product_type IN ('Personal','SME') AND tenure_mo > 12 GROUP BY 1, 2""",
)
register(
    "v07_vintage", lambda b: E.vintage(b.loans, b.repayments), "loans",
    f"""SELECT origination_cohort AS cohort, count(*) AS n, {S.he('100*' + S.rate('default_flag = 1'), 4)} AS raw_default,
  {S.he('100*' + S.ratio(S.n_if('months_on_book >= 3 AND m30 <= 3'), S.n_if('months_on_book >= 3')), 4)} AS early30,
  {S.n_if('months_on_book >= 3')} AS n_observed, {S.he('100*' + S.rate("origination_risk_grade IN ('D','E')"), 4)} AS grade_de
FROM loans LEFT JOIN (SELECT loan_id, min(period_index) FILTER (WHERE dpd >= 30) AS m30 FROM repayments GROUP BY 1) USING (loan_id) GROUP BY 1""",
)

_ROLL = f"""(SELECT b.from_bucket, {', '.join(S.he('100*' + S.ratio(f"coalesce(k{i},0)", 'tot'), 6) + f' AS to_{i}' for i in range(5))}
FROM (SELECT unnest({P.BUCKETS!r}) AS from_bucket) b LEFT JOIN (
  SELECT delinquency_bucket AS from_bucket, count(*) AS tot, {', '.join(S.n_if(f"nxt = {S.lit(x)}") + f' AS k{i}' for i, x in enumerate(P.BUCKETS))}
  FROM (SELECT delinquency_bucket, lead(delinquency_bucket) OVER (PARTITION BY loan_id ORDER BY period_index) AS nxt FROM repayments)
  WHERE nxt IS NOT NULL GROUP BY 1) USING (from_bucket))"""
register("v08_roll_rate", lambda b: E.roll_rate(b.repayments), "repayments", f"SELECT * FROM {_ROLL}")
register(
    "v09_time_to_first_delinquency", lambda b: E.time_to_first_delinquency(b.repayments), "repayments",
    f"""SELECT count(*) AS n_loans, {S.he(S.mean('p'), 4)} AS mean_periods, {S.he(S.median('p'), 0)} AS median_periods
FROM (SELECT loan_id, min(period_index) AS p FROM repayments WHERE dpd > 0 GROUP BY 1)""",
)
register(
    "v10_cure_chance", lambda b: E.cure_chance(E.roll_rate(b.repayments)), "repayments",
    f"""SELECT from_bucket, {S.he("CASE from_bucket WHEN '1-30' THEN to_0 WHEN '31-60' THEN to_0 + to_1 WHEN '61-90' THEN to_0 + to_1 + to_2 ELSE to_0 + to_1 + to_2 + to_3 END", 4)} AS cure_pct
FROM {_ROLL} WHERE from_bucket <> 'Current'""",
)
_act = "loan_status = 'Active'"
register(
    "v11_portfolio_overview", lambda b: E.portfolio_overview(b.loans, b.customers, b.repayments), "loans",
    f"""SELECT count(*) AS n_loans, {S.he(S.total('ticket_size') + '/1e7', 4)} AS originated_cr,
  {S.he(S.total(f'CASE WHEN {_act} THEN last_balance END') + '/1e7', 4)} AS outstanding_cr,
  {S.he(S.total('value_proxy') + '/1e7', 4)} AS profit_cr, {S.he('100*' + S.rate('default_flag = 1'), 4)} AS ever90_pct,
  {S.he('100*' + S.ratio(S.n_if(f'{_act} AND coalesce(last_dpd > 0, true)'), S.n_if(_act)), 4)} AS current_delinquent_pct,
  {S.he('100*' + S.ratio(S.n_if(f'{_act} AND last_dpd > 90'), S.n_if(_act)), 4)} AS current_90_pct,
  {S.he(S.ratio('sum(ticket_size*' + S.dec('interest_rate_apr') + ')', 'sum(ticket_size)'), 4)} AS wa_apr,
  {S.he(S.ratio('sum(ticket_size*' + S.dec('tenure_mo') + ')', 'sum(ticket_size)'), 4)} AS wa_tenure,
  {S.he(S.mean('ticket_size'), 4)} AS mean_ticket, count(DISTINCT customer_id) AS n_customers FROM loans""",
)
_shares = ", ".join(
    S.he(f"100*{S.ratio(c, f'(SELECT {a} FROM loans)')}", 4) + f" AS pct_{n}"
    for c, a, n in [("n", "count(*)", "loans"), ("expo", "sum(ticket_size)", "exposure"), ("prof", "sum(value_proxy)", "profit")]
)
register(
    "v12_concentration", lambda b: E.concentration(b.loans), "loans",
    f"""SELECT coalesce(product_type, 'TOTAL') AS product, n, CAST(expo AS DOUBLE) AS exposure, CAST(prof AS DOUBLE) AS profit, {_shares}
FROM (SELECT product_type, count(*) AS n, sum(ticket_size) AS expo, sum(value_proxy) AS prof FROM loans GROUP BY ROLLUP (product_type))""",
)
_cells = []
for _i, _c in enumerate(P.CHANNELS):
    _f = f"FILTER (WHERE acquisition_channel = {S.lit(_c)})"
    _sum = f"CAST(sum({S.dec('value_proxy')}) {_f} AS DOUBLE)"
    _cells += [
        S.he(S.ratio(_sum, f"count(*) {_f}"), 4) + f" AS c{_i}_mean", f"count(*) {_f} AS c{_i}_n",
        S.he(S.ratio(f"count(*) FILTER (WHERE acquisition_channel = {S.lit(_c)} AND default_flag = 1)", f"count(*) {_f}"), 6)
        + f" AS c{_i}_default", f"{_sum} AS c{_i}_total",
    ]
_joined = "loans JOIN (SELECT customer_id, acquisition_channel, cac FROM customers) USING (customer_id)"
register("v13_crossover", lambda b: E.crossover(b.loans, b.customers), "loans customers",
         f"SELECT product_type, {', '.join(_cells)} FROM {_joined} GROUP BY 1")
register(
    "v14_channel_drag", lambda b: E.channel_drag(b.loans, b.customers), "loans customers",
    f"""SELECT *, {S.he('100*' + S.ratio('total_value', 'CAST(sum(' + S.dec('total_value') + ') OVER () AS DOUBLE)'), 4)} AS pct_of_drag FROM (
  SELECT acquisition_channel, count(*) AS n, {S.he(S.mean('value_proxy'), 4)} AS mean_value, {S.total('value_proxy')} AS total_value,
    {S.he(S.rate('default_flag = 1'), 6)} AS default_rate FROM {_joined} WHERE product_type = 'BNPL' GROUP BY 1)
ORDER BY total_value, acquisition_channel""",
)


def channel_sql(cac: str) -> str:
    monthly = f"(CAST({S.MARGIN} AS DOUBLE)/greatest(CAST(months_on_book AS DOUBLE), 1e0))"
    payback = S.he(f"CAST({cac} AS DOUBLE)/greatest({monthly}, 1e0)", 6)
    return f"""SELECT acquisition_channel, loans, avg_cac, default_rate, avg_profit, median_profit,
  {S.he('100*' + S.ratio('(avg_profit - median_profit)', 'median_profit'), 4)} AS skew_pct, payback_mo, clv_cac FROM (
  SELECT acquisition_channel, count(*) AS loans, {S.he(S.mean(cac), 2)} AS avg_cac, {S.he(S.rate('default_flag = 1'), 6)} AS default_rate,
    {S.he(S.mean('value_proxy'), 2)} AS avg_profit, {S.he(S.median('value_proxy'), 2)} AS median_profit,
    {S.he(S.median(payback), 4)} AS payback_mo, {S.he(S.ratio(f'sum({S.MARGIN})', f'sum({cac})'), 6)} AS clv_cac
  FROM {_joined} GROUP BY 1)"""


register("v15_channel_economics", lambda b: E.channel_economics(b.loans, b.customers), "loans customers", channel_sql("cac"))
register("v15_channel_economics_charged", lambda b: E.channel_economics(b.loans, b.customers, "cac_charged"),
         "loans customers", channel_sql("cac_charged"))
