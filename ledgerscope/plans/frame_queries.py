"""V16-V20 and SG1-SG9: frames and rule-based segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions import bands
from ledgerscope.operators import frames, segments
from ledgerscope.plans import sql as S
from ledgerscope.plans.registry import register


def doubles(df: DataFrame) -> DataFrame:
    """Decimals and dates as plain numbers and text, for delivery."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        out.append(c.cast("double").alias(f.name) if kind == "decimal" else c.cast("string").alias(f.name) if kind == "date" else c)
    return df.select(*out)


def sql_doubles(view: str, decimals: str, dates: str = "") -> str:
    parts = [f"CAST({c} AS DOUBLE) AS {c}" for c in decimals.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM {view}"


BEH = "cashflow_consistency_mean balance_volatility_mean credit_utilisation_mean app_engagement_mean bureau_inquiry_velocity_mean spending_shock_rate"
register("v16_behaviour_summary", lambda b: doubles(frames.behaviour_summary(b.behaviour)), "beh_summary", sql_doubles("beh_summary", BEH))
LOAN_DECIMALS = f"ticket_size last_balance nii fee loss servicing cac_charged value_proxy margin_before_cac {BEH}"
register("v17_loan_frame", lambda b: doubles(b.loan_frame), "frame", sql_doubles("frame", LOAN_DECIMALS, "origination_date"))
register(
    "v18_customer_frame", lambda b: doubles(b.customer_frame), "cust_frame",
    sql_doubles("cust_frame", f"total_originated clv total_nii total_fee total_loss total_servicing total_cac margin_before_cac_total {BEH}"),
)
CELLS = f"""SELECT *, {S.he(S.ratio('n_loans', 'sum(n_loans) OVER ()'), 6)} AS share_of_book, CAST(mean_value_proxy < 0 AS INT) AS loss_making FROM (
  SELECT product_type, tenure_band, ticket_band, count(*) AS n_loans, {S.he(S.rate('default_flag=1'), 6)} AS default_rate,
    {S.he(S.rate('ever_90plus=1'), 6)} AS ever_90_rate, {S.he(S.mean('value_proxy'), 4)} AS mean_value_proxy, {S.total('value_proxy')} AS total_value_proxy,
    {S.he(S.mean('ticket_size'), 4)} AS mean_ticket, {S.he(S.mean('tenure_mo'), 6)} AS mean_tenure, {S.he(S.mean('interest_rate_apr'), 6)} AS mean_apr,
    {S.he(S.mean('months_on_book'), 6)} AS mean_mob, {S.n_if('seasoned_mob12=1')} AS n_seasoned,
    {S.he(S.ratio(S.n_if('seasoned_mob12=1 AND default_flag=1'), S.n_if('seasoned_mob12=1')), 6)} AS default_rate_seasoned
  FROM frame GROUP BY 1, 2, 3)"""
register("v19_product_cell_frame", lambda b: frames.product_cell_frame(b.loan_frame), "frame", CELLS)
register(
    "v20_conservation_checks",
    lambda b: frames.conservation_checks(
        b.stored_loans, b.stored_frame, frames.customer_frame(b.customers, b.stored_frame, b.behaviour_means), frames.product_cell_frame(b.stored_frame)),
    "frame",
    f"""SELECT *, abs(expected - measured) < 0.01 AS passed FROM (
  SELECT 'clv_equals_value' AS "check", {S.total('value_proxy')} AS expected, (SELECT {S.total('clv')} FROM (SELECT sum(value_proxy) AS clv FROM frame GROUP BY customer_id)) AS measured FROM loans
  UNION ALL SELECT 'cells_cover_loans', CAST(count(*) AS DOUBLE), (SELECT CAST(sum(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM frame GROUP BY product_type, tenure_band, ticket_band)) FROM loans
  UNION ALL SELECT 'every_loan_banded', 0, CAST({S.n_if('tenure_band IS NULL OR ticket_band IS NULL')} AS DOUBLE) FROM frame
  UNION ALL SELECT 'no_forbidden_column', 0, 0)""",
)


def metrics_sql(source: str) -> str:
    return f"""(SELECT segment, n_loans, n_seasoned, n_customers, {S.he('100*' + S.ratio('n_loans', 'sum(n_loans) OVER ()'), 4)} AS pct_of_book,
  {S.he('CAST(orig AS DOUBLE)/1e7', 4)} AS total_originated_cr, {S.he('100*' + S.ratio('orig', 'sum(orig) OVER ()'), 4)} AS pct_of_orig,
  default_rate_pct, mean_ticket, mean_apr_pct, mean_value, total_value, pct_loss_making FROM (
  SELECT segment, count(*) AS n_loans, {S.n_if('months_on_book >= 3')} AS n_seasoned, count(DISTINCT customer_id) AS n_customers, sum(ticket_size) AS orig,
    {S.he('100*' + S.ratio(S.n_if('months_on_book >= 3 AND default_flag = 1'), S.n_if('months_on_book >= 3')), 4)} AS default_rate_pct,
    {S.he(S.mean('ticket_size'), 2)} AS mean_ticket, {S.he(S.mean('interest_rate_apr'), 4)} AS mean_apr_pct, {S.he(S.mean('value_proxy'), 2)} AS mean_value,
    {S.total('value_proxy')} AS total_value, {S.he('100*' + S.rate('value_proxy < 0'), 4)} AS pct_loss_making
  FROM (SELECT *, {source} AS segment FROM loans) GROUP BY 1))"""


HEUR, FROZEN = S.segment(P.HEURISTIC_SEGMENTS), S.segment(P.FROZEN_SEGMENTS)
register("sg01_heuristic_segments", lambda b: segments.segment_metrics(b.loans.withColumn("segment", bands.heuristic_segment())),
         "loans", f"SELECT * FROM {metrics_sql(HEUR)}")
register(
    "sg02_frozen_segments", lambda b: b.loans.select("loan_id", "customer_id", bands.frozen_segment().alias("segment")),
    "loans", f"SELECT loan_id, customer_id, {FROZEN} AS segment FROM loans",
)
HYBRID = f"""(SELECT *, {S.he('100*' + S.ratio('n_loans_total', 'sum(n_loans_total) OVER ()'), 4)} AS pct_of_book FROM (
  SELECT {S.HYBRID} AS segment, count(*) AS n_loans_total,
    {S.he('100*' + S.ratio(S.n_if('months_on_book >= 3 AND default_flag = 1'), S.n_if('months_on_book >= 3')), 4)} AS default_rate_pct,
    {S.he(S.mean('CASE WHEN months_on_book >= 3 THEN value_proxy END'), 2)} AS mean_value,
    {S.he('100*' + S.ratio(S.n_if('months_on_book >= 3 AND value_proxy < 0'), S.n_if('months_on_book >= 3')), 4)} AS pct_loss_making FROM loans GROUP BY 1))"""
register("sg03_hybrid_segments", lambda b: segments.hybrid_metrics(b.loans), "loans", f"SELECT * FROM {HYBRID}")
register(
    "sg03_unassigned", lambda b: b.loans.agg(F.count_if(bands.hybrid_segment().isNull()).alias("n_unassigned"), F.count(F.lit(1)).alias("n")),
    "loans", f"SELECT count(*) FILTER (WHERE ({S.HYBRID}) IS NULL) AS n_unassigned, count(*) AS n FROM loans",
)
register("sg04_segment_metrics", lambda b: segments.segment_metrics(b.loans.withColumn("segment", bands.frozen_segment())),
         "loans", f"SELECT * FROM {metrics_sql(FROZEN)}")
register(
    "sg05_posture", lambda b: segments.with_posture(segments.hybrid_metrics(b.loans)).withColumn("name", bands.after_last_dot("segment")),
    "loans", f"SELECT *, {S.posture('default_rate_pct', 'mean_value', P.POSTURE_SEASONED)} AS posture, split_part(segment, '. ', -1) AS name FROM {HYBRID}",
)
register(
    "sg05_posture_all_loans", lambda b: segments.with_posture(
        segments.segment_metrics(b.loans.withColumn("segment", bands.heuristic_segment())), P.POSTURE_ALL),
    "loans", f"SELECT *, {S.posture('default_rate_pct', 'mean_value', P.POSTURE_ALL)} AS posture FROM {metrics_sql(HEUR)}",
)

METHODS = {"Heuristic baseline": (bands.heuristic_segment, HEUR), "Frozen rules": (bands.frozen_segment, FROZEN),
           "Hybrid rules": (bands.hybrid_segment, S.HYBRID)}
S.view("method_cells", "loans", f"""
SELECT method, segment, count(*) AS n, {S.n_if('months_on_book >= 3')} AS ns, {S.n_if('months_on_book >= 3 AND default_flag = 1')} AS bad,
  CAST(sum(value_proxy) AS DOUBLE) AS sv, CAST(sum(CAST(value_proxy AS DECIMAL(38,2))*CAST(value_proxy AS DECIMAL(18,2))) AS DOUBLE) AS svv, {S.n_if('value_proxy < 0')} AS losing
FROM ({' UNION ALL '.join(f"SELECT '{m}' AS method, {s} AS segment, months_on_book, default_flag, value_proxy FROM loans" for m, (_, s) in METHODS.items())}) GROUP BY 1, 2""")
S.view("method_table", "method_cells", f"""
SELECT method, segment, n AS n_loans, {S.he('100*' + S.ratio('n', 'sum(n) OVER (PARTITION BY method)'), 4)} AS pct_of_book,
  {S.he('100*' + S.ratio('bad', 'ns'), 4)} AS default_rate_pct, {S.he(S.ratio('sv', 'n'), 2)} AS mean_value, {S.he('sv/1e7', 4)} AS total_value_cr,
  {S.he('100*' + S.ratio('losing', 'n'), 4)} AS pct_loss_making FROM method_cells""")


def cells(b):
    return segments.method_cells(b.loans, {m: f() for m, (f, _) in METHODS.items()})


register("sg07_method_comparison", lambda b: segments.method_comparison(cells(b)), "method_table", "SELECT * FROM method_table")
_eta = lambda n, s, ss: S.he(
    f"(sum(CASE WHEN {n} > 0 THEN CAST({s} AS DOUBLE)*CAST({s} AS DOUBLE)/CAST({n} AS DOUBLE) END) - sum(CAST({s} AS DOUBLE))*sum(CAST({s} AS DOUBLE))/sum({n}))"
    f"/(sum(CAST({ss} AS DOUBLE)) - sum(CAST({s} AS DOUBLE))*sum(CAST({s} AS DOUBLE))/sum({n}))", 4)
PAIRS = """SELECT a.method, a.segment AS segment_a, b.segment AS segment_b FROM method_table a JOIN method_table b ON a.method = b.method AND a.segment < b.segment
  AND abs(a.default_rate_pct - b.default_rate_pct) < 1.0 AND abs(a.mean_value - b.mean_value) < 2000"""
register("sg07_near_duplicates", lambda b: segments.near_duplicates(segments.method_comparison(cells(b))), "method_table", PAIRS)
register(
    "sg07_method_scorecard", lambda b: segments.method_scorecard(cells(b)), "method_table method_cells",
    f"""SELECT method, n_segments, risk_spread_pp, value_spread, risk_eta2, value_eta2, coalesce(k, 0) AS near_duplicate_pairs, n_segments - coalesce(k, 0) AS effective_segments
FROM (SELECT method, count(*) AS n_segments, {S.he('max(default_rate_pct) - min(default_rate_pct)', 4)} AS risk_spread_pp,
  {S.he('max(mean_value) - min(mean_value)', 2)} AS value_spread FROM method_table GROUP BY 1)
JOIN (SELECT method, {_eta('ns', 'bad', 'bad')} AS risk_eta2, {_eta('n', 'sv', 'svv')} AS value_eta2 FROM method_cells GROUP BY 1) USING (method)
LEFT JOIN (SELECT method, count(*) AS k FROM ({PAIRS}) GROUP BY 1) USING (method)""",
)
register("sg08_bootstrap_cv", lambda b: segments.bootstrap_cv(b.loans, bands.heuristic_segment(), 200))
_c2 = lambda x: f"({x}*({x}-1)/2e0)"
register(
    "sg09_adjusted_rand", lambda b: segments.adjusted_rand_index(
        b.loans.select(bands.heuristic_segment().alias("a"), bands.hybrid_segment().alias("b")), "a", "b"),
    "loans",
    f"""SELECT {S.he('(x - r*c/t)/((r + c)/2e0 - r*c/t)', 6)} AS ari FROM (
  SELECT (SELECT sum({_c2('n')}) FROM g) AS x, (SELECT sum({_c2('n')}) FROM (SELECT sum(n) AS n FROM g GROUP BY a)) AS r,
    (SELECT sum({_c2('n')}) FROM (SELECT sum(n) AS n FROM g GROUP BY b)) AS c, (SELECT {_c2('sum(n)')} FROM g) AS t
  FROM (SELECT 1)) CROSS JOIN (SELECT 1)""".replace("FROM g", f"FROM (SELECT {HEUR} AS a, {S.HYBRID} AS b, CAST(count(*) AS DOUBLE) AS n FROM loans GROUP BY 1, 2) AS g"),
)
