"""The loan-book views in plain SQL, for checking the Spark results against another engine."""

from __future__ import annotations

from ledgerscope import params as P
from ledgerscope.sources import views as V


def he(x: str, digits: int) -> str:
    return f"(round_even(CAST({x} AS DOUBLE)*1e{digits},0)/1e{digits})"


def dec(x: str, scale: int = 2) -> str:
    return f"CAST({x} AS DECIMAL(18,{scale}))"


def exact(x: str, digits: int = 6) -> str:
    return dec(he(x, digits), digits)


def total(x: str, scale: int = 2) -> str:
    return f"CAST(sum({dec(x, scale)}) AS DOUBLE)"


def ratio(n: str, d: str) -> str:
    return f"(CAST({n} AS DOUBLE)/CAST(nullif({d},0) AS DOUBLE))"


def mean(x: str, scale: int = 2) -> str:
    return ratio(total(x, scale), f"count({x})")


def n_if(p: str) -> str:
    return f"count(*) FILTER (WHERE {p})"


def rate(p: str) -> str:
    return ratio(n_if(p), "count(*)")


def median(x: str) -> str:
    return f"quantile_cont(CAST({x} AS DOUBLE), 0.5)"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"{v!r}e0"
    return str(v)


def case(x: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


def bucket(x: str) -> str:
    return (f"CASE WHEN {x} <= 0 THEN 'Current' WHEN {x} <= 30 THEN '1-30' WHEN {x} <= 60 THEN '31-60' "
            f"WHEN {x} <= 90 THEN '61-90' WHEN {x} > 90 THEN '90+' END")


def per_product(x: str, table: dict) -> str:
    out = "CASE "
    for p, (edges, labels) in table.items():
        for e, l in zip(edges, labels):
            out += f"WHEN product_type = '{p}' AND {x} <= {e} THEN {lit(l)} "
        out += f"WHEN product_type = '{p}' AND {x} > {edges[-1]} THEN {lit(labels[-1])} "
    return out + "END"


def segment(rules: dict) -> str:
    out = "CASE "
    for p, groups in rules.items():
        for grades, label in groups.items():
            members = ",".join(lit(g) for g in grades)
            out += f"WHEN product_type = '{p}' AND origination_risk_grade IN ({members}) THEN {lit(label)} "
    return out + "END"


HYBRID = f"CASE WHEN interest_rate_apr > {lit(P.HIGH_APR)} THEN {lit(P.HIGH_APR_SEGMENT)} ELSE {segment(P.HYBRID_SEGMENTS)} END"


def posture(risk: str, value: str, limits) -> str:
    split, floor, high = limits
    return (f"CASE WHEN {value} < {lit(floor)} THEN 'exit' WHEN {risk} > {lit(split)} THEN 'contain' "
            f"WHEN {value} > {lit(high)} THEN 'grow' ELSE 'maintain' END")


MARGIN = "(nii + fee - loss - servicing)"
_cuts = V.GRADE_CUTS

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: str, body: str) -> None:
    VIEWS[name] = (needs.split(), body)


view("customers", "", f"""
SELECT c_custkey AS customer_id, r_name AS region_type,
  {case('(c_nationkey % 3)', {0: 'Low', 1: 'Mid', 2: 'High'})} AS income_proxy_band,
  {case('(c_custkey % 4)', {0: 'Salaried', 1: 'Self-employed', 2: 'Gig', 3: 'Informal'})} AS employment_type,
  CAST(18 + c_custkey % 48 AS INT) AS age, CAST(c_custkey % 100 < 35 AS INT) AS first_time_borrower,
  CASE WHEN c_acctbal >= {_cuts[0]} THEN 'A' WHEN c_acctbal >= {_cuts[1]} THEN 'B'
       WHEN c_acctbal >= {_cuts[2]} THEN 'C' WHEN c_acctbal >= {_cuts[3]} THEN 'D' ELSE 'E' END AS credit_quality_indicator,
  {case('c_mktsegment', V.CHANNEL_OF_SEGMENT)} AS acquisition_channel,
  CAST({case('c_mktsegment', {k: V.CAC_OF_CHANNEL[v] for k, v in V.CHANNEL_OF_SEGMENT.items()})} AS BIGINT) AS cac
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")

view("latent_risk", "", "SELECT c_custkey AS customer_id, c_acctbal/1000 AS true_latent_risk FROM customer")

view("originations", "customers", f"""
SELECT o_orderkey AS loan_id, o_custkey AS customer_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS loan_sequence,
  {case('substr(o_orderpriority,1,1)', V.PRODUCT_OF_PRIORITY)} AS product_type,
  {dec('o_totalprice')} AS ticket_size, CAST(1 + o_orderkey % 36 AS INT) AS tenure_mo,
  CAST(12 + (o_orderkey*7) % 37 AS DOUBLE) AS interest_rate_apr, credit_quality_indicator AS origination_risk_grade,
  CAST(o_orderdate AS DATE) AS origination_date, strftime(o_orderdate, '%Y-%m') AS origination_cohort,
  CAST(1 + o_orderkey % 72 AS DOUBLE) AS approval_tat_hrs, {case('o_orderstatus', V.STATUS_OF_ORDER)} AS loan_status
FROM orders LEFT JOIN customers ON customer_id = o_custkey""")

view("outcomes", "", f"""
SELECT l_orderkey AS loan_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS period_index,
  {case('l_returnflag', V.OUTCOME_OF_RETURN)} AS outcome, {dec('l_extendedprice')} AS outstanding_balance,
  l_discount, l_orderkey % 17 AS _shift
FROM lineitem""")

view("repayments", "outcomes", f"""
SELECT loan_id, period_index, outcome, outstanding_balance,
  {exact("coalesce(CASE WHEN outcome='full' THEN CAST(outstanding_balance AS DOUBLE)*(1-l_discount) WHEN outcome='partial' THEN CAST(outstanding_balance AS DOUBLE)*(1-l_discount)/2 END, 0)", 2)} AS amount_paid,
  CAST(outcome='full' AS INT) AS paid_on_time_flag, CAST(outcome='partial' AS INT) AS partial_payment_flag,
  CAST(outcome='full' AND l_discount >= 0.09e0 AS INT) AS prepayment_flag, CAST(1 + _shift + period_index - 1 AS INT) AS obs_month,
  missed_payments_cum, dpd, {bucket('dpd')} AS delinquency_bucket
FROM (SELECT *, CAST(s - least(0, min(s) OVER w) AS INT) AS dpd FROM (
  SELECT *, sum({case('outcome', V.OUTCOME_DELTA)}) OVER w AS s,
    CAST(count(*) FILTER (WHERE outcome <> 'full') OVER w AS BIGINT) AS missed_payments_cum FROM outcomes
  WINDOW w AS (PARTITION BY loan_id ORDER BY period_index)) WINDOW w AS (PARTITION BY loan_id ORDER BY period_index))""")

view("behaviour", "", f"""
SELECT customer_id, month, {exact('1e0/(1e0+avg_v/50e0)')} AS cashflow_consistency, {exact('sd/100e0')} AS balance_volatility,
  spending_shock_flag, nach_bounce_count, {exact('least(avg_v, 150e0)')} AS credit_utilisation, bureau_inquiry_velocity, app_engagement
FROM (SELECT c_custkey AS customer_id, c_custkey % (SELECT max(user_id)+1 FROM events) AS user_id FROM customer)
JOIN (SELECT user_id, CAST(day(ts) AS INT) AS month, {ratio(f"sum({dec('value')})", 'count(value)')} AS avg_v, stddev_pop(value) AS sd,
   CAST(max(value) > 100 AS INT) AS spending_shock_flag, CAST({n_if("event_type='error'")} AS INT) AS nach_bounce_count,
   CAST({n_if("event_type='signup'")} AS INT) AS bureau_inquiry_velocity,
   CAST({n_if("event_type IN ('view','click')")} AS INT) AS app_engagement
   FROM events GROUP BY 1, 2) USING (user_id)""")

_spread = f"((interest_rate_apr/100e0 - {lit(P.COST_OF_FUNDS)})/12e0)"
view("loans", "originations repayments", f"""
SELECT *, {dec(he(f"{MARGIN} - cac_charged", 2))} AS value_proxy FROM (
SELECT o.*, CAST(coalesce(n, 0) AS INT) AS months_on_book, coalesce(CAST(worst >= 90 AS INT), 0) AS default_flag, last_balance, last_dpd,
  {exact(f"{_spread}*CAST(coalesce(bal,0) AS DOUBLE)")} AS nii,
  {exact(f"{case('product_type', P.FEE_RATE)}*CAST(ticket_size AS DOUBLE)")} AS fee,
  {exact(f"CASE WHEN loan_status='Written-off' OR coalesce(last_dpd >= 90, false) THEN {case('product_type', P.LGD)}*CAST(coalesce(last_balance,0) AS DOUBLE) ELSE 0e0 END")} AS loss,
  {dec(f"{P.SERVICING_PER_MONTH}*coalesce(n,0)", 6)} AS servicing,
  {dec("CASE WHEN loan_sequence=1 THEN coalesce(cac,0) ELSE 0 END", 6)} AS cac_charged
FROM originations o LEFT JOIN (SELECT loan_id, sum(outstanding_balance) AS bal, count(*) AS n, max_by(outstanding_balance, period_index) AS last_balance,
  max_by(dpd, period_index) AS last_dpd, max(dpd) AS worst FROM repayments GROUP BY 1) USING (loan_id)
  LEFT JOIN (SELECT customer_id, cac FROM customers) USING (customer_id))""")

view("loan_events", "repayments", """
SELECT loan_id, min(period_index) FILTER (WHERE dpd >= 90) AS d, max(period_index) AS l,
  min(obs_month) FILTER (WHERE dpd >= 90) AS default_month FROM repayments GROUP BY 1""")


def resolve(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for m in VIEWS[n][0]:
            visit(m)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(names: str, query: str) -> str:
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in resolve(names.split())]
    return ("WITH " + ",\n".join(parts) + "\n" + query) if parts else query
