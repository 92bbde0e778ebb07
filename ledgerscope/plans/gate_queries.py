"""Q1-Q13: acceptance gates as result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.operators import gates as G
from ledgerscope.plans import lever_queries  # noqa: F401  (lever_frame view)
from ledgerscope.plans import sql as S
from ledgerscope.plans import warning_queries as W
from ledgerscope.plans.registry import register
from ledgerscope.sources.scratch import settle



def everything(b):
    b.repayments = b.stored_repayments  # loans are valued from the stored panel, which is walked once
    return G.all_checks(b.customers, b.stored_loans, b.stored_repayments, b.behaviour, b.latent_risk, VOLUMES)


VOLUMES = {"repayments": 55_000, "behaviour": 48_000}
CMP = {"==": "=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def rows_sql(measures: dict[str, str]) -> str:
    """One row per check, judged like the Spark side."""
    parts = []
    for check, measure in measures.items():
        grp, must, op, limit, text = G.CHECKS[check]
        parts.append(
            f"SELECT '{check}' AS check_id, '{grp}' AS grp, {str(must).lower()} AS must, measured, {S.lit(text)} AS criterion, "
            f"coalesce(measured {CMP[op]} {S.lit(limit)}, false) AS passed FROM (SELECT {S.he(measure, 6)} AS measured)")
    return " UNION ALL ".join(parts)


def q(expr: str, source: str) -> str:
    return f"(SELECT {expr} FROM {source})"


def surplus(source: str, keys: str) -> str:
    return f"(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys}))"


def gap(column: str, targets: dict) -> str:
    return "greatest(" + ", ".join(f"abs({S.rate(f'{column} = {S.lit(k)}')} - {S.lit(float(v))})" for k, v in targets.items()) + ")"


def bad(*tests: str) -> str:
    return " + ".join(f"(CASE WHEN {t} THEN 0 ELSE 1 END)" for t in tests)


def dr(cond: str) -> str:
    return S.ratio(S.n_if(f"{cond} AND default_flag = 1"), S.n_if(cond))


STRUCTURAL = {
    "S1": f"{surplus('customers', 'customer_id')} + {surplus('loans', 'loan_id')}",
    "S2": q("count(*)", "loans WHERE customer_id NOT IN (SELECT customer_id FROM customers)") + " + "
          + q("count(*)", "repayments WHERE loan_id NOT IN (SELECT loan_id FROM loans)"),
    "S3": f"{surplus('repayments', 'loan_id, period_index')} + {surplus('behaviour', 'customer_id, month')}",
    "S4": q("count(*)", "(SELECT loan_id FROM repayments GROUP BY 1 HAVING NOT (min(period_index) = 1 AND max(period_index) = count(DISTINCT period_index) AND count(*) = count(DISTINCT period_index)))"),
    "S5": surplus("behaviour", "customer_id, month"),
    "S6": q(gap("n", P.REPEAT_LOAN_SPLIT), "(SELECT count(*) AS n FROM loans GROUP BY customer_id)"),
    "S7": f"greatest(abs({q('count(*)', 'repayments')}/{VOLUMES['repayments']}e0 - 1), abs({q('count(*)', 'behaviour')}/{VOLUMES['behaviour']}e0 - 1))",
}
register("q02_structural", lambda b: G.results(G.structural(b.customers, b.originations, b.stored_facts, b.behaviour, VOLUMES)),
         "customers loans repayments behaviour", rows_sql(STRUCTURAL))


def nulls(t: str) -> str:
    return q("sum(" + " + ".join(f"CAST({c} IS NULL AS INT)" for c in G.MUST_HAVE[t]) + ")", t)


_in = lambda c, vs: f"{c} NOT IN ({', '.join(S.lit(v) for v in vs)})"
QUALITY = {
    "Q1": " + ".join(nulls(t) for t in G.MUST_HAVE),
    "Q2": q("count(*)", "customers WHERE age < 18 OR age > 65") + " + " + q("count(*)", "loans WHERE interest_rate_apr < 12 OR interest_rate_apr > 48")
          + " + " + q("count(*)", "repayments WHERE dpd < 0"),
    "Q3": q("count(*)", f"loans WHERE {_in('product_type', P.PRODUCTS)} OR {_in('origination_risk_grade', P.GRADES)}") + " + "
          + q("count(*)", f"repayments WHERE {_in('delinquency_bucket', P.BUCKETS)}"),
    "Q4": q("count(*)", "customers WHERE cac < 0") + " + " + q("count(*)", "loans WHERE ticket_size < 0 OR default_flag NOT IN (0, 1)"),
    "Q5": q("count(*)", f"repayments WHERE delinquency_bucket <> {S.bucket('dpd')}"),
}
register("q03_data_quality", lambda b: G.results(G.data_quality(b.customers, b.loans, b.repayments)), "customers loans repayments", rows_sql(QUALITY))
MIX = {
    "D1": q(gap("product_type", P.PRODUCT_MIX), "loans"), "D2": q(gap("acquisition_channel", P.CHANNEL_MIX), "customers"),
    "D3": q(gap("origination_risk_grade", P.GRADE_MIX), "loans"),
    "D4": q(f"greatest({gap('income_proxy_band', P.INCOME_MIX)}, {gap('employment_type', P.EMPLOYMENT_MIX)})", "customers"),
    "D5": q(f"abs({S.rate('first_time_borrower = 1')} - 0.35e0)", "customers"),
    "D6": q("max(abs(m - t)/t)", f"(SELECT {S.median('ticket_size')} AS m, CAST({S.case('product_type', P.TICKET_MEDIANS)} AS DOUBLE) AS t FROM loans GROUP BY product_type)"),
}
register("q04_mixes", lambda b: G.results(G.mixes(b.customers, b.loans)), "customers loans", rows_sql(MIX))
_p = {p: dr(f"product_type = '{p}'") for p in P.PRODUCTS}
_g = {g: dr(f"origination_risk_grade = '{g}'") for g in P.GRADES}
_sev = lambda p: S.ratio(f"sum(loss) FILTER (WHERE product_type = '{p}' AND loss > 0)", f"sum(last_balance) FILTER (WHERE product_type = '{p}' AND loss > 0)")
_bl = S.rate("default_flag = 1")
DEFAULT = {
    "DR1": q(bad(f"{_bl} >= 0.06e0", f"{_bl} <= 0.09e0"), "loans"),
    "DR2": q(bad(*[f"abs({_p[p]} - {S.lit(t)}) <= 0.015e0" for p, t in P.DEFAULT_BY_PRODUCT.items()], f"{_p['BNPL']} > {_p['Personal']}", f"{_p['Personal']} > {_p['SME']}"), "loans"),
    "DR3": q(bad(*[f"{_g[a]} < {_g[c]}" for a, c in zip(P.GRADES, P.GRADES[1:])], *[f"abs({_g[g]} - {S.lit(t)})/{S.lit(t)} <= 0.2e0" for g, t in P.DEFAULT_BY_GRADE.items()]), "loans"),
    "DR4": q(bad(f"{_sev('SME')} > {_sev('Personal')}", f"{_sev('Personal')} > {_sev('BNPL')}"), "loans"),
}
register("q05_default_targets", lambda b: G.results(G.defaults(b.loans)), "loans", rows_sql(DEFAULT))

S.view("profile", "loans customers latent_risk", "SELECT * FROM loans JOIN customers USING (customer_id) JOIN latent_risk USING (customer_id)")
_mean_if = lambda x, c: S.mean(f"CASE WHEN {c} THEN {x} END")
_apr = {g: _mean_if("interest_rate_apr", f"origination_risk_grade = '{g}'") for g in P.GRADES}
_val = {g: _mean_if("value_proxy", f"origination_risk_grade = '{g}'") for g in P.GRADES}
_ch = {c: dr(f"acquisition_channel = '{c}'") for c in P.CHANNELS}
_auc = f"(SELECT auc FROM ({W.disc_sql('SELECT *, default_flag AS y FROM risk20')}))"
RELATIONSHIP = {
    "R1": q(bad(f"{dr(chr(39).join(['income_proxy_band = ', 'Low', '']))} > {dr(chr(39).join(['income_proxy_band = ', 'High', '']))}",
                f"{dr('employment_type IN ' + repr(('Gig', 'Informal')))} > {dr('employment_type = ' + repr('Salaried'))}",
                f"{dr('region_type = ' + repr('AFRICA'))} > {dr('region_type = ' + repr('EUROPE'))}",
                f"{dr('first_time_borrower = 1')} > {dr('first_time_borrower = 0')}"), "profile"),
    "R2": q("corr(true_latent_risk, CAST(default_flag AS DOUBLE))", "profile"),
    "R3": q(bad(*[f"{_apr[a]} < {_apr[c]}" for a, c in zip(P.GRADES, P.GRADES[1:])]), "profile"),
    "R5": q("quantile_cont(CAST(lead_days AS DOUBLE), 0.5)", "lead21"), "R6": _auc,
    "R7": q(f"{_mean_if('mc', 'default_flag = 1')} - {_mean_if('mc', 'default_flag = 0')}",
            "loans JOIN (SELECT loan_id, max(missed_payments_cum) AS mc FROM repayments GROUP BY 1) USING (loan_id)"),
    "R8": q(f"least({_ch['Digital ads']}, {_ch['DSA']}) - greatest({_ch['Organic']}, {_ch['Referral']})", "profile"),
    "R9": "(CASE WHEN (SELECT acquisition_channel FROM customers GROUP BY 1 ORDER BY median(cac), 1 LIMIT 1) = 'Organic' THEN 0 ELSE 1 END) + "
          "(CASE WHEN (SELECT acquisition_channel FROM profile GROUP BY 1 ORDER BY median(approval_tat_hrs) DESC, 1 DESC LIMIT 1) = 'DSA' THEN 0 ELSE 1 END)",
    "R10": q(S.he("avg(r) FILTER (WHERE d <= 6) - avg(r) FILTER (WHERE u <= 6)", 6),
             f"(SELECT r, row_number() OVER (ORDER BY c) AS u, row_number() OVER (ORDER BY c DESC) AS d FROM (SELECT origination_cohort AS c, {S.rate('dpd > 0')} AS r "
             "FROM repayments JOIN loans USING (loan_id) WHERE period_index <= 3 GROUP BY 1))"),
    "R11": q(f"{_val['A']} - {_val['E']}", "profile"), "R12": _auc,
}


def related(b):
    b.repayments = b.stored_repayments
    return G.relationships(b.customers, b.stored_loans, b.repayments, b.behaviour, b.latent_risk, b.stored_facts)


register("q06_relationships", lambda b: G.results(related(b)),
         "customers loans repayments profile lead21 risk20", rows_sql(RELATIONSHIP))
S.view("curve", "loan_events", f"""
SELECT mob, new_defaults, cumulative, at_risk, {S.he(S.ratio('new_defaults', 'at_risk'), 6)} AS hazard FROM (
  SELECT mob, new_defaults, CAST(sum(new_defaults) OVER (ORDER BY mob) AS BIGINT) AS cumulative, CAST(sum(leaving) OVER (ORDER BY mob DESC) AS BIGINT) AS at_risk FROM (
    SELECT coalesce(d, l) AS mob, count(d) AS new_defaults, count(*) AS leaving FROM loan_events GROUP BY 1))""")
register("w16_default_curve", lambda b: G.default_curve(b.repayments), "curve", "SELECT * FROM curve")
_pre = {p: S.ratio(S.n_if(f"product_type = '{p}' AND pp = 1"), S.n_if(f"product_type = '{p}'")) for p in P.PRODUCTS}
VINTAGE = {
    "V1": q("count(*)", "(SELECT cumulative, lag(cumulative) OVER (ORDER BY mob) AS p FROM curve) WHERE cumulative < p"),
    "V2": q("count(*)", "(SELECT m, lag(m) OVER (ORDER BY c) AS p FROM (SELECT origination_cohort AS c, max(months_on_book) AS m FROM loans GROUP BY 1)) WHERE m > p"),
    "V3": "(SELECT CAST(peak > lo AND peak < hi AS INT) FROM (SELECT (SELECT mob FROM curve ORDER BY hazard DESC, mob LIMIT 1) AS peak, min(mob) AS lo, max(mob) AS hi FROM curve))",
    "V4": "(SELECT coalesce(sum(l - w), 0) + CASE WHEN max(m) >= 180 THEN 0 ELSE 1 END FROM (SELECT min(period_index) FILTER (WHERE dpd >= 180) AS w, max(period_index) AS l, max(dpd) AS m FROM repayments GROUP BY loan_id))",
    "V5": f"(SELECT {S.rate('c')} FROM (SELECT bool_or(coalesce(b > 0 AND dpd = 0, false)) AS c FROM (SELECT loan_id, dpd, lag(dpd) OVER (PARTITION BY loan_id ORDER BY period_index) AS b FROM repayments) GROUP BY loan_id))",
    "V6": q("count(DISTINCT loan_status || default_flag)", "loans"),
    "V7": q("greatest(" + ", ".join(f"abs({_pre[p]} - {S.lit(t)})" for p, t in G.PREPAYMENT.items()) + ")",
            "loans JOIN (SELECT loan_id, max(prepayment_flag) AS pp FROM repayments GROUP BY 1) USING (loan_id)"),
}
register("q07_vintage_panel", lambda b: G.results(G.vintage_panel(b.stored_loans, b.stored_facts)), "loans repayments curve", rows_sql(VINTAGE))
VALUE = {
    "VP1": q(f"max(abs(value_proxy - ({S.MARGIN} - cac_charged)))", "loans"),
    "VP2": q(f"least({S.rate('value_proxy > 0')}, {S.rate('value_proxy < 0')})", "loans"),
    "VP3": q(f"{_val['A']} - {_val['E']}", "loans"), "VP4": q("count(*)", "loans WHERE value_proxy IS NULL"),
}
register("q08_value_checks", lambda b: G.results(G.value_checks(b.loans)), "loans", rows_sql(VALUE))
ALL = rows_sql({**STRUCTURAL, **QUALITY, **MIX, **DEFAULT, **RELATIONSHIP, **VINTAGE, **VALUE})
ALL_VIEWS = "customers loans repayments behaviour profile lead21 risk20 curve"
register("q01_all_checks", everything, ALL_VIEWS, ALL)
register(
    "q09_verdict", lambda b: G.verdict(everything(b)), ALL_VIEWS,
    f"""SELECT {S.n_if('must AND passed')} AS must_pass, {S.n_if('must')} AS must_total, {S.n_if('NOT must AND passed')} AS should_pass, {S.n_if('NOT must')} AS should_total,
  CASE WHEN bool_and(passed OR NOT must) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({ALL})""",
)
register(
    "q12_rerun_difference",
    lambda b: G.max_difference(settle(b.loans), type(b)(b.spark, b.folder).loans, "loan_id", ["value_proxy", "nii", "months_on_book"]),
    "loans", "SELECT CAST(0 AS BIGINT) AS n_unmatched, 0e0 AS diff_value_proxy, 0e0 AS diff_nii, 0e0 AS diff_months_on_book FROM loans HAVING count(*) > 0",
)
LOAN_COLUMNS = ["loan_id", "customer_id", "product_type", "ticket_size", "interest_rate_apr", "months_on_book", "default_flag", "value_proxy"]
_text = lambda c: f"coalesce(concat(length({c}), ':', {c}), '-')"
_digest = "md5(concat_ws(',', " + ", ".join(
    _text("CAST(CAST(interest_rate_apr AS DECIMAL(30,6)) AS VARCHAR)" if c == "interest_rate_apr" else f"CAST({c} AS VARCHAR)") for c in sorted(LOAN_COLUMNS)) + "))"
_halves = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS sum_{i}" for i in (0, 1))
register("q12_fingerprint", lambda b: G.fingerprint(b.loans.select(*LOAN_COLUMNS), ["product_type"]), "loans",
         f"SELECT product_type, count(*) AS n_rows, {_halves} FROM (SELECT product_type, {_digest} AS h FROM loans) GROUP BY 1")
register("q12_stored_run", lambda b: G.run_difference(
    settle(b.loans.select(*LOAN_COLUMNS)), type(b)(b.spark, b.folder).loans.select(*LOAN_COLUMNS).repartition(7, "customer_id"), ["product_type"]), "loans",
    "SELECT product_type, count(*) AS n_stored, count(*) AS n_new, true AS equal FROM loans GROUP BY 1")
_other = [c for c in P.CHANNELS if c not in P.LEVER_CHANNELS]
_chm = ", ".join(_mean_if("value_proxy", f"product_type = 'BNPL' AND acquisition_channel = '{c}'") for c in _other)
register(
    "q13_guardrails", lambda b: G.guardrails(b.lever_frame), "lever_frame",
    f"""SELECT *, abs(decline_pct - 17.5) <= 2.0 AS decline_ok, worst_channel_mean > -600 AS channel_ok, prime_default_pct < 3.0 AS default_ok FROM (
  SELECT origination_cohort AS cohort, count(*) AS n,
    {S.he('100*' + S.ratio(S.n_if(lever_queries.TARGET['L5']), S.n_if(lever_queries.BASE['L5'])), 4)} AS decline_pct,
    {S.he(f'least({_chm})', 2)} AS worst_channel_mean, {S.he('100*' + dr(lever_queries.BASE['L4']), 4)} AS prime_default_pct FROM lever_frame GROUP BY 1)""",
)
