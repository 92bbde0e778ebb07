"""PL1-PL12: policy levers and sensitivity grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions import bands
from ledgerscope.functions.numeric import half_even, total
from ledgerscope.operators import levers as L
from ledgerscope.plans import sql as S
from ledgerscope.plans import sql_frames  # noqa: F401
from ledgerscope.plans.registry import register

S.view("lever_frame", "loans customers beh_summary", """
SELECT l.*, acquisition_channel, cashflow_consistency_mean FROM loans l LEFT JOIN (SELECT customer_id, acquisition_channel FROM customers) USING (customer_id)
  LEFT JOIN (SELECT customer_id, cashflow_consistency_mean FROM beh_summary) USING (customer_id)""")
BASE = {
    "L1": "product_type = 'BNPL' AND acquisition_channel IN ('Digital ads','DSA')",
    "L2": "product_type = 'Personal' AND origination_risk_grade IN ('D','E')",
    "L4": "product_type = 'SME' AND origination_risk_grade IN ('A','B')",
    "L5": "product_type = 'SME' AND origination_risk_grade IN ('C','D','E')",
}
TARGET = dict(BASE, L2=BASE["L2"] + " AND cashflow_consistency_mean < 0.6", L5=BASE["L5"] + " AND cashflow_consistency_mean < 0.65")
S.view("lever_sums", "lever_frame", " UNION ALL ".join(
    f"SELECT '{l}' AS lever, count(*) AS n, coalesce({S.total('value_proxy')}, 0) AS value, coalesce({S.total('ticket_size')}, 0) AS ticket, "
    f"{S.lit(P.LGD[L.LEVER_PRODUCT[l]])} AS lgd FROM lever_frame WHERE {c}" for l, c in TARGET.items()))


def net(pp: str, lgd: str = "lgd", growth: str = "10e0") -> str:
    added = f"round_even(CAST(n AS DOUBLE)*{growth}/100e0, 0)"
    grow = f"({added}*{S.ratio('value', 'n')} - {added}*{S.ratio('ticket', 'n')}*{lgd}*{pp}/100e0)/1e7"
    return f"(CASE WHEN lever = 'L4' THEN {grow} ELSE (-value + ticket*{lgd}*{pp}/100e0)/1e7 END)"


register(
    "pl01_lever_targets", lambda b: L.lever_profile(b.lever_frame), "lever_frame",
    " UNION ALL ".join(f"""SELECT '{l}' AS lever, count(*) AS n, {S.he(S.mean('value_proxy'), 2)} AS mean_value, {S.total('value_proxy')} AS total_value,
  {S.he('100*' + S.rate('value_proxy < 0'), 4)} AS pct_loss_making FROM lever_frame WHERE {c}""" for l, c in TARGET.items()),
)
register(
    "pl02_cease_net", lambda b: L.lever_sums(b.lever_frame).filter(F.col("lever") != "L4").select(
        "lever", "n", *[half_even(L.lever_net(F.lit(float(p))), 2).alias(f"net_{p}pp") for p in (0, 2, 3)]),
    "lever_sums", f"SELECT lever, n, {', '.join(S.he(net(f'{p}e0'), 2) + f' AS net_{p}pp' for p in (0, 2, 3))} FROM lever_sums WHERE lever <> 'L4'",
)
register(
    "pl03_grow_net", lambda b: L.lever_sums(b.lever_frame).filter(F.col("lever") == "L4").select(
        L.new_loans(F.col("n").cast("double"), F.lit(10.0)).cast("long").alias("new_loans"),
        *[half_even(L.lever_net(F.lit(float(p))), 2).alias(f"net_{p}pp") for p in (0, 2, 3)]),
    "lever_sums", f"""SELECT CAST(round_even(n*10/100e0, 0) AS BIGINT) AS new_loans, {', '.join(S.he(net(f'{p}e0'), 2) + f' AS net_{p}pp' for p in (0, 2, 3))}
FROM lever_sums WHERE lever = 'L4'""",
)
_vol = f"(CASE WHEN lever = 'L4' THEN coalesce(round_even(CAST(n AS DOUBLE)*10e0/100e0, 0)*{S.ratio('ticket', 'n')}, 0) ELSE -ticket END/1e7)"
_grid = " UNION ALL ".join(f"SELECT lever, {S.lit(m)} AS macro, {_vol} AS vol, {net(f'{pp}e0')} AS net FROM lever_sums" for m, pp in P.STRESS_LEVELS)
register(
    "pl04_scenario_table", lambda b: L.scenario_table(b.lever_frame), "lever_sums",
    f"""SELECT coalesce({S.case('lever', P.LEVER_NAMES)}, '{P.COMBINED_NAME}') AS scenario, macro, {S.he('sum(vol)', 2)} AS volume_delta_cr, {S.he('sum(net)', 2)} AS net_delta_cr
FROM ({_grid}) GROUP BY GROUPING SETS ((macro, lever), (macro))""",
)


def wide_sql(key: str, source: str) -> str:
    cols = ", ".join(S.he(f"sum(CASE WHEN lever = '{l}' THEN net END)", 2) + f' AS "{l}"' for l in L.LEVERS)
    return f"SELECT {key}, {cols}, {S.he('sum(net)', 2)} AS combined FROM ({source}) GROUP BY 1"


register("pl05_extended_stress", lambda b: L.extended_stress(b.lever_frame), "lever_sums",
         wide_sql("stress_pp", " UNION ALL ".join(f"SELECT {s}e0 AS stress_pp, lever, {net(f'{s}e0')} AS net FROM lever_sums" for s in P.EXTENDED_STRESS)))
register("pl06_lgd_sensitivity", lambda b: L.lgd_sensitivity(b.lever_frame), "lever_sums",
         wide_sql("scenario", " UNION ALL ".join(
             f"SELECT {S.lit(n)} AS scenario, lever, {net('3e0', f'(lgd + {S.lit(d)})')} AS net FROM lever_sums" for n, d in P.LGD_FLEX)))
_cut = []
for _c in P.CUTOFFS:
    _parts = [f"{S.lit(_c)} AS cutoff"]
    for _l in ("L2", "L5"):
        _w = f"FILTER (WHERE {BASE[_l]} AND cashflow_consistency_mean < {S.lit(_c)})"
        _v = f"coalesce(CAST(sum({S.dec('value_proxy')}) {_w} AS DOUBLE), 0)"
        _t = f"coalesce(CAST(sum({S.dec('ticket_size')}) {_w} AS DOUBLE), 0)"
        _g = S.lit(P.LGD[L.LEVER_PRODUCT[_l]])
        _parts += [f'count(*) {_w} AS "{_l}_loans"', S.he(f"(-{_v} + {_t}*{_g}*0e0/100e0)/1e7", 2) + f' AS "{_l}_base"',
                   S.he(f"(-{_v} + {_t}*{_g}*3e0/100e0)/1e7", 2) + f' AS "{_l}_3pp"']
    _cut.append(f"SELECT {', '.join(_parts)} FROM lever_frame")
register("pl07_cutoff_sensitivity", lambda b: L.cutoff_sensitivity(b.lever_frame), "lever_frame", " UNION ALL ".join(_cut))
register(
    "pl08_growth_sensitivity", lambda b: L.growth_sensitivity(b.lever_frame), "lever_sums",
    " UNION ALL ".join(f"""SELECT {g}e0 AS growth_pct, CAST(round_even(CAST(n AS DOUBLE)*{g}e0/100e0, 0) AS BIGINT) AS new_loans,
  {S.he(f"round_even(CAST(n AS DOUBLE)*{g}e0/100e0, 0)*{S.ratio('ticket', 'n')}/1e7", 2)} AS origination_cr, {S.he(net('0e0', growth=f'{g}e0'), 2)} AS baseline_cr,
  {S.he(net('3e0', growth=f'{g}e0'), 2)} AS stress_3pp_cr, {S.he(net('3e0', growth=f'{g}e0') + ' - ' + net('0e0', growth=f'{g}e0'), 2)} AS delta_cr
FROM lever_sums WHERE lever = 'L4'""" for g in P.GROWTH_RATES),
)


def band_sql(lever: str) -> str:
    x = "cashflow_consistency_mean"
    case = f"CASE WHEN {x} <= 0 THEN NULL WHEN {x} <= 0.3 THEN '<0.3' WHEN {x} <= 0.4 THEN '0.3-0.4' WHEN {x} <= 0.5 THEN '0.4-0.5' WHEN {x} <= 0.6 THEN '0.5-0.6' WHEN {x} <= 0.7 THEN '0.6-0.7' WHEN {x} <= 1.0 THEN '0.7+' END"
    return f"""SELECT band, count(*) AS n_loans, {S.he(S.mean('value_proxy'), 2)} AS mean_value, {S.he(S.total('value_proxy') + '/1e7', 4)} AS total_cr,
  {S.he('100*' + S.rate('default_flag = 1'), 4)} AS default_rate_pct FROM (SELECT *, {case} AS band FROM lever_frame WHERE {BASE[lever]}) WHERE band IS NOT NULL GROUP BY 1"""


register("pl09_band_view_personal", lambda b: L.band_view(b.lever_frame, "L2"), "lever_frame", band_sql("L2"))
register("pl09_band_view_sme", lambda b: L.band_view(b.lever_frame, "L5"), "lever_frame", band_sql("L5"))
register(
    "pl10_channel_view", lambda b: L.channel_view(b.lever_frame), "lever_frame",
    f"""SELECT acquisition_channel, count(*) AS n_loans, {S.he(S.mean('value_proxy'), 2)} AS mean_value, {S.he(S.total('value_proxy') + '/1e7', 4)} AS total_cr,
  {S.he('100*' + S.rate('default_flag = 1'), 4)} AS default_rate_pct FROM lever_frame WHERE product_type = 'BNPL' GROUP BY 1""",
)


def segment_totals(b, rules: dict, name: str):
    return b.loans.withColumn("segment", bands.segment(rules)).groupBy("segment").agg(
        half_even(total("value_proxy") / P.CRORE, 2).alias(name))


_tot = lambda rules, name: f"(SELECT {S.segment(rules)} AS segment, {S.he(S.total('value_proxy') + '/1e7', 2)} AS {name} FROM loans GROUP BY 1)"
register(
    "pl11_segment_reconciliation",
    lambda b: L.reconcile_segments(segment_totals(b, P.HEURISTIC_SEGMENTS, "recomputed_cr"), segment_totals(b, P.HYBRID_SEGMENTS, "published_cr")),
    "loans",
    f"SELECT segment, recomputed_cr, published_cr, {S.he('recomputed_cr - published_cr', 4)} AS diff FROM {_tot(P.HEURISTIC_SEGMENTS, 'recomputed_cr')} "
    f"LEFT JOIN {_tot(P.HYBRID_SEGMENTS, 'published_cr')} USING (segment)",
)
_slope = f"({net('1e0')} - {net('0e0')})"
register(
    "pl12_break_points", lambda b: L.break_points(b.lever_frame), "lever_sums",
    f"""SELECT lever, {S.he(net('0e0'), 4)} AS base_cr, {S.he(_slope, 6)} AS slope_cr_per_pp,
  {S.he(f'CASE WHEN {_slope} < 0 THEN -{net("0e0")}/{_slope} END', 2)} AS break_pp FROM lever_sums""",
)
