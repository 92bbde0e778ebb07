"""Hand-made loans, panels and customers with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions.numeric import decimal
from ledgerscope.operators import economics, frames, gates, levers, warning
from ledgerscope.functions import bands


def panel_of(spark, dpds: dict, start=1):
    rows = [(k, i, d, start + i - 1, 0, 100.0) for k, ds in dpds.items() for i, d in enumerate(ds, start=1)]
    df = spark.createDataFrame(rows, "loan_id int, period_index long, dpd int, obs_month int, partial_payment_flag int, outstanding_balance double")
    return df.withColumn("delinquency_bucket", bands.dpd_bucket("dpd")).withColumn("missed_payments_cum", F.lit(0).cast("long")).withColumn(
        "outstanding_balance", decimal("outstanding_balance"))


def loans_of(spark, rows):
    return spark.createDataFrame(rows, "loan_id int, customer_id int, product_type string, origination_risk_grade string, loan_status string")


def test_roll_rate_rows_sum_to_100_and_cure(spark):
    m = economics.roll_rate(panel_of(spark, {1: [0, 30, 60, 90, 60, 0], 2: [0, 0, 15]}))
    rows = {r["from_bucket"]: r for r in m.collect()}
    assert list(rows["Current"][f"to_{i}"] for i in range(5)) == pytest.approx([100 / 3, 200 / 3, 0, 0, 0], abs=1e-4)
    assert sum(rows["31-60"][f"to_{i}"] for i in range(5)) == pytest.approx(100)
    assert rows["90+"]["to_0"] is None
    cure = {r["from_bucket"]: r["cure_pct"] for r in economics.cure_chance(m).collect()}
    assert cure["31-60"] == 50.0 and cure["61-90"] == 100.0


def test_spine_stops_before_the_first_default_and_starts_at_the_floor(spark):
    rep = panel_of(spark, {1: [0, 0, 0, 30, 90, 0, 0], 2: [0, 0], 3: [0, 0, 90]})
    loans = loans_of(spark, [(i, i, "SME", "A", "Active") for i in (1, 2, 3)])
    assert [(r["loan_id"], r["months_on_book"]) for r in warning.observation_spine(rep, loans).orderBy("loan_id", "months_on_book").collect()] == [(1, 3), (1, 4)]


def test_labels_and_censoring(spark):
    rep = panel_of(spark, {1: [0] * 6, 2: [0] * 6, 3: [0] * 5 + [90]})
    loans = loans_of(spark, [(1, 1, "SME", "A", "Active"), (2, 2, "SME", "A", "Closed"), (3, 3, "SME", "A", "Active")])
    spine = warning.observation_spine(rep, loans)
    got = {(r["loan_id"], r["months_on_book"]): r["label"] for r in warning.forward_label(spine, rep, loans).collect()}
    # active: only month 3 sees its whole window; closed: all survive; defaulter at 6: months 3-5 positive
    assert got == {(1, 3): 0, (2, 3): 0, (2, 4): 0, (2, 5): 0, (2, 6): 0, (3, 3): 1, (3, 4): 1, (3, 5): 1}
    one_pass = {(r["loan_id"], r["months_on_book"]): r["label"] for r in warning.outcome_months(rep, loans).collect() if r["label"] >= 0}
    assert one_pass == got


def behaviour_of(spark, rows):
    return spark.createDataFrame(
        [(c, m, cf, 0.5, s, b, 40.0, 0, 1) for c, m, cf, s, b in rows],
        "customer_id int, month int, cashflow_consistency double, balance_volatility double, spending_shock_flag int, "
        "nach_bounce_count int, credit_utilisation double, bureau_inquiry_velocity int, app_engagement int",
    )


def test_behaviour_windows_count_rows_over_a_gap(spark):
    b = behaviour_of(spark, [(1, m, cf, s, n) for m, cf, s, n in [(1, .9, 0, 0), (2, .8, 1, 1), (3, .7, 0, 2), (5, .6, 0, 0), (6, .5, 0, 1)]])
    rows = {r["month"]: r for r in warning.behaviour_features(b).collect()}
    assert [rows[m]["bounce_streak"] for m in (1, 2, 3, 5, 6)] == [0, 1, 2, 0, 1]
    assert [rows[m]["bounce_count_3m"] for m in (1, 2, 3, 5, 6)] == [0, 1, 3, 3, 3]
    assert [rows[m]["spending_shock_recency"] for m in (1, 2, 3, 5, 6)] == [24, 0, 1, 2, 3]
    assert [rows[m]["first_bounce_flag"] for m in (1, 2, 3, 5, 6)] == [0, 1, 0, 0, 0]
    assert rows[5]["cashflow_consistency_slope"] == pytest.approx(-0.1) and rows[2]["cashflow_consistency_slope"] is None


def test_lead_takes_the_farthest_deteriorated_month(spark):
    rep = panel_of(spark, {1: [0] * 6 + [90], 2: [0] * 6 + [90]})
    loans = loans_of(spark, [(1, 1, "SME", "A", "Active"), (2, 2, "SME", "A", "Active")])
    b = behaviour_of(spark, [(1, m, .5 if m in (2, 5) else .9, 0, 0) for m in range(1, 8)] + [(2, m, .9, 0, 0) for m in range(1, 8)])
    got = {r["loan_id"]: (r["onset"], r["lead_days"]) for r in warning.deterioration_lead(rep, loans, b).collect()}
    assert got == {1: (5, 150), 2: (None, None)}


def test_value_of_a_repeat_borrower(spark):
    loans = spark.createDataFrame(
        [(1, 1, 1, "BNPL", 12.0, "Closed"), (2, 1, 2, "BNPL", 23.0, "Written-off"), (3, 1, 3, "SME", 11.0, "Active")],
        "loan_id int, customer_id int, loan_sequence int, product_type string, interest_rate_apr double, loan_status string",
    ).withColumn("ticket_size", decimal(F.lit(10_000)))
    customers = spark.createDataFrame([(1, 500)], "customer_id int, cac long")
    out = {r["loan_id"]: r for r in economics.value_proxy(loans, customers, panel_of(spark, {1: [0, 0], 2: [0, 30]})).collect()}
    assert [float(out[i]["cac_charged"]) for i in (1, 2, 3)] == [500.0, 0.0, 0.0]
    assert float(out[1]["value_proxy"]) == round(0.01 / 12 * 200 + 50 - 0 - 160 - 500, 2)
    assert float(out[2]["value_proxy"]) == round(0.12 / 12 * 200 + 50 - 40 - 160, 2)
    assert out[3]["months_on_book"] == 0 and float(out[3]["value_proxy"]) == 150.0


def test_degenerate_ticket_band_falls_back_to_thirds(spark):
    rows = [(i, "BNPL", float(1000 + i)) for i in range(40)] + [(100 + i, "SME", float(t)) for i, t in enumerate([100_000] * 5 + [500_000] * 5 + [2_000_000] * 5)]
    df = spark.createDataFrame(rows, "loan_id int, product_type string, t double").withColumn("ticket_size", decimal("t"))
    got = {(r["product_type"], r["ticket_band"]): r["count"] for r in economics.ticket_bands_with_fallback(df).groupBy("product_type", "ticket_band").count().collect()}
    assert got == {("BNPL", "<1,013"): 14, ("BNPL", "1,013-1,026"): 13, ("BNPL", ">1,026"): 13, ("SME", "<250k"): 5, ("SME", "250k-1M"): 5, ("SME", ">1M"): 5}


def test_levers_add_up_and_are_linear_in_stress(spark):
    rows = []
    for i in range(200):
        rows.append((i, ["BNPL", "Personal", "SME"][i % 3], "ABCDE"[i % 5], P.CHANNELS[i % 4], (i % 9) / 10, (i % 7 - 3) * 1e5, 1e5 + i * 1e4, i % 2))
    df = spark.createDataFrame(rows, "loan_id int, product_type string, origination_risk_grade string, acquisition_channel string, cashflow_consistency_mean double, v double, t double, default_flag int")
    frame = df.withColumn("value_proxy", decimal("v")).withColumn("ticket_size", decimal("t"))
    rows = sorted(levers.extended_stress(frame).collect(), key=lambda r: r["stress_pp"])
    for r in rows:
        assert r["combined"] == pytest.approx(sum(r[x] for x in levers.LEVERS), abs=0.021)
        for x in levers.LEVERS:
            slope = (rows[5][x] - rows[0][x]) / 5
            assert r[x] == pytest.approx(rows[0][x] + slope * r["stress_pp"], abs=0.011)
    table = levers.scenario_table(frame).collect()
    assert len(table) == 15
    grown = next(r for r in levers.growth_sensitivity(frame).collect() if r["growth_pct"] == 10.0)
    assert next(r for r in table if r["scenario"] == P.LEVER_NAMES["L4"] and r["macro"] == "+3pp")["net_delta_cr"] == grown["stress_3pp_cr"]


def test_verdict_needs_every_must(spark):
    rows = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, False)], "check_id string, must boolean, passed boolean")
    r = gates.verdict(rows).first()
    assert (r["must_pass"], r["must_total"], r["should_pass"], r["should_total"], r["verdict"]) == (1, 2, 0, 1, "FAIL")


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.range(100).withColumn("v", F.col("id") * 2)
    assert gates.fingerprint(a).first() == gates.fingerprint(a.repartition(5).orderBy(F.desc("id"))).first()
    assert gates.fingerprint(a).first() != gates.fingerprint(a.withColumn("v", F.col("v") + (F.col("id") == 7).cast("int"))).first()
    assert gates.fingerprint(a).first() != gates.fingerprint(a.unionByName(a.limit(1))).first()


def test_a_changed_value_in_the_stored_run_is_found(spark):
    new = spark.createDataFrame([(i, i % 3 if i % 5 else None, float(i) / 7) for i in range(60)], "id long, g long, v double")
    same = {r["g"]: r["equal"] for r in gates.run_difference(new.repartition(9), new, ["g"]).collect()}
    assert same == {0: True, 1: True, 2: True, None: True}
    stored = new.withColumn("v", F.when(F.col("id") == 7, F.col("v") + 1e-5).otherwise(F.col("v"))).filter("id != 11")
    got = {r["g"]: (r["n_stored"], r["n_new"], r["equal"]) for r in gates.run_difference(stored, new, ["g"]).collect()}
    assert got[0][2] and got[None][2] and not got[1][2] and got[2] == (got[2][1] - 1, got[2][1], False)


def test_contiguity_sees_gaps_and_repeats(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 1)], "loan_id int, period_index long")
    assert {r["loan_id"]: r["contiguous"] for r in gates.contiguity(df).collect()} == {1: True, 2: False, 3: False}
