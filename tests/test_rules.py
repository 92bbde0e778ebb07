"""Edges of bands and rules, null comparisons, rounding, dates."""

import pytest
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions import bands, finance
from ledgerscope.functions.numeric import half_even, rate, ratio


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("dpd, bucket", [(0, "Current"), (-1, "Current"), (1, "1-30"), (30, "1-30"), (60, "31-60"), (90, "61-90"), (91, "90+")])
def test_dpd_buckets_are_right_closed(spark, dpd, bucket):
    assert one(spark, bands.dpd_bucket("d"), d=float(dpd)) == bucket


def test_ninety_days_is_default_but_not_the_last_bucket(spark):
    assert one(spark, bands.dpd_bucket("d"), d=90.0) == "61-90"
    assert P.DEFAULT_DPD == 90


@pytest.mark.parametrize("product, ticket, band", [
    ("BNPL", 10_000, "<10k"), ("BNPL", 10_000.01, "10-25k"), ("BNPL", 25_000, "10-25k"), ("Personal", 50_000, "<50k"), ("SME", 1_000_001, ">1M")])
def test_ticket_bands(spark, product, ticket, band):
    assert one(spark, bands.ticket_band(F.col("p"), F.col("t")), p=product, t=float(ticket)) == band


@pytest.mark.parametrize("x, band", [(0.0, None), (0.3, "<0.3"), (0.31, "0.3-0.4"), (0.7, "0.6-0.7"), (1.0, "0.7+"), (1.01, None)])
def test_cashflow_bands(spark, x, band):
    assert one(spark, bands.cashflow_band("x0"), x0=x) == band


@pytest.mark.parametrize("z, grade", [(8000.0, "A"), (7999.9, "B"), (500.0, "D"), (499.0, "E")])
def test_grade_cuts_are_left_closed(spark, z, grade):
    assert one(spark, bands.left_closed_cuts("z", [8000, 5500, 2500, 500], P.GRADES), z=z) == grade


@pytest.mark.parametrize("risk, value, posture", [(50.0, -1.0, "exit"), (10.1, 1.0, "contain"), (10.0, 9601.0, "grow"), (10.0, 9600.0, "maintain")])
def test_posture_order(spark, risk, value, posture):
    assert one(spark, bands.posture("r", "v"), r=risk, v=value) == posture


def test_hybrid_high_rate_overrides_product(spark):
    df = spark.createDataFrame([("SME", "A", 32.5), ("SME", "A", 32.4)], "product_type string, origination_risk_grade string, interest_rate_apr double")
    assert [r[0] for r in df.select(bands.hybrid_segment()).collect()] == [P.HIGH_APR_SEGMENT, "5. SME Prime (A-B)"]


def test_unreached_month_counts_as_not_reached(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "m int")
    assert df.agg(rate(F.col("m") <= 3)).first()[0] == pytest.approx(1 / 3)


def test_rounding_is_half_to_even(spark):
    assert [one(spark, half_even("x0", 0), x0=v) for v in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]


def test_ratio_by_zero_is_null(spark):
    assert one(spark, ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) is None


def test_period_dates_return_to_the_anchor_day(spark):
    df = spark.sql("select date'2023-12-30' as o").crossJoin(spark.range(1, 5))
    got = [str(r[0]) for r in df.orderBy("id").select(finance.anchored_period_date("o", "id")).collect()]
    assert got == ["2023-12-30", "2024-01-30", "2024-02-29", "2024-03-30"]


def test_schedule_ends_at_zero_and_repays_the_principal(spark):
    loans = spark.createDataFrame([(1, 12, 1000.0, 24.0), (2, 6, 600.0, 0.0)], "loan_id int, tenure_mo int, ticket_size double, interest_rate_apr double")
    rows = finance.amortisation_schedule(loans).collect()
    for loan, n, ticket in ((1, 12, 1000.0), (2, 6, 600.0)):
        own = sorted((r for r in rows if r["loan_id"] == loan), key=lambda r: r["period_index"])
        assert len(own) == n and abs(own[-1]["closing_balance"]) < 1e-6
        assert sum(r["principal"] for r in own) == pytest.approx(ticket)


def test_canonical_product_text(spark):
    assert one(spark, bands.canonical_product("t"), t="  SME Term ") == "SME"
    assert bands is not None and one(spark, bands.after_last_dot("t"), t="2. Personal Prime (A-B)") == "Personal Prime (A-B)"
