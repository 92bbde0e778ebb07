"""Acceptance checks as data: each check is one row with a measure and a pass flag.

A group of checks is measured by wide one-row aggregates (one scan per table), then unpivoted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions import bands
from ledgerscope.functions.numeric import half_even, mean, rate, ratio, value_map
from ledgerscope.operators import levers, panel, ranks, scoring, warning
from ledgerscope.sources.scratch import settle

# check -> (group, must, comparison, threshold, criterion). Fixed values.
CHECKS = {
    "S1": ("structural", True, "==", 0.0, "all keys unique"),
    "S2": ("structural", True, "==", 0.0, "no orphan foreign keys"),
    "S3": ("structural", True, "==", 0.0, "no duplicate grain keys"),
    "S4": ("structural", True, "==", 0.0, "period index contiguous from 1 per loan"),
    "S5": ("structural", True, "==", 0.0, "one behaviour row per customer-month"),
    "S6": ("structural", True, "<=", 0.03, "repeat-loan split 80/16/4 within 3 pp"),
    "S7": ("structural", False, "<=", 0.10, "panel volumes within 10 %"),
    "Q1": ("data_quality", True, "==", 0.0, "must-have fields non-null"),
    "Q2": ("data_quality", True, "==", 0.0, "age 18-65, APR 12-48, DPD >= 0"),
    "Q3": ("data_quality", True, "==", 0.0, "categories in their domains"),
    "Q4": ("data_quality", True, "==", 0.0, "amounts not negative, flags 0/1"),
    "Q5": ("data_quality", True, "==", 0.0, "bucket agrees with DPD on every row"),
    "D1": ("mix", True, "<=", 0.03, "product mix within 3 pp"),
    "D2": ("mix", True, "<=", 0.03, "channel mix within 3 pp"),
    "D3": ("mix", True, "<=", 0.03, "grade mix within 3 pp"),
    "D4": ("mix", True, "<=", 0.03, "income and employment mixes within 3 pp"),
    "D5": ("mix", True, "<=", 0.03, "new-to-credit share within 3 pp"),
    "D6": ("mix", False, "<=", 0.20, "ticket medians within 20 %"),
    "DR1": ("default", True, "==", 0.0, "blended default in 6-9 %"),
    "DR2": ("default", True, "==", 0.0, "product default within 1.5 pp and ordered"),
    "DR3": ("default", True, "==", 0.0, "grade default increasing and within 20 %"),
    "DR4": ("default", False, "==", 0.0, "realised severity SME > Personal > BNPL"),
    "R1": ("relationship", True, "==", 0.0, "weaker profiles default more (four directions)"),
    "R2": ("relationship", True, "<", -0.05, "latent quality against default negative"),
    "R3": ("relationship", True, "==", 0.0, "mean APR increases A to E"),
    "R5": ("relationship", True, ">=", 60.0, "median behavioural lead >= 60 days"),
    "R6": ("relationship", True, ">", 0.60, "single-feature AUC > 0.60"),
    "R7": ("relationship", False, ">", 0.0, "missed count higher for defaulters"),
    "R8": ("relationship", False, ">", 0.0, "paid channels default more than organic and referral"),
    "R9": ("relationship", True, "==", 0.0, "Organic cheapest, DSA slowest"),
    "R10": ("relationship", False, ">=", 0.0, "newest cohorts' early delinquency not below the oldest"),
    "R11": ("relationship", True, ">", 0.0, "mean value grade A > grade E"),
    "R12": ("relationship", False, "<", 0.95, "single-feature AUC not a giveaway"),
    "V1": ("vintage_panel", True, "==", 0.0, "cumulative default non-decreasing in months on book"),
    "V2": ("vintage_panel", False, "==", 0.0, "older vintages observed at least as long"),
    "V3": ("vintage_panel", False, "==", 1.0, "default hazard peaks inside the range"),
    "V4": ("vintage_panel", True, "==", 0.0, "write-off reached, no rows after it"),
    "V5": ("vintage_panel", False, ">", 0.0, "some loans cure"),
    "V6": ("vintage_panel", True, ">=", 4.0, "default flag not a copy of the status"),
    "V7": ("vintage_panel", False, "<=", 0.10, "lifetime prepayment near 15 / 10 / 2 %"),
    "VP1": ("value_proxy", True, "<=", 1.5, "value equals its components"),
    "VP2": ("value_proxy", True, ">", 0.10, "more than 10 % positive and more than 10 % negative"),
    "VP3": ("value_proxy", True, ">", 0.0, "mean value grade A > grade E"),
    "VP4": ("value_proxy", False, "==", 0.0, "all values finite"),
}
EARLY_PERIODS = 3
PREPAYMENT = {"BNPL": 0.02, "Personal": 0.15, "SME": 0.10}
EXPECTED_SPLIT = P.REPEAT_LOAN_SPLIT


def _compare(op: Column, x: Column, y: Column) -> Column:
    return (
        F.when(op == "==", x == y).when(op == "<", x < y).when(op == "<=", x <= y)
        .when(op == ">", x > y).otherwise(x >= y)
    )


def results(measured: list[DataFrame], checks: dict = CHECKS) -> DataFrame:
    """Unpivot one-row frames whose columns are check ids, and judge each against its criterion."""
    long = []
    for df in measured:
        long.append(df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("check_id"), F.col(c).cast("double").alias("measured")) for c in df.columns
        ])).alias("s")).select("s.*"))
    rows = reduce(DataFrame.unionByName, long)
    key = F.col("check_id")

    def part(i: int) -> Column:
        return value_map(key, {k: v[i] for k, v in checks.items()})

    x = half_even("measured", 6)
    return rows.select(
        "check_id", part(0).alias("grp"), part(1).alias("must"), x.alias("measured"),
        part(4).alias("criterion"),
        F.coalesce(_compare(part(2), x, part(3)), F.lit(False)).alias("passed"),
    )


def verdict(rows: DataFrame) -> DataFrame:
    must, ok = F.col("must"), F.col("passed")
    return rows.agg(
        F.count_if(must & ok).alias("must_pass"), F.count_if(must).alias("must_total"),
        F.count_if(~must & ok).alias("should_pass"), F.count_if(~must).alias("should_total"),
        F.when(F.bool_and(ok | ~must), "PASS").otherwise("FAIL").alias("verdict"),
    )


def surplus(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of rows beyond the first of their key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return df.join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))


def contiguity(repayments: DataFrame) -> DataFrame:
    """Per loan: are its periods exactly 1..n, each once."""
    periods = repayments.groupBy("loan_id", "period_index").agg(F.count(F.lit(1)).alias("_n"))
    per = periods.groupBy("loan_id").agg(
        F.min("period_index").alias("lo"), F.max("period_index").alias("hi"),
        F.count(F.lit(1)).alias("n_distinct"), F.sum("_n").alias("n_rows"),
    )
    return _contiguous(per)


def _contiguous(per: DataFrame) -> DataFrame:
    ok = (F.col("lo") == 1) & (F.col("hi") == F.col("n_distinct")) & (F.col("n_distinct") == F.col("n_rows"))
    return per.withColumn("contiguous", ok)


def _curing(before: str) -> Column:
    return F.max(F.coalesce(((F.col(before) > 0) & (F.col("dpd") == 0)).cast("int"), F.lit(0))).alias("cured")


def loan_facts(repayments: DataFrame) -> DataFrame:
    """What the checks need of each loan's periods, a row per loan; loans of modest length take it from one shuffle and one sort."""
    month, late = F.col("period_index"), F.col("dpd") >= P.DEFAULT_DPD
    facts = [
        F.min(F.when(late, month)).alias("D"), F.max(month).alias("L"), F.min(F.when(late, F.col("obs_month"))).alias("default_month"),
        F.min(F.when(F.col("dpd") >= P.WRITE_OFF_DPD, month)).alias("w"), F.max("dpd").alias("m"),
        F.max("prepayment_flag").alias("pp"), F.max("missed_payments_cum").alias("mc"),
        *_early(EARLY_PERIODS),
    ]
    if not panel.is_short(repayments, "period_index", panel.CHUNK):
        out = repayments.groupBy("loan_id").agg(*facts)
        for more in (cured_loans(repayments), contiguity(repayments)):
            out = out.join(more.withColumnRenamed("loan_id", "_loan"), F.col("loan_id").eqNullSafe(F.col("_loan"))).drop("_loan")
        return out
    w = Window.partitionBy("loan_id").orderBy("period_index")
    again = (F.row_number().over(w) > 1) & F.lag("period_index").over(w).eqNullSafe(month)
    walked = repayments.select("*", F.lag("dpd").over(w).alias("_before"), again.alias("_again"))
    return _contiguous(walked.groupBy("loan_id").agg(
        *facts, _curing("_before"), F.min(month).alias("lo"), F.max(month).alias("hi"),
        F.count_if(~F.col("_again")).alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"),
    ))


def mix_gap(df: DataFrame, column: str, targets: dict) -> DataFrame:
    """Largest distance between a category's share and its target."""
    c = F.col(column)
    return df.agg(F.greatest(*[F.abs(rate(c == F.lit(k)) - F.lit(float(v))) for k, v in targets.items()]).alias("gap"))


def structural(customers, loans, facts, behaviour, volumes: dict[str, int]) -> list[DataFrame]:
    """``facts`` are those of ``loan_facts``, stored: they are read twice."""
    per_customer = loans.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    days = behaviour.groupBy("customer_id", "month").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("again"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_beh"))
    periods = facts.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rep"), F.coalesce(F.sum(F.col("n_rows") - F.col("n_distinct")), F.lit(0)).alias("n_again"),
        F.count_if(~F.col("contiguous")).alias("S4"))
    off = F.greatest(
        F.abs(F.col("n_rep") / float(volumes["repayments"]) - 1), F.abs(F.col("n_beh") / float(volumes["behaviour"]) - 1),
    )
    stray = facts.join(loans.select("loan_id"), "loan_id", "left_anti").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"))
    return [
        surplus(customers, ["customer_id"]).select((F.col("n") + surplus(loans, ["loan_id"]).scalar()).alias("S1")),
        orphans(loans, customers, "customer_id").select(
            (F.col("n") + stray.scalar()).alias("S2")
        ),
        # a row each
        periods.crossJoin(days).select((F.col("n_again") + F.col("again")).alias("S3"), "S4", F.col("again").alias("S5"), off.alias("S7")),
        mix_gap(per_customer, "_n", EXPECTED_SPLIT).select(F.col("gap").alias("S6")),
    ]


MUST_HAVE = {
    "customers": ["customer_id", "region_type", "income_proxy_band", "employment_type", "first_time_borrower",
                  "credit_quality_indicator", "acquisition_channel", "cac"],
    "loans": ["loan_id", "customer_id", "product_type", "ticket_size", "tenure_mo", "interest_rate_apr",
              "origination_risk_grade", "origination_date", "loan_status", "default_flag", "value_proxy"],
    "repayments": ["dpd", "delinquency_bucket", "outstanding_balance"],
}


def _nulls(table: str) -> Column:
    cols = MUST_HAVE[table]
    return F.coalesce(F.sum(sum((F.col(c).isNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNull().cast("int"))), F.lit(0))


def data_quality(customers, loans, repayments) -> list[DataFrame]:
    """One aggregate per table; the three rows are added up."""
    def outside(c, low, high):
        return F.count_if((F.col(c) < low) | (F.col(c) > high))

    c = customers.agg(
        _nulls("customers").alias("Q1"), outside("age", 18, 65).alias("Q2"), F.lit(0).alias("Q3"),
        F.count_if(F.col("cac") < 0).alias("Q4"), F.lit(0).alias("Q5"),
    )
    l = loans.agg(
        _nulls("loans").alias("Q1"), outside("interest_rate_apr", 12, 48).alias("Q2"),
        F.count_if(~F.col("product_type").isin(P.PRODUCTS) | ~F.col("origination_risk_grade").isin(P.GRADES)).alias("Q3"),
        F.count_if((F.col("ticket_size") < 0) | ~F.col("default_flag").isin(0, 1)).alias("Q4"), F.lit(0).alias("Q5"),
    )
    r = repayments.agg(
        _nulls("repayments").alias("Q1"), F.count_if(F.col("dpd") < 0).alias("Q2"),
        F.count_if(~F.col("delinquency_bucket").isin(P.BUCKETS)).alias("Q3"), F.lit(0).alias("Q4"),
        F.count_if(F.col("delinquency_bucket") != bands.dpd_bucket("dpd")).alias("Q5"),
    )
    ids = ["Q1", "Q2", "Q3", "Q4", "Q5"]
    return [c.unionByName(l).unionByName(r).agg(*[F.sum(i).alias(i) for i in ids])]


def mixes(customers, loans) -> list[DataFrame]:
    med = ranks.quantiles(loans, F.col("ticket_size").cast("double"), [0.5], ["product_type"])
    target = value_map("product_type", {k: float(v) for k, v in P.TICKET_MEDIANS.items()})

    def gap(column, targets):
        return F.greatest(*[F.abs(rate(F.col(column) == F.lit(k)) - F.lit(float(v))) for k, v in targets.items()])

    return [
        loans.agg(gap("product_type", P.PRODUCT_MIX).alias("D1"), gap("origination_risk_grade", P.GRADE_MIX).alias("D3")),
        customers.agg(
            gap("acquisition_channel", P.CHANNEL_MIX).alias("D2"),
            F.greatest(gap("income_proxy_band", P.INCOME_MIX), gap("employment_type", P.EMPLOYMENT_MIX)).alias("D4"),
            F.abs(rate(F.col("first_time_borrower") == 1) - P.NEW_TO_CREDIT_SHARE).alias("D5"),
        ),
        med.agg(F.max(F.abs(F.col("q0") - target) / target).alias("D6")),
    ]


def default_rate(condition: Column) -> Column:
    return ratio(F.count_if(condition & (F.col("default_flag") == 1)), F.count_if(condition))


def _violations(*tests: Column) -> Column:
    """How many of the tests do not hold (null counts as not holding)."""
    flags = [F.when(t, 0).otherwise(1) for t in tests]
    return sum(flags[1:], flags[0])


def defaults(loans) -> list[DataFrame]:
    blended = rate(F.col("default_flag") == 1)
    prod = {p: default_rate(F.col("product_type") == p) for p in P.PRODUCTS}
    grade = {g: default_rate(F.col("origination_risk_grade") == g) for g in P.GRADES}

    def severity(p):
        m = F.col("product_type") == p
        return ratio(F.sum(F.when(m & (F.col("loss") > 0), F.col("loss"))),
                     F.sum(F.when(m & (F.col("loss") > 0), F.col("last_balance"))))

    return [loans.agg(
        _violations(blended >= 0.06, blended <= 0.09).alias("DR1"),
        _violations(
            *[F.abs(prod[p] - t) <= 0.015 for p, t in P.DEFAULT_BY_PRODUCT.items()],
            prod["BNPL"] > prod["Personal"], prod["Personal"] > prod["SME"],
        ).alias("DR2"),
        _violations(
            *[grade[a] < grade[b] for a, b in zip(P.GRADES, P.GRADES[1:])],
            *[F.abs(grade[g] - t) / t <= 0.20 for g, t in P.DEFAULT_BY_GRADE.items()],
        ).alias("DR3"),
        _violations(severity("SME") > severity("Personal"), severity("Personal") > severity("BNPL")).alias("DR4"),
    )]


def relationships(customers, loans, repayments, behaviour, latent, facts) -> list[DataFrame]:
    profile = loans.join(customers, "customer_id").join(latent, "customer_id")
    missed = loans.select("loan_id", "default_flag").join(facts.select("loan_id", "mc"), "loan_id")
    d = F.col("default_flag")
    apr = {g: mean(F.when(F.col("origination_risk_grade") == g, F.col("interest_rate_apr"))) for g in P.GRADES}
    value = {g: mean(F.when(F.col("origination_risk_grade") == g, F.col("value_proxy"))) for g in P.GRADES}
    ch = {c: default_rate(F.col("acquisition_channel") == c) for c in P.CHANNELS}
    auc = ranks.discrimination(warning.behaviour_risk(repayments, loans, behaviour), "score", "default_flag")
    late = facts.select("loan_id", "default_month").filter("default_month is not null")
    # written once: a quantile reads its rows twice
    lead = settle(warning.deterioration_lead(repayments, loans, behaviour, defaults=late).select("lead_days"))
    lead_median = ranks.quantiles(lead, F.col("lead_days").cast("double"), [0.5])
    cac = ranks.quantiles(customers, F.col("cac").cast("double"), [0.5], ["acquisition_channel"])
    waits = settle(loans.join(customers.select("customer_id", "acquisition_channel"), "customer_id").select("approval_tat_hrs", "acquisition_channel"))
    tat = ranks.quantiles(waits, F.col("approval_tat_hrs"), [0.5], ["acquisition_channel"])
    cheapest = cac.agg(F.min(F.struct("q0", "acquisition_channel")).alias("s")).select("s.acquisition_channel")
    slowest = tat.agg(F.max(F.struct("q0", "acquisition_channel")).alias("s")).select(
        F.col("s.acquisition_channel").alias("slowest"))
    return [
        profile.agg(
            _violations(
                default_rate(F.col("income_proxy_band") == "Low") > default_rate(F.col("income_proxy_band") == "High"),
                default_rate(F.col("employment_type").isin("Gig", "Informal")) > default_rate(F.col("employment_type") == "Salaried"),
                default_rate(F.col("region_type") == "AFRICA") > default_rate(F.col("region_type") == "EUROPE"),
                default_rate(F.col("first_time_borrower") == 1) > default_rate(F.col("first_time_borrower") == 0),
            ).alias("R1"),
            F.corr("true_latent_risk", d.cast("double")).alias("R2"),
            _violations(*[apr[a] < apr[b] for a, b in zip(P.GRADES, P.GRADES[1:])]).alias("R3"),
            (F.least(ch["Digital ads"], ch["DSA"]) - F.greatest(ch["Organic"], ch["Referral"])).alias("R8"),
            (value["A"] - value["E"]).alias("R11"),
        ),
        lead_median.select(F.col("q0").alias("R5")),
        auc.select(F.col("auc").alias("R6"), F.col("auc").alias("R12")),
        missed.agg((mean(F.when(d == 1, F.col("mc"))) - mean(F.when(d == 0, F.col("mc")))).alias("R7")),
        slowest.select(_violations(cheapest.scalar() == "Organic", F.col("slowest") == "DSA").alias("R9")),
        shift_of(facts, loans).select(F.col("shift").alias("R10")),
    ]


def _early(k: int) -> list[Column]:
    early = F.col("period_index") <= k
    return [F.count_if(early).alias("n_early"), F.count_if(early & (F.col("dpd") > 0)).alias("n_early_late")]


def early_delinquency_shift(repayments: DataFrame, loans: DataFrame, k: int = EARLY_PERIODS, cohorts: int = 6) -> DataFrame:
    """Mean early delinquency of the newest cohorts minus that of the oldest."""
    return shift_of(repayments.groupBy("loan_id").agg(*_early(k)), loans, cohorts)


def shift_of(facts: DataFrame, loans: DataFrame, cohorts: int = 6) -> DataFrame:
    """The same from early periods counted per loan."""
    early = facts.filter("n_early > 0").select("loan_id", "n_early", "n_early_late").join(
        loans.select("loan_id", "origination_cohort"), "loan_id"
    ).groupBy("origination_cohort").agg(ratio(F.sum("n_early_late"), F.sum("n_early")).alias("r"))
    # one row per cohort
    up, down = Window.orderBy("origination_cohort"), Window.orderBy(F.desc("origination_cohort"))
    ranked = early.select("r", F.row_number().over(up).alias("u"), F.row_number().over(down).alias("d"))
    return ranked.agg(
        half_even(F.avg(F.when(F.col("d") <= cohorts, F.col("r"))) - F.avg(F.when(F.col("u") <= cohorts, F.col("r"))), 6).alias("shift")
    )


def default_curve(repayments: DataFrame) -> DataFrame:
    """New and cumulative defaults by months on book, with the loans still at risk."""
    return curve_of(warning.loan_events(repayments))


def curve_of(per: DataFrame) -> DataFrame:
    """The same from D and L per loan."""
    by = per.groupBy(F.coalesce(F.col("D"), F.col("L")).alias("mob")).agg(
        F.count("D").alias("new_defaults"), F.count(F.lit(1)).alias("leaving")
    )
    w = Window.orderBy("mob").rowsBetween(Window.unboundedPreceding, 0)  # one row per month on book
    later = Window.orderBy("mob").rowsBetween(0, Window.unboundedFollowing)
    return by.select(
        "mob", "new_defaults", F.sum("new_defaults").over(w).alias("cumulative"),
        F.sum("leaving").over(later).alias("at_risk"),
    ).withColumn("hazard", half_even(ratio(F.col("new_defaults"), F.col("at_risk")), 6))


def cured_loans(repayments: DataFrame) -> DataFrame:
    """Per loan: did a delinquent month turn current the month after."""
    before = panel.neighbour(repayments, "loan_id", "period_index", "dpd", "_before", step=-1)
    return before.groupBy("loan_id").agg(_curing("_before"))


def vintage_panel(loans, facts) -> list[DataFrame]:
    """``facts`` are those of ``loan_facts``, stored: they are read three times."""
    step = Window.orderBy("mob")  # one row per month on book
    shape = curve_of(facts).withColumn("_p", F.lag("cumulative").over(step)).agg(
        F.count_if(F.col("cumulative") < F.col("_p")).alias("V1"), F.min("mob").alias("lo"), F.max("mob").alias("hi"),
        F.max_by("mob", F.struct("hazard", -F.col("mob"))).alias("at"),
    ).select("V1", ((F.col("at") > F.col("lo")) & (F.col("at") < F.col("hi"))).cast("int").alias("V3"))
    cohort = loans.groupBy("origination_cohort").agg(F.max("months_on_book").alias("m"))
    newer = Window.orderBy("origination_cohort")  # one row per cohort
    longer = cohort.withColumn("_p", F.lag("m").over(newer)).agg(F.count_if(F.col("m") > F.col("_p")).alias("V2"))
    ends = facts.agg(
        (F.coalesce(F.sum(F.col("L") - F.col("w")), F.lit(0)) + F.when(F.max("m") >= P.WRITE_OFF_DPD, 0).otherwise(1)).alias("V4"),
        rate(F.col("cured") == 1).alias("V5"),
    )
    status = loans.groupBy("loan_status", "default_flag").agg(F.lit(1).alias("_")).agg(F.count(F.lit(1)).alias("V6"))
    by_product = loans.select("loan_id", "product_type").join(facts.select("loan_id", "pp"), "loan_id")
    gaps = [
        F.abs(ratio(F.count_if((F.col("product_type") == p) & (F.col("pp") == 1)), F.count_if(F.col("product_type") == p)) - t)
        for p, t in PREPAYMENT.items()
    ]
    return [shape, longer, ends, status, by_product.agg(F.greatest(*gaps).alias("V7"))]


def value_checks(loans) -> list[DataFrame]:
    v = F.col("value_proxy")
    net = F.col("nii") + F.col("fee") - F.col("loss") - F.col("servicing") - F.col("cac_charged")
    by = {g: mean(F.when(F.col("origination_risk_grade") == g, v)) for g in ("A", "E")}
    return [loans.agg(
        F.max(F.abs(v - net)).alias("VP1"), F.least(rate(v > 0), rate(v < 0)).alias("VP2"),
        (by["A"] - by["E"]).alias("VP3"), F.count_if(v.isNull()).alias("VP4"),
    )]


def all_checks(customers, loans, repayments, behaviour, latent, volumes: dict[str, int]) -> DataFrame:
    """Every check of the data gate. The tables are read many times: pass stored ones."""
    facts = settle(loan_facts(repayments))
    return results(
        structural(customers, loans, facts, behaviour, volumes) + data_quality(customers, loans, repayments)
        + mixes(customers, loans) + defaults(loans) + relationships(customers, loans, repayments, behaviour, latent, facts)
        + vintage_panel(loans, facts) + value_checks(loans)
    )


def score_gate(
    test: DataFrame, repayments: DataFrame, latent: DataFrame, score: str, test_from: int,
    decile_order: list[str], replicates: int = 200,
) -> DataFrame:
    """Lead time, AUC, KS, lift, leakage and stability of a score, one row each."""
    clean = test.filter(F.col("dpd_current") == 0)
    operating = test.filter(F.col("dpd_current") < P.ESCALATION_DPD)
    cut = ranks.quantile_values(operating, F.col(score), [0.9])[0]
    lead = warning.lead_times(test, repayments, score, F.lit(cut), test_from).agg(
        F.avg(half_even("lead_days", 4)).alias("lead_time")
    )
    disc = ranks.discrimination(clean, score, "label").select(F.col("auc").alias("oot_auc"), F.col("ks").alias("oot_ks"))
    lift = ranks.deciles(clean, score, decile_order).agg(
        ratio(default_share(F.col("decile") == 9), default_share(F.lit(True))).alias("lift")
    )
    audit = leakage(test, latent, score).select(F.col("corr").alias("no_leakage"))
    width = scoring.bootstrap_auc(operating, score, "label", decile_order, replicates).select((F.col("hi") - F.col("lo")).alias("stable"))
    checks = {
        "lead_time": ("score", True, ">=", P.SCORE_GATE["lead_time"], "mean lead at the top 10 % >= 30 days"),
        "oot_auc": ("score", True, ">=", P.SCORE_GATE["oot_auc"], "AUC on current loans >= 0.70"),
        "oot_ks": ("score", True, ">=", P.SCORE_GATE["oot_ks"], "KS on current loans >= 0.30"),
        "lift": ("score", True, ">=", P.SCORE_GATE["lift"], "top-decile lift >= 2.5"),
        "no_leakage": ("score", True, "<", 0.0, "score against latent quality negative"),
        "stable": ("score", True, "<", P.SCORE_GATE["stable"], "bootstrap AUC interval narrower than 0.15"),
    }
    return results([lead, disc, lift, audit, width], checks)


def default_share(condition: Column) -> Column:
    return ratio(F.count_if(condition & (F.col("label") == 1)), F.count_if(condition))


def leakage(scored: DataFrame, latent: DataFrame, score: str) -> DataFrame:
    """Correlation of score and latent quality, and forbidden columns present in the scored frame."""
    hidden = [c for c in scored.columns if c.lower() in P.FORBIDDEN_COLUMNS]
    return scored.join(latent, "customer_id", "left").agg(
        half_even(F.corr(F.col(score).cast("double"), "true_latent_risk"), 6).alias("corr"),
    ).withColumn("n_forbidden", F.lit(len(hidden))).withColumn("clean", (F.col("corr") < 0) & (F.col("n_forbidden") == 0))


def fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row count and order-free sums of row hashes of a table, or of each of its parts; equal tables have equal fingerprints.

    A row is written as length:value per column, in the order of their names (- if null, doubles at 6 digits), and hashed by md5; the sums of the
    two halves of 60 bits count repeated rows as often as they occur. Any engine with md5 gets the same numbers.
    """
    def text(c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        value = (F.col(c).cast("decimal(30,6)") if kind in ("double", "float") else F.col(c)).cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    digest = F.md5(F.concat_ws(",", *[text(c) for c in sorted(df.columns)]))
    halves = {f"sum_{i}": F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in (0, 1)}
    rows = df.select(*(by or []), *[v.alias(n) for n, v in halves.items()])
    sums = [F.sum(F.col(n).cast("decimal(38,0)")).cast("string").alias(n) for n in halves]
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def run_difference(stored: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Per part: rows of the stored run and of the new one, and whether their fingerprints are equal."""
    a, b = (fingerprint(df, by).withColumnsRenamed({c: f"_{side}_{c}" for c in [*by, "n_rows", "sum_0", "sum_1"]}) for side, df in (("old", stored), ("new", new)))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
    equal = F.lit(True)
    for c in ("n_rows", "sum_0", "sum_1"):
        equal = equal & F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
    return a.join(b, same, "full").select(
        *[F.coalesce(f"_old_{c}", f"_new_{c}").alias(c) for c in by],
        F.coalesce("_old_n_rows", F.lit(0)).alias("n_stored"), F.coalesce("_new_n_rows", F.lit(0)).alias("n_new"), equal.alias("equal"))


def max_difference(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Largest absolute difference per column between two runs, and keys in only one of them."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    one_sided = F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()
    return joined.agg(
        F.count_if(one_sided).alias("n_unmatched"),
        *[F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))).cast("double").alias(f"diff_{c}") for c in columns],
    )


def guardrails(frame: DataFrame, decline_target: float = 17.5) -> DataFrame:
    """Per cohort: share of SME C-E declined, worst remaining BNPL channel, SME A-B default, and their limits."""
    flow = levers.base_set("L5")
    prime = levers.base_set("L4")
    bnpl = F.col("product_type") == "BNPL"
    kept = [c for c in P.CHANNELS if c not in P.LEVER_CHANNELS]
    means = [mean(F.when(bnpl & (F.col("acquisition_channel") == c), F.col("value_proxy"))) for c in kept]
    return frame.groupBy(F.col("origination_cohort").alias("cohort")).agg(
        F.count(F.lit(1)).alias("n"),
        half_even(100 * ratio(F.count_if(levers.targets("L5")), F.count_if(flow)), 4).alias("decline_pct"),
        half_even(F.least(*means), 2).alias("worst_channel_mean"),
        half_even(100 * default_rate(prime), 4).alias("prime_default_pct"),
    ).select(
        "*", (F.abs(F.col("decline_pct") - decline_target) <= 2.0).alias("decline_ok"),
        (F.col("worst_channel_mean") > -600).alias("channel_ok"), (F.col("prime_default_pct") < 3.0).alias("default_ok"),
    )
