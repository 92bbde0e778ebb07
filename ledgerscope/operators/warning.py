"""Early warning: spine, forward labels, point-in-time features, splits, bands, watchlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions import bands
from ledgerscope.functions.numeric import decimal, half_even, mean, rate, ratio, value_map
from ledgerscope.operators import panel, ranks
from ledgerscope.sources.scratch import settle

SPINE_COLUMNS = ["loan_id", "customer_id", "obs_month", "months_on_book", "product_type", "segment"]


def loan_events(repayments: DataFrame) -> DataFrame:
    """D, first month at 90+ (null if never), and L, last observed month."""
    return repayments.groupBy("loan_id").agg(
        F.min(F.when(F.col("dpd") >= P.DEFAULT_DPD, F.col("period_index"))).alias("D"),
        F.max("period_index").alias("L"),
    )


def with_events(repayments: DataFrame) -> DataFrame:
    """Every loan-month with its loan's D and L.

    Loans of measured, modest length take them from the loan's own window, in the partitioning the
    panel already has; otherwise they are aggregated and joined, which a very long loan survives.
    """
    if panel.is_short(repayments, "period_index", panel.CHUNK):
        loan = Window.partitionBy("loan_id")
        late = F.when(F.col("dpd") >= P.DEFAULT_DPD, F.col("period_index"))
        return repayments.select("*", F.min(late).over(loan).alias("D"), F.max("period_index").over(loan).alias("L"))
    return repayments.join(loan_events(repayments), "loan_id")


def performing() -> Column:
    """Seasoned and before the first 90+."""
    month = F.col("period_index")
    return (month >= P.MOB_FLOOR) & (month < F.coalesce(F.col("D"), month + 1))


def observation_spine(repayments: DataFrame, loans: DataFrame, *keep: str) -> DataFrame:
    """Loan-months still performing and seasoned: month >= floor and before the first 90+."""
    attrs = loans.select("loan_id", "customer_id", "product_type", bands.frozen_segment().alias("segment"))
    return (
        with_events(repayments).filter(performing()).join(attrs, "loan_id", "left")
        .select("loan_id", "customer_id", "obs_month", F.col("period_index").alias("months_on_book"),
                "product_type", "segment", *keep)
    )


def outcome_months(repayments: DataFrame, loans: DataFrame, horizon: int = P.LABEL_WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Spine, outcome and loan-side features in one pass: the panel is shuffled by loan once. ``keep`` names further columns of the loans."""
    keep = keep or []
    runs = panel.run_length(repayments, "loan_id", "period_index", {"partial_run": "partial_payment_flag"})
    attrs = loans.select("loan_id", "customer_id", "product_type", bands.frozen_segment().alias("segment"), "loan_status", *keep)
    months = with_events(runs).filter(performing()).join(attrs, "loan_id", "left").withColumnRenamed("period_index", "months_on_book")
    return months.select(
        *SPINE_COLUMNS, label_outcome(horizon).alias("label"), "partial_run", F.col("dpd").cast("int").alias("dpd_current"),
        F.col("missed_payments_cum").cast("long").alias("missed_cum_at_t"), *keep,
    )


def label_outcome(horizon: int = P.LABEL_WINDOW) -> Column:
    """1 defaults inside the window, 0 observed to survive it, -1 unknown (still active, window cut off)."""
    end = F.col("months_on_book") + horizon
    defaults = F.coalesce(F.col("D") <= end, F.lit(False))
    survives = (F.col("loan_status") != "Active") | (F.col("L") >= end)
    return F.when(defaults, 1).when(survives, 0).otherwise(-1)


def outcome_spine(spine: DataFrame, repayments: DataFrame, loans: DataFrame, horizon: int = P.LABEL_WINDOW) -> DataFrame:
    facts = loan_events(repayments).join(loans.select("loan_id", "loan_status"), "loan_id", "left")
    return spine.join(facts, "loan_id", "left").withColumn("label", label_outcome(horizon))


def forward_label(spine: DataFrame, repayments: DataFrame, loans: DataFrame, horizon: int = P.LABEL_WINDOW) -> DataFrame:
    labelled = outcome_spine(spine, repayments, loans, horizon).filter(F.col("label") != -1)
    return labelled.drop("D", "L", "loan_status")


def base_rates(outcomes: DataFrame, key: str) -> DataFrame:
    known = F.col("label") >= 0
    return outcomes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_spine"), F.count_if(~known).alias("n_censored"),
        F.count_if(known).alias("n_labelled"), F.count_if(F.col("label") == 1).alias("n_pos"),
        half_even(ratio(F.count_if(F.col("label") == 1), F.count_if(known)), 6).alias("base_rate"),
    )


def behaviour_features(behaviour: DataFrame, key: str = "customer_id") -> DataFrame:
    """Twelve backward-looking signals per customer (or other ``key``) and month, in one sort.

    The grain is one row per customer and month, so a customer has no more rows than the calendar
    has months. Windows count rows, not months: gaps stay gaps.
    """
    w = Window.partitionBy(key).orderBy("month")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    last3 = w.rowsBetween(-2, 0)
    row = F.row_number().over(w)
    bounces, shock = F.col("nach_bounce_count"), F.col("spending_shock_flag")
    streak_stop = F.max(F.when(bounces <= 0, F.col("_row"))).over(so_far)
    last_shock = F.max(F.when(shock == 1, F.col("_row"))).over(so_far)
    n_bounced = F.sum((bounces > 0).cast("int")).over(so_far)

    def change(c: str, k: int) -> Column:
        return F.col(c) - F.lag(c, k).over(w)

    return behaviour.withColumn("_row", row).select(
        key, "month",
        (F.col("_row") - F.coalesce(streak_stop, F.lit(0))).cast("long").alias("bounce_streak"),
        F.sum(bounces).over(last3).cast("long").alias("bounce_count_3m"),
        F.least(F.coalesce(F.col("_row") - last_shock, F.lit(P.RECENCY_CAP)), F.lit(P.RECENCY_CAP))
        .cast("long").alias("spending_shock_recency"),
        half_even(F.avg(shock).over(last3), 6).alias("spending_shock_rate_3m"),
        F.col("credit_utilisation").cast("double").alias("utilisation_level"),
        half_even(change("credit_utilisation", 3), 6).alias("utilisation_creep_3m"),
        F.col("balance_volatility").cast("double").alias("balance_volatility_level"),
        F.col("cashflow_consistency").cast("double").alias("cashflow_consistency_level"),
        (change("cashflow_consistency", 2).cast("double") / 2.0).alias("cashflow_consistency_slope"),
        change("bureau_inquiry_velocity", 3).cast("long").alias("inquiry_velocity_accel"),
        change("app_engagement", 3).cast("long").alias("app_engagement_drop"),
        ((bounces > 0) & (n_bounced == 1)).cast("int").alias("first_bounce_flag"),
        F.col("nach_bounce_count"), F.col("spending_shock_flag"),
    )


def repayment_features(repayments: DataFrame) -> DataFrame:
    runs = panel.run_length(repayments, "loan_id", "period_index", {"partial_run": "partial_payment_flag"})
    return runs.select(
        "loan_id", F.col("period_index").alias("months_on_book"), "partial_run",
        F.col("dpd").cast("int").alias("dpd_current"),
        F.col("missed_payments_cum").cast("long").alias("missed_cum_at_t"),
    )


def raw_matrix(labelled: DataFrame, behaviour: DataFrame, repayments: DataFrame | None = None, key: str = "customer_id") -> DataFrame:
    """Labelled months with behaviour, and with the loan-side features unless they are already there. ``key`` joins behaviour that several customers share."""
    b = behaviour_features(behaviour, key).withColumnRenamed("month", "obs_month")
    if repayments is not None:
        labelled = labelled.join(repayment_features(repayments), ["loan_id", "months_on_book"], "left")
    return labelled.join(b, [key, "obs_month"], "left")


def feature_matrix(
    labelled: DataFrame, behaviour: DataFrame, repayments: DataFrame | None = None, median_from: Column | None = None,
    key: str = "customer_id",
) -> DataFrame:
    """Exact joins, then fills: level features by their median, the rest by zero.

    The medians run over the whole matrix unless ``median_from`` restricts them (to training rows).
    """
    # written once: the medians and every later step read it instead of repeating the joins
    raw = settle(raw_matrix(labelled, behaviour, repayments, key))
    basis = raw if median_from is None else raw.filter(median_from)
    filled = {}
    # three level features, three exact medians in one pass over (feature, value)
    long = basis.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in P.LEVEL_FEATURES])).alias("s")
    ).select("s.feature", "s.x")
    medians = {r["feature"]: r["q0"] for r in ranks.quantiles(long, F.col("x"), [0.5], ["feature"]).collect()}
    for f in P.LEVEL_FEATURES:
        filled[f] = F.coalesce(F.col(f), F.lit(medians.get(f)))
    for f in P.FEATURES + P.ESCALATION_FEATURES + ["nach_bounce_count", "spending_shock_flag"]:
        if f not in filled:
            filled[f] = F.coalesce(F.col(f), F.lit(0))
    return raw.select(*SPINE_COLUMNS, "label", *[c.alias(f) for f, c in filled.items()])


def sign_check(matrix: DataFrame) -> DataFrame:
    """Correlation of every feature with the label against its declared sign; one pass for all."""
    one = matrix.agg(*[
        F.corr(F.col(f).cast("double"), F.col("label").cast("double")).alias(f) for f in P.FEATURES
    ])
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(s).alias("declared"), F.col(f).alias("corr"))
        for f, s in P.FEATURE_SIGNS.items()
    ])).alias("s")).select("s.*")
    c = F.coalesce(F.nanvl(F.col("corr"), F.lit(None)), F.lit(0.0))
    sign = F.when(F.abs(c) < 1e-6, 0).when(c > 0, 1).otherwise(-1)
    return rows.select(
        "feature", "declared", half_even(c, 6).alias("corr"),
        ((sign == F.col("declared")) | (sign == 0)).cast("int").alias("matches"),
    )


def triggers() -> dict[str, Column]:
    return {
        "two_partials_plus_bounce": (F.col("partial_run") >= 2) & (F.col("nach_bounce_count") >= 1),
        "bounce_streak_2": F.col("bounce_streak") >= 2,
        "shock_plus_util_creep": (F.col("spending_shock_flag") == 1) & (F.col("utilisation_creep_3m") >= 10),
        "already_delinquent_30dpd": F.col("dpd_current") >= P.ESCALATION_DPD,
    }


def trigger_flags(matrix: DataFrame) -> DataFrame:
    rules = triggers()
    fired = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return matrix.select(
        "*", *[c.cast("int").alias(n) for n, c in rules.items()],
        fired.alias("fired"), rules["already_delinquent_30dpd"].cast("int").alias("escalate"),
    )


def within_time_split(matrix: DataFrame, share: float = P.TEST_SHARE) -> DataFrame:
    """Whole loans to train or test, stratified by segment and by having a positive month.

    The order inside a stratum is a hash of the loan; a stratum may hold most of the book.
    """
    loans = matrix.groupBy("loan_id").agg(F.min("segment").alias("segment"), F.max("label").alias("any_pos"))
    # written once: numbering reads it several times, more often where a stratum is large
    loans = settle(loans.withColumn("stratum", F.concat_ws("|", "segment", "any_pos")).withColumn(
        "_h", shuffle_key("loan_id")
    ))
    sizes = loans.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    numbered = panel.sequence_number(loans, "stratum", ["_h", "loan_id"], "_r")
    # at most two strata per segment
    chosen = numbered.join(F.broadcast(sizes), "stratum").select(
        "loan_id", (F.col("_r") <= half_even(F.col("_n") * share, 0)).alias("_test")
    )
    return matrix.join(chosen, "loan_id").withColumn(
        "split_within", F.when(F.col("_test"), "test").otherwise("train")
    ).drop("_test")


def shuffle_key(c: str) -> Column:
    """Pseudo-random order of integer keys: multiplicative hash modulo a prime."""
    return (F.col(c) * 7919 + 104729) % 1000003


def out_of_time(month: Column, cut: int, last_full: int, horizon: int = P.LABEL_WINDOW) -> Column:
    return (
        F.when(month <= cut - (horizon + 1), "train")
        .when(month < cut, "embargo")
        .when(month <= last_full, "test")
        .otherwise("excluded")
    )


def split_audit(matrix: DataFrame, horizon: int = P.LABEL_WINDOW) -> DataFrame:
    """Rows, loans, base rate and month range per part of both splits."""
    # months are summed before a loan is counted in both splits
    sums = matrix.groupBy("loan_id", "split_within", "split_oot").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"),
        F.min("obs_month").alias("lo"), F.max("obs_month").alias("hi"),
    )
    parts = sums.select(
        "loan_id", "n", "p", "lo", "hi",
        F.explode(F.array(
            F.struct(F.lit("within").alias("split"), F.col("split_within").alias("part")),
            F.struct(F.lit("oot").alias("split"), F.col("split_oot").alias("part")),
        )).alias("s"),
    ).select("loan_id", "n", "p", "lo", "hi", "s.split", "s.part")
    per_loan = parts.groupBy("split", "part", "loan_id").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    return per_loan.groupBy("split", "part").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_loans"), F.sum("p").cast("long").alias("n_pos"),
        half_even(ratio(F.sum("p"), F.sum("n")), 6).alias("base_rate"),
        F.min("lo").cast("long").alias("first_month"), F.max("hi").cast("long").alias("last_month"),
        (F.max("hi") + horizon).cast("long").alias("window_end"),
    )


def loans_in_both(matrix: DataFrame, split: str) -> DataFrame:
    return matrix.groupBy("loan_id").agg(
        (F.count_if(F.col(split) == "train") > 0).alias("a"), (F.count_if(F.col(split) == "test") > 0).alias("b")
    ).agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"))


def band_cuts(test: DataFrame, score: str, red_capacity: int = P.RED_CAPACITY, amber_capacity: int = P.AMBER_CAPACITY) -> dict:
    """Score cuts that fill the monthly capacity on the operating book (below escalation)."""
    book = test.groupBy("obs_month").agg(
        F.count_if(F.col("dpd_current") < P.ESCALATION_DPD).alias("n")
    ).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("months")).first()
    monthly = book["n"] / book["months"]
    red = min(red_capacity / monthly, 1.0)
    amber = min(amber_capacity / monthly, 1.0 - red)
    operating = test.filter(F.col("dpd_current") < P.ESCALATION_DPD)
    probs = [1 - red, 1 - red - amber]
    red_cut, amber_cut = ranks.quantile_values(operating, F.col(score), [max(p, 0.0) for p in probs])
    return {"months": book["months"], "n_operating": book["n"], "red_frac": red, "amber_frac": amber,
            "red_cut": red_cut, "amber_cut": amber_cut}


def default_month(repayments: DataFrame) -> DataFrame:
    """Calendar month of the first 90+ per loan."""
    return repayments.filter(F.col("dpd") >= P.DEFAULT_DPD).groupBy("loan_id").agg(
        F.min("obs_month").alias("default_month")
    )


def lead_times(test: DataFrame, repayments: DataFrame, score: str, cut: float | Column, test_from: int) -> DataFrame:
    """First flag per defaulter while still below escalation, and the days from it to the default."""
    late = default_month(repayments).filter(F.col("default_month") >= test_from)
    chances = test.filter(F.col("dpd_current") < P.ESCALATION_DPD).join(late, "loan_id")
    flagged = F.when(F.col(score) >= cut, F.col("obs_month"))
    first = chances.groupBy("loan_id").agg(
        F.min(flagged).alias("first_flag"), F.max("default_month").alias("default_month")
    )
    return first.withColumn("lead_days", (F.col("default_month") - F.col("first_flag")) * F.lit(P.DAYS_PER_MONTH))


def lead_summary(leads: DataFrame) -> DataFrame:
    flagged = F.col("first_flag").isNotNull()
    stats = leads.agg(
        F.count(F.lit(1)).alias("n_defaulters"), F.count_if(flagged).alias("flagged_early"),
        half_even(rate(flagged), 6).alias("early_detection_rate"),
        half_even(F.avg(half_even("lead_days", 4)), 4).alias("mean_lead_days"),
    )
    median = ranks.quantiles(leads, F.col("lead_days"), [0.5])
    return stats.withColumn("median_lead_days", median.select(half_even("q0", 4)).scalar())


def with_band(df: DataFrame, score: str, cuts: dict) -> DataFrame:
    return df.withColumn(
        "band", bands.warning_band("dpd_current", score, F.lit(cuts["red_cut"]), F.lit(cuts["amber_cut"]))
    )


def threshold_table(test: DataFrame, repayments: DataFrame, score: str, cuts: dict, test_from: int) -> DataFrame:
    """Volume, share, precision, recall and mean lead per band; one scan for the counts."""
    per_band = with_band(test, score, cuts).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("pos")
    )
    book = Window.partitionBy()  # four bands
    operating = F.col("band") != "ESCALATION"
    all_n = F.sum(F.when(operating, F.col("n"))).over(book)
    all_pos = F.sum(F.when(operating, F.col("pos"))).over(book)
    lead = lead_times(test, repayments, score, F.lit(cuts["red_cut"]), test_from).agg(
        half_even(F.avg(half_even("lead_days", 4)), 4).alias("m")
    ).scalar()
    p_star = P.COST_FALSE_ALARM / (P.COST_FALSE_ALARM + P.COST_MISSED_DEFAULT)
    precision = ratio(F.col("pos"), F.col("n"))
    return per_band.select(
        "band", "n", half_even(F.col("n") / F.lit(float(cuts["months"])), 4).alias("vol_per_month"),
        half_even(F.when(operating, ratio(F.col("n"), all_n)), 6).alias("pct_book"),
        half_even(precision, 6).alias("precision"),
        half_even(F.when(operating, ratio(F.col("pos"), F.greatest(all_pos, F.lit(1)))), 6).alias("recall"),
        F.when(F.col("band") == "RED", lead).when(F.col("band") == "ESCALATION", 0.0).alias("mean_lead_days"),
        value_map("band", P.BAND_ACTION).alias("action"),
        F.when(F.col("band") == "RED", (precision >= F.lit(p_star)).cast("int")).alias("cost_justified"),
    )


def snapshot(scored: DataFrame, month: int) -> DataFrame:
    return scored.filter(F.col("obs_month") == month).withColumn(
        "is_behavioural_distress", bands.behavioural_distress().cast("int")
    )


def watchlist(scored: DataFrame, score: str, cuts: dict, month: int) -> DataFrame:
    """Everyone above green in the month, distressed first, then band, then score."""
    listed = with_band(snapshot(scored, month), score, cuts).filter(F.col("band") != "GREEN")
    return listed.select(
        "loan_id", "customer_id", "segment", "product_type", "obs_month", "dpd_current",
        half_even(score, 4).alias("ews_score"), "band", "is_behavioural_distress",
        value_map("band", P.BAND_ACTION).alias("recommended_action"),
    ).orderBy(
        F.desc("is_behavioural_distress"), value_map("band", P.BAND_RANK), F.desc("ews_score"), "loan_id"
    )


def flag_rates(scored: DataFrame, score: str, cuts: dict, month: int) -> DataFrame:
    b = F.col("band")
    return with_band(snapshot(scored, month), score, cuts).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"),
        half_even(rate(b == "ESCALATION"), 4).alias("pct_escalation"),
        half_even(rate(b == "RED"), 4).alias("pct_red"), half_even(rate(b == "AMBER"), 4).alias("pct_amber"),
        half_even(rate(b.isin("RED", "AMBER")), 4).alias("pct_watchlist"),
    )


def distress_cohort(scored: DataFrame, score: str, cuts: dict, month: int) -> DataFrame:
    d = F.col("is_behavioural_distress") == 1
    hot = F.col("band").isin("RED", "ESCALATION")
    y = F.col("label") == 1
    cohort = ratio(F.count_if(d & y), F.count_if(d))
    return with_band(snapshot(scored, month), score, cuts).agg(
        F.count(F.lit(1)).alias("n_snapshot"), F.count_if(d).alias("n_distress"),
        half_even(cohort, 6).alias("distress_default_rate"), half_even(rate(y), 6).alias("snapshot_default_rate"),
        half_even(ratio(cohort, rate(y)), 6).alias("lift"),
        half_even(ratio(F.count_if(d & hot), F.count_if(d)), 6).alias("share_red_or_escalation"),
    )


def score_by_months_to_default(test: DataFrame, repayments: DataFrame, score: str, test_from: int) -> DataFrame:
    late = default_month(repayments).filter(F.col("default_month") >= test_from)
    joined = test.join(late, "loan_id").withColumn("months_to_default", F.col("default_month") - F.col("obs_month"))
    return joined.filter(F.col("months_to_default").between(1, P.LOOK_BACK_MONTHS)).groupBy("months_to_default").agg(
        F.count(F.lit(1)).alias("n"), half_even(mean(score, 6), 6).alias("mean_score")
    )


def behaviour_risk(repayments: DataFrame, loans: DataFrame, behaviour: DataFrame) -> DataFrame:
    """(1 - worst cash flow) + worst volatility over a loan's months on book."""
    months = repayments.select("loan_id", "obs_month").join(
        loans.select("loan_id", "customer_id", "default_flag"), "loan_id"
    )
    joined = months.join(
        behaviour.select("customer_id", F.col("month").alias("obs_month"), "cashflow_consistency", "balance_volatility"),
        ["customer_id", "obs_month"],
    )
    per_loan = joined.groupBy("loan_id").agg(
        F.min("cashflow_consistency").alias("min_cf"), F.max("balance_volatility").alias("max_bv"),
        F.max("default_flag").alias("default_flag"),
    ).dropna()
    return per_loan.select(
        "loan_id", "default_flag",
        half_even(1 - F.col("min_cf").cast("double") + F.col("max_bv").cast("double"), 6).alias("score"),
    )


def deterioration_lead(
    repayments: DataFrame, loans: DataFrame, behaviour: DataFrame,
    threshold: float = P.DETERIORATION_CASHFLOW, months: int = P.LOOK_BACK_MONTHS, defaults: DataFrame | None = None,
) -> DataFrame:
    """Per defaulter the farthest of the preceding months that was already deteriorated (null: none).

    The look-back is unrolled to at most ``months`` rows per defaulter, so the join is a plain
    equi-join on customer and month. ``defaults`` may hold the loans' default_month already.
    """
    events = (default_month(repayments) if defaults is None else defaults).join(loans.select("loan_id", "customer_id"), "loan_id")
    back = events.select(
        "loan_id", "customer_id", "default_month", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("back")
    ).withColumn("month", F.col("default_month") - F.col("back"))
    weak = behaviour.filter(F.col("cashflow_consistency") < threshold).select(
        "customer_id", "month", F.lit(1).alias("_weak")
    )
    joined = back.join(weak, ["customer_id", "month"], "left")
    return joined.groupBy("loan_id").agg(
        F.max("default_month").alias("default_month"), F.max(F.when(F.col("_weak") == 1, F.col("back"))).alias("onset")
    ).withColumn("lead_days", F.col("onset") * P.ROUND_DAYS_PER_MONTH)


def never_defaulted_share(repayments: DataFrame) -> DataFrame:
    worst = repayments.groupBy("loan_id").agg(F.max("dpd").alias("worst"))
    late = F.col("worst") > 0
    return worst.agg(
        F.count_if(late).alias("n_delinquent"),
        half_even(ratio(F.count_if(late & (F.col("worst") < P.DEFAULT_DPD)), F.count_if(late)), 6).alias("share_never_90"),
    )
