"""Customer, loan and product-cell frames, and the checks that tie them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions import bands
from ledgerscope.functions.numeric import decimal, exact, half_even, mean, rate, ratio, total, value_map
from ledgerscope.operators import economics

PROFILE = [
    "region_type", "income_proxy_band", "employment_type", "age", "first_time_borrower",
    "credit_quality_indicator", "acquisition_channel",
]
BEHAVIOUR_MEANS = [
    "cashflow_consistency", "balance_volatility", "credit_utilisation", "app_engagement", "bureau_inquiry_velocity",
]


def behaviour_summary(behaviour: DataFrame, key: str = "customer_id") -> DataFrame:
    return behaviour.groupBy(key).agg(
        *[exact(mean(c, 6)).alias(f"{c}_mean") for c in BEHAVIOUR_MEANS],
        F.sum("nach_bounce_count").alias("nach_bounce_total"),
        exact(rate(F.col("spending_shock_flag") == 1)).alias("spending_shock_rate"),
        F.count(F.lit(1)).alias("n_months_observed"),
    )


def worst_rank() -> Column:
    return F.max(bands.bucket_rank("delinquency_bucket")).alias("worst_delq_rank")


def worst_delinquency(repayments: DataFrame) -> DataFrame:
    return repayments.groupBy("loan_id").agg(worst_rank())


def bucket_of_rank(rank: Column) -> Column:
    return value_map(rank, dict(enumerate(P.BUCKETS)))


def outcome_frame(loans: DataFrame, worst: DataFrame) -> DataFrame:
    """Loans with their worst delinquency, maturity and margin; ``worst`` holds worst_delq_rank per loan."""
    rank = F.coalesce(F.col("worst_delq_rank"), F.lit(0))
    joined = loans.join(worst.select("loan_id", "worst_delq_rank"), "loan_id", "left")
    return (
        joined.withColumn("worst_delq_rank", rank)
        .withColumn("worst_delq_bucket", bucket_of_rank(F.col("worst_delq_rank")))
        .withColumn("ever_90plus", (F.col("worst_delq_rank") >= 4).cast("int"))
        .withColumn("seasoned_mob12", (F.col("months_on_book") >= P.MATURE_MOB).cast("int"))
        .withColumn("margin_before_cac", decimal(economics.margin_before_cac(), 6))
    )


def loan_frame(
    loans: DataFrame, customers: DataFrame, worst: DataFrame, summary: DataFrame, basis: DataFrame | None = None,
) -> DataFrame:
    """One row per loan: outcomes, components, margin, bands, borrower profile, behaviour summary per customer."""
    borrower = customers.select("customer_id", *PROFILE).join(summary, "customer_id", "left")
    banded = economics.ticket_bands_with_fallback(loans, basis=basis).withColumn("tenure_band", bands.tenure_band())
    return outcome_frame(banded, worst).join(borrower, "customer_id", "left")


def customer_frame(customers: DataFrame, loan_frame: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per customer; customers without loans or behaviour keep nulls. The loan frame needs no bands or borrower here."""
    products = [F.max((F.col("product_type") == p).cast("int")) for p in P.PRODUCTS]
    rel = loan_frame.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_loans"),
        # three products at most: three flags instead of a set per customer
        sum(products[1:], products[0]).cast("long").alias("n_products_held"),
        F.min_by(value_map("product_type", {p: i for i, p in enumerate(P.PRODUCTS)}), "loan_sequence").alias("_primary"),
        F.sum("ticket_size").alias("total_originated"),
        half_even(mean("interest_rate_apr"), 6).alias("mean_apr"),
        F.min(F.year("origination_date") * 100 + F.month("origination_date")).alias("_first"),
        F.max("months_on_book").alias("max_months_on_book"),
        F.sum("value_proxy").alias("clv"),
        F.sum("nii").alias("total_nii"), F.sum("fee").alias("total_fee"), F.sum("loss").alias("total_loss"),
        F.sum("servicing").alias("total_servicing"), F.sum("cac_charged").alias("total_cac"),
        F.sum("margin_before_cac").alias("margin_before_cac_total"),
        F.max("default_flag").alias("any_default"), F.sum("default_flag").alias("n_defaults"),
        F.count_if(F.col("loan_status") == "Written-off").alias("n_writeoffs"),
        F.max("worst_delq_rank").alias("worst_delq_rank_ever"), F.max("ever_90plus").alias("ever_90plus"),
    )
    first = F.concat_ws("-", F.substring(F.col("_first").cast("string"), 1, 4), F.substring(F.col("_first").cast("string"), 5, 2))
    rel = (
        rel.withColumn("primary_product", value_map("_primary", dict(enumerate(P.PRODUCTS))))
        .withColumn("first_cohort", first)
        .withColumn("worst_delq_bucket_ever", bucket_of_rank(F.col("worst_delq_rank_ever")))
        .withColumn("clv_to_cac", F.when(F.col("total_cac") > 0, half_even(ratio(F.col("clv"), F.col("total_cac")), 6)))
        .withColumn("net_value_positive", (F.col("clv") > 0).cast("int"))
        .drop("_primary", "_first")
    )
    return (
        customers.join(rel, "customer_id", "left")
        .join(summary, "customer_id", "left")
        .withColumn("has_behaviour", F.col("n_months_observed").isNotNull().cast("int"))
    )


def product_cell_frame(loan_frame: DataFrame) -> DataFrame:
    keys = ["product_type", "tenure_band", "ticket_band"]
    seasoned = F.col("seasoned_mob12") == 1
    defaulted = F.col("default_flag") == 1
    book = Window.partitionBy()  # one row per cell
    cells = loan_frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_loans"),
        half_even(rate(defaulted), 6).alias("default_rate"),
        half_even(rate(F.col("ever_90plus") == 1), 6).alias("ever_90_rate"),
        half_even(mean("value_proxy"), 4).alias("mean_value_proxy"),
        total("value_proxy").alias("total_value_proxy"),
        half_even(mean("ticket_size"), 4).alias("mean_ticket"),
        half_even(mean("tenure_mo"), 6).alias("mean_tenure"),
        half_even(mean("interest_rate_apr"), 6).alias("mean_apr"),
        half_even(mean("months_on_book"), 6).alias("mean_mob"),
        F.count_if(seasoned).alias("n_seasoned"),
        half_even(ratio(F.count_if(seasoned & defaulted), F.count_if(seasoned)), 6).alias("default_rate_seasoned"),
    )
    return (
        cells.withColumn("share_of_book", half_even(ratio(F.col("n_loans"), F.sum("n_loans").over(book)), 6))
        .withColumn("loss_making", (F.col("mean_value_proxy") < 0).cast("int"))
        .orderBy(*keys)
    )


def conservation_checks(loans: DataFrame, loan_frame: DataFrame, customer_frame: DataFrame, cells: DataFrame) -> DataFrame:
    """The totals that must agree between the frames, one row per check."""
    value = loans.agg(F.sum("value_proxy").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    clv = customer_frame.agg(F.sum("clv").cast("double").alias("b"))
    covered = cells.agg(F.sum("n_loans").cast("double").alias("b"))
    unbanded = loan_frame.agg(
        F.count_if(F.col("tenure_band").isNull() | F.col("ticket_band").isNull()).cast("double").alias("b")
    )
    hidden = len([c for f in (loan_frame, customer_frame, cells) for c in f.columns if c.lower() in P.FORBIDDEN_COLUMNS])
    rows = [
        value.select(F.lit("clv_equals_value").alias("check"), F.col("a").alias("expected"), clv.scalar().alias("measured")),
        value.select(F.lit("cells_cover_loans").alias("check"), F.col("n").alias("expected"), covered.scalar().alias("measured")),
        unbanded.select(F.lit("every_loan_banded").alias("check"), F.lit(0.0).alias("expected"), F.col("b").alias("measured")),
        unbanded.select(F.lit("no_forbidden_column").alias("check"), F.lit(0.0).alias("expected"), F.lit(float(hidden)).alias("measured")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("passed", F.abs(F.col("expected") - F.col("measured")) < 0.01)
