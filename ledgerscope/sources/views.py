"""Loan-book views over the order and event tables.

Orders play the loans, order lines the repayment periods, events the behaviour signals. The event
days 1..30 stand for months. Everything here is projection and aggregation of the given tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions import bands
from ledgerscope.functions.finance import month_text
from ledgerscope.functions.numeric import decimal, exact, value_map
from ledgerscope.operators import economics, panel

# fixed values of the mapping
CHANNEL_OF_SEGMENT = {
    "AUTOMOBILE": "DSA",
    "BUILDING": "Digital ads",
    "FURNITURE": "Organic",
    "HOUSEHOLD": "Partner-embedded",
    "MACHINERY": "Referral",
}
CAC_OF_CHANNEL = {
    "Digital ads": 1200,
    "Partner-embedded": 800,
    "Referral": 500,
    "DSA": 1500,
    "Organic": 200,
}
GRADE_CUTS = [8000, 5500, 2500, 500]
PRODUCT_OF_PRIORITY = {"1": "BNPL", "2": "BNPL", "3": "Personal", "4": "Personal", "5": "SME"}
STATUS_OF_ORDER = {"F": "Closed", "O": "Active", "P": "Written-off"}
OUTCOME_OF_RETURN = {"R": "miss", "A": "partial", "N": "full"}
OUTCOME_DELTA = {"miss": P.DPD_MISS, "partial": P.DPD_PARTIAL, "full": P.DPD_FULL}
# calendar of the views
DATA_END = 30
LAST_FULL_WINDOW = 27
TEST_FROM = 20


class Book:
    """The loan-book tables of one data folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def customers(self) -> DataFrame:
        c = self.table("customer")
        places = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select("n_nationkey", F.col("r_name").alias("region_type"))
        key = F.col("c_custkey")
        channel = value_map("c_mktsegment", CHANNEL_OF_SEGMENT)
        return c.join(places, c.c_nationkey == places.n_nationkey, "left").select(
            key.alias("customer_id"),
            "region_type",
            value_map(F.col("c_nationkey") % 3, {0: "Low", 1: "Mid", 2: "High"}).alias("income_proxy_band"),
            value_map(key % 4, {0: "Salaried", 1: "Self-employed", 2: "Gig", 3: "Informal"}).alias("employment_type"),
            (18 + key % 48).cast("int").alias("age"),
            (key % 100 < 35).cast("int").alias("first_time_borrower"),
            bands.left_closed_cuts("c_acctbal", GRADE_CUTS, P.GRADES).alias("credit_quality_indicator"),
            channel.alias("acquisition_channel"),
            value_map(channel, CAC_OF_CHANNEL).cast("long").alias("cac"),
        )

    @cached_property
    def latent_risk(self) -> DataFrame:
        """Stand-in for the hidden creditworthiness: account balance. Validation only."""
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"), (F.col("c_acctbal") / 1000).alias("true_latent_risk")
        )

    @cached_property
    def originations(self) -> DataFrame:
        return self._priced_originations.drop("cac", "user_id")

    @cached_property
    def _priced_originations(self) -> DataFrame:
        o = self.table("orders").select(
            F.col("o_orderkey").alias("loan_id"),
            F.col("o_custkey").alias("customer_id"),
            value_map(F.substring("o_orderpriority", 1, 1), PRODUCT_OF_PRIORITY).alias("product_type"),
            decimal("o_totalprice").alias("ticket_size"),
            (1 + F.col("o_orderkey") % 36).cast("int").alias("tenure_mo"),
            (12 + (F.col("o_orderkey") * 7) % 37).cast("double").alias("interest_rate_apr"),
            F.to_date("o_orderdate").alias("origination_date"),
            month_text("o_orderdate").alias("origination_cohort"),
            (1 + F.col("o_orderkey") % 72).cast("double").alias("approval_tat_hrs"),
            value_map("o_orderstatus", STATUS_OF_ORDER).alias("loan_status"),
        )
        numbered = panel.sequence_number(
            o, "customer_id", ["origination_date", "loan_id"], "loan_sequence"
        )
        # grade, acquisition cost and event user in one join, straight from the customer table
        terms = self.table("customer").select(
            F.col("c_custkey").alias("customer_id"),
            bands.left_closed_cuts("c_acctbal", GRADE_CUTS, P.GRADES).alias("origination_risk_grade"),
            value_map(value_map("c_mktsegment", CHANNEL_OF_SEGMENT), CAC_OF_CHANNEL).cast("long").alias("cac"),
            self._user().alias("user_id"),
        )
        return numbered.join(terms, "customer_id", "left")

    @cached_property
    def outcomes(self) -> DataFrame:
        """Payment outcome per loan and period, before any days-past-due arithmetic."""
        li = self.table("lineitem").select(
            F.col("l_orderkey").alias("loan_id"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
            value_map("l_returnflag", OUTCOME_OF_RETURN).alias("outcome"),
            decimal("l_extendedprice").alias("outstanding_balance"),
            F.col("l_discount"), F.col("l_linestatus"),
        )
        numbered = panel.sequence_number(
            li, "loan_id", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"],
            "period_index",
        )
        due = F.col("outstanding_balance").cast("double") * (1 - F.col("l_discount"))
        paid = F.when(F.col("outcome") == "full", due).when(F.col("outcome") == "partial", due / 2)
        return numbered.select(
            "loan_id", "period_index", "outcome", "outstanding_balance",
            exact(F.coalesce(paid, F.lit(0.0)), 2).alias("amount_paid"),
            (F.col("outcome") == "full").cast("int").alias("paid_on_time_flag"),
            (F.col("outcome") == "partial").cast("int").alias("partial_payment_flag"),
            ((F.col("outcome") == "full") & (F.col("l_discount") >= 0.09)).cast("int").alias("prepayment_flag"),
            (1 + F.col("loan_id") % 17 + F.col("period_index") - 1).cast("int").alias("obs_month"),
        )

    @cached_property
    def repayments(self) -> DataFrame:
        walked = panel.dpd_walk(
            self.outcomes, "loan_id", "period_index", value_map("outcome", OUTCOME_DELTA),
            F.col("outcome") != "full",
        )
        return walked.withColumn("delinquency_bucket", bands.dpd_bucket("dpd"))

    def _user(self) -> Column:
        """The event user of a row of the customer table; several customers may share one."""
        users = self.table("events").agg((F.max("user_id") + 1).alias("n")).scalar()
        return F.col("c_custkey") % users

    @cached_property
    def event_users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("customer_id"), self._user().alias("user_id"))

    @cached_property
    def signals(self) -> DataFrame:
        """User x day signals: what all customers of a user share."""
        kind = F.col("event_type")
        value = decimal("value")
        e = self.table("events")
        daily = e.groupBy("user_id", F.dayofmonth("ts").alias("month")).agg(
            (F.sum(value).cast("double") / F.count("value")).alias("_avg"),
            F.stddev_pop("value").alias("_sd"),
            (F.max("value") > 100).cast("int").alias("spending_shock_flag"),
            F.count_if(kind == "error").cast("int").alias("nach_bounce_count"),
            F.count_if(kind == "signup").cast("int").alias("bureau_inquiry_velocity"),
            F.count_if(kind.isin("view", "click")).cast("int").alias("app_engagement"),
        )
        return daily.select(
            "user_id", F.col("month").cast("int").alias("month"),
            exact(1.0 / (1.0 + F.col("_avg") / 50.0)).alias("cashflow_consistency"),
            exact(F.col("_sd") / 100.0).alias("balance_volatility"),
            "spending_shock_flag", "nach_bounce_count",
            exact(F.least(F.col("_avg"), F.lit(150.0))).alias("credit_utilisation"),
            "bureau_inquiry_velocity", "app_engagement",
        )

    @cached_property
    def behaviour(self) -> DataFrame:
        """Customer x day signals. Events are summed per user and day before they meet customers."""
        return self.event_users.join(self.signals, "user_id").drop("user_id")

    @cached_property
    def loans(self) -> DataFrame:
        """Loans with outcomes and value; the components sit beside them."""
        return economics.value_proxy(self._priced_originations.drop("user_id"), None, self.repayments)

    @cached_property
    def components(self) -> DataFrame:
        return self.loans.select("loan_id", *economics.COMPONENTS)
