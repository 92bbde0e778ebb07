"""Table schemas, scans and sinks of a loan-book folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope import params as P

_TYPES = {
    "s": T.StringType(),
    "i": T.IntegerType(),
    "l": T.LongType(),
    "b": T.ByteType(),
    "d": T.DoubleType(),
    "t": T.DateType(),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[c]) for n, c in columns.items()])


SCHEMAS = {
    "customers": _schema(
        customer_id="s", region_type="s", income_proxy_band="s", employment_type="s", age="i",
        first_time_borrower="b", credit_quality_indicator="s", acquisition_channel="s", cac="l",
    ),
    "loans": _schema(
        loan_id="s", customer_id="s", loan_sequence="b", product_type="s", ticket_size="l",
        tenure_mo="i", interest_rate_apr="d", origination_risk_grade="s", origination_date="t",
        origination_cohort="s", approval_tat_hrs="d", months_on_book="i", loan_status="s",
        default_flag="b", value_proxy="l",
    ),
    "repayments": _schema(
        loan_id="s", period_index="i", period_date="t", scheduled_emi="l", outstanding_balance="l",
        amount_paid="l", dpd="i", delinquency_bucket="s", paid_on_time_flag="b",
        partial_payment_flag="b", prepayment_flag="b", missed_payments_cum="i",
    ),
    "behaviour_monthly": _schema(
        customer_id="s", month="s", cashflow_consistency="d", balance_volatility="d",
        spending_shock_flag="b", nach_bounce_count="i", credit_utilisation="d",
        bureau_inquiry_velocity="i", app_engagement="d",
    ),
    "value_components": _schema(
        loan_id="s", nii="d", fee="d", loss="d", servicing="d", cac_charged="d"
    ),
    "segments": _schema(loan_id="s", customer_id="s", segment="s"),
}


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Scan one table with its declared schema, so no pass over the data infers it."""
    reader = spark.read.schema(SCHEMAS[name])
    if fmt == "csv":
        return reader.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(f"{folder}/{name}.csv")
    return reader.parquet(f"{folder}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: read_table(spark, folder, n) for n in names or list(SCHEMAS)[:4]}


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def sample_rows(df: DataFrame, keys: list[str], n: int = 200) -> DataFrame:
    """First n rows in key order; Spark keeps only n rows per task."""
    return df.orderBy(*keys).limit(n)


def trim(df: DataFrame, columns: list[str], hidden: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Delivered columns, and the quarantined columns with the key they belong to."""
    hidden = hidden or [c for c in P.FORBIDDEN_COLUMNS if c in df.columns]
    return df.select(*columns), df.select(columns[0], *hidden)


def run_manifest(tables: dict[str, DataFrame], verdict: DataFrame | None = None, parameters: dict | None = None) -> DataFrame:
    """Row counts per table, the parameters of the run and the gate verdict as one row of data."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n")
        counts = one if counts is None else counts.unionByName(one)
    wide = counts.agg(
        *[F.max(F.when(F.col("t") == name, F.col("n"))).alias(f"n_{name}") for name in tables]
    ).select("*", *[F.lit(v).alias(k) for k, v in (parameters or {}).items()])
    if verdict is None:
        return wide
    # both sides are a single row
    return wide.withColumn("_one", F.lit(1)).join(verdict.withColumn("_one", F.lit(1)), "_one").drop("_one")
