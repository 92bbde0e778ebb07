"""Month arithmetic and instalment formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.numeric import col


def month_text(d: Column | str) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def month_index(d: Column | str) -> Column:
    return F.year(col(d)) * 12 + F.month(col(d))


def month_index_of_text(m: Column | str) -> Column:
    return F.substring(col(m), 1, 4).cast("int") * 12 + F.substring(col(m), 6, 2).cast("int")


def anchored_period_date(origination: Column | str, period: Column | str) -> Column:
    """Origination plus (period - 1) months, always from the anchor so month-end days come back."""
    return F.add_months(col(origination), (col(period) - 1).cast("int"))


def monthly_rate(apr: Column | str) -> Column:
    return col(apr) / F.lit(100.0) / F.lit(12.0)


def instalment(principal: Column, r: Column, n: Column) -> Column:
    """Level instalment; straight-line when the rate is zero."""
    growth = F.pow(F.lit(1.0) + r, -n)
    return F.when(r == 0, principal / n).otherwise(principal * r / (F.lit(1.0) - growth))


def amortisation_schedule(loans: DataFrame) -> DataFrame:
    """One row per loan and instalment, from the closed-form balance (no running state).

    Only ``tenure_mo`` rows per loan are produced, straight from its own row: no shuffle.
    """
    r, n = F.col("_r"), F.col("tenure_mo").cast("double")
    k = F.col("period_index").cast("double")
    base = loans.select(
        "loan_id", "tenure_mo", F.col("ticket_size").cast("double").alias("_p"),
        monthly_rate("interest_rate_apr").alias("_r"),
    ).withColumn("emi", instalment(F.col("_p"), r, n))
    rows = base.withColumn("period_index", F.explode(F.sequence(F.lit(1), F.col("tenure_mo"))))

    def balance(j: Column) -> Column:
        g = F.pow(F.lit(1.0) + r, j)
        return F.when(r == 0, F.col("_p") - F.col("emi") * j).otherwise(
            F.col("_p") * g - F.col("emi") * (g - 1) / r
        )

    return rows.select(
        "loan_id", "period_index", "emi",
        (balance(k - 1) * r).alias("interest"),
        (F.col("emi") - balance(k - 1) * r).alias("principal"),
        balance(k).alias("closing_balance"),
    )
