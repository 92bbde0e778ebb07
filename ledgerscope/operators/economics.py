"""Per-loan value and the portfolio tables built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions import bands
from ledgerscope.functions.numeric import (
    clip, decimal, exact, half_even, mean, money, rate, ratio, total, value_map,
)
from ledgerscope.operators import panel, ranks
from ledgerscope.sources.scratch import settle

COMPONENTS = ["nii", "fee", "loss", "servicing", "cac_charged"]


def margin_before_cac() -> Column:
    return F.col("nii") + F.col("fee") - F.col("loss") - F.col("servicing")


def loan_outcomes(repayments: DataFrame, *more: Column) -> DataFrame:
    """One partial-then-final hash aggregate per loan; only fixed-width buffers."""
    return repayments.groupBy("loan_id").agg(
        F.sum("outstanding_balance").alias("_balance_sum"),
        F.count(F.lit(1)).alias("months_on_book"),
        F.max_by("outstanding_balance", "period_index").alias("last_balance"),
        F.max_by("dpd", "period_index").alias("last_dpd"),
        F.max("dpd").alias("worst_dpd"), *more,
    )


def value_proxy(loans: DataFrame, customers: DataFrame | None, repayments: DataFrame | None, outcomes: DataFrame | None = None) -> DataFrame:
    """Loans with default flag, months on book, the five components and their net value.

    The rate is constant per loan, so balances are summed first and multiplied once. Loans that
    already carry their customer's ``cac`` need no customers, and repayments already summed are given as ``outcomes``.
    """
    df = loans.join(loan_outcomes(repayments) if outcomes is None else outcomes, "loan_id", "left")
    if customers is not None:
        df = df.join(customers.select("customer_id", "cac"), "customer_id", "left")
    months = F.coalesce(F.col("months_on_book"), F.lit(0))
    spread = (F.col("interest_rate_apr") / 100.0 - P.COST_OF_FUNDS) / 12.0
    lost = (F.col("loan_status") == "Written-off") | F.coalesce(F.col("last_dpd") >= P.DEFAULT_DPD, F.lit(False))
    lgd = value_map("product_type", P.LGD)
    df = df.select(
        *[c for c in loans.columns if c != "cac"],
        months.cast("int").alias("months_on_book"),
        F.coalesce((F.col("worst_dpd") >= P.DEFAULT_DPD).cast("int"), F.lit(0)).alias("default_flag"),
        F.col("last_balance"), F.col("last_dpd"),
        exact(spread * F.coalesce(F.col("_balance_sum"), F.lit(0)).cast("double")).alias("nii"),
        exact(value_map("product_type", P.FEE_RATE) * F.col("ticket_size").cast("double")).alias("fee"),
        exact(
            F.when(lost, lgd * F.coalesce(F.col("last_balance"), F.lit(0)).cast("double")).otherwise(0.0)
        ).alias("loss"),
        decimal(P.SERVICING_PER_MONTH * months, 6).alias("servicing"),
        decimal(
            F.when(F.col("loan_sequence") == 1, F.coalesce(F.col("cac"), F.lit(0))).otherwise(0), 6
        ).alias("cac_charged"),
    )
    net = margin_before_cac() - F.col("cac_charged")
    return df.withColumn("value_proxy", money(net))


def reconcile_value(loans: DataFrame, components: DataFrame, tolerance: float = 1.0) -> DataFrame:
    recomputed = margin_before_cac() - F.col("cac_charged")
    joined = loans.select("loan_id", "value_proxy").join(components, "loan_id")
    return joined.agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.max(F.abs(F.col("value_proxy") - recomputed)).cast("double").alias("max_gap"),
    ).withColumn("reconciles", F.col("max_gap") <= tolerance)


def cac_once(loans: DataFrame, components: DataFrame) -> DataFrame:
    joined = loans.select("loan_id", "loan_sequence").join(components.select("loan_id", "cac_charged"), "loan_id")
    later = F.col("loan_sequence") > 1
    return joined.agg(
        F.count_if(later).alias("n_later_loans"),
        F.coalesce(total(F.when(later, F.abs("cac_charged"))), F.lit(0.0)).alias("cac_on_later"),
    ).withColumn("charged_once", F.col("cac_on_later") == 0)


def slice_metrics(loans: DataFrame, keys: list[str]) -> DataFrame:
    return loans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        half_even(rate(F.col("default_flag") == 1), 6).alias("default_rate"),
        half_even(mean("value_proxy"), 4).alias("mean_value"),
        total("value_proxy").alias("total_value"),
        half_even(mean("months_on_book"), 6).alias("mean_mob"),
        half_even(mean("tenure_mo"), 6).alias("mean_tenure"),
        half_even(mean("ticket_size"), 4).alias("mean_ticket"),
        half_even(mean("interest_rate_apr"), 6).alias("mean_apr"),
    )


def slice_report(loans: DataFrame, keys: list[str]) -> DataFrame:
    """Slice metrics with share of the book, maturity and a loss flag."""
    s = slice_metrics(loans, keys)
    book = Window.partitionBy()  # one row per slice: bounded by the band tables
    return s.withColumn("share", half_even(ratio(F.col("n"), F.sum("n").over(book)), 6)).withColumn(
        "maturity", half_even(ratio(F.col("mean_mob"), F.col("mean_tenure")), 6)
    ).withColumn("loss_making", (F.col("mean_value") < 0).cast("int"))


def ticket_bands_with_fallback(
    loans: DataFrame, table: dict | None = None, min_share: float = P.MIN_BAND_SHARE, basis: DataFrame | None = None
) -> DataFrame:
    """Adds ticket_band. A product whose documented bands hold a share under ``min_share`` gets its own thirds.

    Counts per product and band decide; the thirds are exact quantiles. Both are tables of a few rows.
    ``basis`` may name a cheaper frame with the same loans' product and ticket.
    """
    table = table or P.TICKET_BANDS
    basis = loans if basis is None else basis
    documented = loans.withColumn("_doc", bands.ticket_band(table=table))
    shares = basis.withColumn("_doc", bands.ticket_band(table=table)).groupBy("product_type", "_doc").agg(F.count(F.lit(1)).alias("_n"))
    widths = {p: len(labels) for p, (_, labels) in table.items()}
    degenerate = shares.groupBy("product_type").agg(
        F.min("_n").alias("_min"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_bands")
    ).select(
        "product_type",
        ((F.col("_bands") < value_map("product_type", widths)) | (F.col("_min") / F.col("_all") < min_share)).alias("_degenerate"),
    )
    thirds = ranks.quantiles(basis, F.col("ticket_size").cast("double"), [1 / 3, 2 / 3], ["product_type"])
    q1 = half_even("q0", 0)
    q2 = half_even("q1", 0)
    dim = degenerate.join(thirds, "product_type").select(
        "product_type", "_degenerate", q1.alias("_q1"), q2.alias("_q2")
    )
    t1, t2 = F.format_number("_q1", 0), F.format_number("_q2", 0)
    x = F.col("ticket_size").cast("double")
    own = (
        F.when(x <= F.col("_q1"), F.concat(F.lit("<"), t1))
        .when(x <= F.col("_q2"), F.concat(t1, F.lit("-"), t2))
        .otherwise(F.concat(F.lit(">"), t2))
    )
    # one row per product
    return documented.join(F.broadcast(dim), "product_type", "left").withColumn(
        "ticket_band", F.when(F.col("_degenerate"), own).otherwise(F.col("_doc"))
    ).drop("_doc", "_degenerate", "_q1", "_q2")


def first_hit(repayments: DataFrame, dpd: int, name: str) -> DataFrame:
    return repayments.groupBy("loan_id").agg(F.min(F.when(F.col("dpd") >= dpd, F.col("period_index"))).alias(name))


def equal_mob_default(loans: DataFrame, repayments: DataFrame, k: int = P.MATURE_MOB, min_tenure: int = 12) -> DataFrame:
    """Default by month k among loans watched at least k months, for longer Personal and SME loans."""
    l = loans.filter(F.col("product_type").isin("Personal", "SME") & (F.col("tenure_mo") > min_tenure))
    joined = l.join(first_hit(repayments, P.DEFAULT_DPD, "mob_at_default"), "loan_id", "left")
    watched = F.col("months_on_book") >= k
    hit = F.coalesce(F.col("mob_at_default") <= k, F.lit(False))
    return joined.withColumn("bucket", bands.tenure_band()).groupBy("product_type", "bucket").agg(
        half_even(100 * rate(F.col("default_flag") == 1), 4).alias("raw_default"),
        half_even(100 * ratio(F.count_if(watched & hit), F.count_if(watched)), 4).alias("default_at_k"),
        F.count_if(watched).alias("n_watched"),
    )


def vintage(loans: DataFrame, repayments: DataFrame, k: int = 3) -> DataFrame:
    joined = loans.join(first_hit(repayments, 30, "mob30"), "loan_id", "left")
    watched = F.col("months_on_book") >= k
    early = F.coalesce(F.col("mob30") <= k, F.lit(False))
    return joined.groupBy(F.col("origination_cohort").alias("cohort")).agg(
        F.count(F.lit(1)).alias("n"),
        half_even(100 * rate(F.col("default_flag") == 1), 4).alias("raw_default"),
        half_even(100 * ratio(F.count_if(watched & early), F.count_if(watched)), 4).alias("early30"),
        F.count_if(watched).alias("n_observed"),
        half_even(100 * rate(F.col("origination_risk_grade").isin("D", "E")), 4).alias("grade_de"),
    )


def roll_rate(repayments: DataFrame) -> DataFrame:
    """5 x 5 month-to-month transition matrix in percent, every bucket present in both directions."""
    spark = repayments.sparkSession
    pairs = panel.neighbour(repayments, "loan_id", "period_index", "delinquency_bucket", "next_bucket")
    counts = (
        pairs.filter(F.col("next_bucket").isNotNull())
        .groupBy("delinquency_bucket").pivot("next_bucket", P.BUCKETS).count().fillna(0)
    )
    rows = spark.createDataFrame([(b,) for b in P.BUCKETS], "delinquency_bucket string")
    row_sum = sum((F.col(f"`{b}`") for b in P.BUCKETS[1:]), F.col(f"`{P.BUCKETS[0]}`"))
    return rows.join(counts, "delinquency_bucket", "left").select(
        F.col("delinquency_bucket").alias("from_bucket"),
        *[half_even(100 * ratio(F.col(f"`{b}`"), row_sum), 6).alias(f"to_{i}") for i, b in enumerate(P.BUCKETS)],
    )


def cure_chance(matrix: DataFrame) -> DataFrame:
    """Chance of moving to a better bucket next month, per delinquent bucket."""
    out = None
    for i, b in enumerate(P.BUCKETS[1:], start=1):
        better = sum((F.col(f"to_{j}") for j in range(1, i)), F.col("to_0"))
        out = F.when(F.col("from_bucket") == b, better) if out is None else out.when(F.col("from_bucket") == b, better)
    return matrix.filter(F.col("from_bucket") != "Current").select(
        "from_bucket", half_even(out, 4).alias("cure_pct")
    )


def time_to_first_delinquency(repayments: DataFrame) -> DataFrame:
    first = repayments.filter(F.col("dpd") > 0).groupBy("loan_id").agg(F.min("period_index").alias("period_index"))
    stats = first.agg(F.count(F.lit(1)).alias("n_loans"), half_even(mean("period_index"), 4).alias("mean_periods"))
    median = ranks.quantiles(first, F.col("period_index").cast("double"), [0.5])
    return stats.withColumn("median_periods", median.select(half_even("q0", 0)).scalar())


def last_state(repayments: DataFrame) -> DataFrame:
    return repayments.groupBy("loan_id").agg(
        F.max_by("outstanding_balance", "period_index").alias("outstanding_balance"),
        F.max_by("dpd", "period_index").alias("dpd"),
    ).withColumn("delinquency_bucket", bands.dpd_bucket("dpd"))


def portfolio_overview(loans: DataFrame, customers: DataFrame, repayments: DataFrame) -> DataFrame:
    joined = loans.select(
        "loan_id", "customer_id", "loan_status", "ticket_size", "value_proxy", "default_flag",
        "interest_rate_apr", "tenure_mo",
    ).join(last_state(repayments), "loan_id", "left")
    active = F.col("loan_status") == "Active"
    late = F.coalesce(F.col("delinquency_bucket") != "Current", F.lit(True))
    ticket = F.col("ticket_size")
    book = joined.agg(
        F.count(F.lit(1)).alias("n_loans"),
        half_even(total(ticket) / P.CRORE, 4).alias("originated_cr"),
        half_even(total(F.when(active, F.col("outstanding_balance"))) / P.CRORE, 4).alias("outstanding_cr"),
        half_even(total("value_proxy") / P.CRORE, 4).alias("profit_cr"),
        half_even(100 * rate(F.col("default_flag") == 1), 4).alias("ever90_pct"),
        half_even(100 * ratio(F.count_if(active & late), F.count_if(active)), 4).alias("current_delinquent_pct"),
        half_even(
            100 * ratio(F.count_if(active & (F.col("delinquency_bucket") == "90+")), F.count_if(active)), 4
        ).alias("current_90_pct"),
        half_even(weighted_mean("interest_rate_apr", ticket), 4).alias("wa_apr"),
        half_even(weighted_mean("tenure_mo", ticket), 4).alias("wa_tenure"),
        half_even(mean(ticket), 4).alias("mean_ticket"),
    )
    # distinct customers by a two-step count, so no task holds the set of ids
    people = loans.groupBy("customer_id").agg(F.lit(1).alias("_")).agg(F.count(F.lit(1)).alias("n_customers"))
    return book.withColumn("n_customers", people.scalar())


def weighted_mean(x: str, w: Column) -> Column:
    return ratio(F.sum(w * decimal(x, 2)), F.sum(w))


def concentration(loans: DataFrame) -> DataFrame:
    """Products with their share of loans, exposure and profit, and a TOTAL row from one rollup."""
    rolled = loans.rollup("product_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ticket_size").alias("_expo"), F.sum("value_proxy").alias("_profit")
    ).withColumn("product", F.coalesce(F.col("product_type"), F.lit("TOTAL")))
    book = Window.partitionBy()  # four rows

    def share(c: str) -> Column:
        grand = F.max(F.when(F.col("product") == "TOTAL", F.col(c))).over(book)
        return half_even(100 * ratio(F.col(c), grand.cast("double")), 4)

    return rolled.select(
        "product", "n", F.col("_expo").cast("double").alias("exposure"), F.col("_profit").cast("double").alias("profit"),
        share("n").alias("pct_loans"), share("_expo").alias("pct_exposure"), share("_profit").alias("pct_profit"),
    )


def crossover(loans: DataFrame, customers: DataFrame) -> DataFrame:
    """Product x channel: mean value, count, default and total, one column per channel and measure."""
    joined = loans.join(customers.select("customer_id", "acquisition_channel"), "customer_id", "left")
    cells = joined.groupBy("product_type").pivot("acquisition_channel", P.CHANNELS).agg(
        half_even(mean("value_proxy"), 4).alias("mean"), F.count(F.lit(1)).alias("n"),
        half_even(rate(F.col("default_flag") == 1), 6).alias("default"), total("value_proxy").alias("total"),
    )
    names = []
    for i, ch in enumerate(P.CHANNELS):
        for m in ("mean", "n", "default", "total"):
            names.append(F.col(f"`{ch}_{m}`").alias(f"c{i}_{m}"))
    return cells.select("product_type", *names)


def channel_drag(loans: DataFrame, customers: DataFrame, product: str = "BNPL") -> DataFrame:
    joined = loans.filter(F.col("product_type") == product).join(
        customers.select("customer_id", "acquisition_channel"), "customer_id", "left"
    )
    by = joined.groupBy("acquisition_channel").agg(
        F.count(F.lit(1)).alias("n"), half_even(mean("value_proxy"), 4).alias("mean_value"),
        total("value_proxy").alias("total_value"), half_even(rate(F.col("default_flag") == 1), 6).alias("default_rate"),
    )
    book = Window.partitionBy()  # one row per channel
    return by.withColumn(
        "pct_of_drag", half_even(100 * ratio(F.col("total_value"), F.sum(decimal("total_value")).over(book)), 4)
    ).orderBy("total_value", "acquisition_channel")


def channel_economics(loans: DataFrame, customers: DataFrame, cac: str = "cac") -> DataFrame:
    """Loan count, CAC, default, profit mean / median / skew, payback and value-to-CAC per channel.

    ``cac`` is the customer's full CAC on every loan; pass ``cac_charged`` to count it once.
    """
    df = loans.join(customers.select("customer_id", "acquisition_channel", "cac"), "customer_id")
    margin = margin_before_cac().cast("double")
    monthly = margin / clip(F.col("months_on_book").cast("double"), low=1.0)
    # written once and narrow: the means and both medians read it
    df = settle(df.select(
        "acquisition_channel", F.col(cac).alias("_cac"), "default_flag", "value_proxy", margin_before_cac().alias("_margin"),
        half_even(F.col(cac).cast("double") / clip(monthly, low=1.0), 6).alias("_payback"),
    ))
    key = ["acquisition_channel"]
    base = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("loans"), half_even(mean("_cac"), 2).alias("avg_cac"),
        half_even(rate(F.col("default_flag") == 1), 6).alias("default_rate"),
        half_even(mean("value_proxy"), 2).alias("avg_profit"),
        half_even(ratio(F.sum("_margin").cast("double"), F.sum("_cac")), 6).alias("clv_cac"),
    )
    both = df.select(*key, F.explode(F.array(
        F.struct(F.lit("profit").alias("m"), F.col("value_proxy").cast("double").alias("x")),
        F.struct(F.lit("payback").alias("m"), F.col("_payback").alias("x")),
    )).alias("s")).select(*key, "s.*")
    medians = ranks.quantiles(both, F.col("x"), [0.5], [*key, "m"])
    profit = medians.filter(F.col("m") == "profit").drop("m")
    payback = medians.filter(F.col("m") == "payback").drop("m")
    out = base.join(profit.withColumnRenamed("q0", "_mp"), key).join(payback.withColumnRenamed("q0", "_pb"), key)
    median = half_even("_mp", 2)
    return out.select(
        *key, "loans", "avg_cac", "default_rate", "avg_profit", median.alias("median_profit"),
        half_even(100 * ratio(F.col("avg_profit") - median, median), 4).alias("skew_pct"),
        half_even("_pb", 4).alias("payback_mo"), "clv_cac",
    ).orderBy(F.desc("avg_profit"), "acquisition_channel")
