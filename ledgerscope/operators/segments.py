"""Segment metrics, comparison of segmentations, profiles, and agreement measures."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions import bands
from ledgerscope.functions.numeric import half_even, mean, rate, ratio, total


def segment_metrics(loans: DataFrame, seg: str = "segment") -> DataFrame:
    """Default on seasoned loans, value on all loans, shares of the book."""
    seasoned = F.col("months_on_book") >= P.SEASONED_MOB
    book = Window.partitionBy()  # one row per segment
    by = loans.groupBy(seg).agg(
        F.count(F.lit(1)).alias("n_loans"), F.count_if(seasoned).alias("n_seasoned"),
        F.sum("ticket_size").alias("_orig"),
        half_even(100 * ratio(F.count_if(seasoned & (F.col("default_flag") == 1)), F.count_if(seasoned)), 4).alias("default_rate_pct"),
        half_even(mean("ticket_size"), 2).alias("mean_ticket"), half_even(mean("interest_rate_apr"), 4).alias("mean_apr_pct"),
        half_even(mean("value_proxy"), 2).alias("mean_value"), total("value_proxy").alias("total_value"),
        half_even(100 * rate(F.col("value_proxy") < 0), 4).alias("pct_loss_making"),
    )
    people = loans.groupBy(seg, "customer_id").agg(F.lit(1).alias("_")).groupBy(seg).agg(F.count(F.lit(1)).alias("n_customers"))
    return by.join(people, seg).select(
        F.col(seg).alias("segment"), "n_loans", "n_seasoned", "n_customers",
        half_even(100 * ratio(F.col("n_loans"), F.sum("n_loans").over(book)), 4).alias("pct_of_book"),
        half_even(F.col("_orig").cast("double") / P.CRORE, 4).alias("total_originated_cr"),
        half_even(100 * ratio(F.col("_orig"), F.sum("_orig").over(book)), 4).alias("pct_of_orig"),
        "default_rate_pct", "mean_ticket", "mean_apr_pct", "mean_value", "total_value", "pct_loss_making",
    )


def hybrid_metrics(loans: DataFrame) -> DataFrame:
    """Seven segments, every rate and mean on seasoned loans; sizes on the whole book."""
    seasoned = F.col("months_on_book") >= P.SEASONED_MOB
    v = F.when(seasoned, F.col("value_proxy"))
    book = Window.partitionBy()  # one row per segment
    return loans.withColumn("segment", bands.hybrid_segment()).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_loans_total"),
        half_even(100 * ratio(F.count_if(seasoned & (F.col("default_flag") == 1)), F.count_if(seasoned)), 4).alias("default_rate_pct"),
        half_even(mean(v), 2).alias("mean_value"),
        half_even(100 * ratio(F.count_if(v < 0), F.count(v)), 4).alias("pct_loss_making"),
    ).withColumn("pct_of_book", half_even(100 * ratio(F.col("n_loans_total"), F.sum("n_loans_total").over(book)), 4))


def with_posture(metrics: DataFrame, limits=P.POSTURE_SEASONED, risk="default_rate_pct", value="mean_value") -> DataFrame:
    return metrics.withColumn("posture", bands.posture(risk, value, limits))


def method_cells(loans: DataFrame, methods: dict[str, Column]) -> DataFrame:
    """Sums per (method, segment): one scan for all segmentations, folded before the shuffle."""
    seasoned = F.col("months_on_book") >= P.SEASONED_MOB
    v = F.col("value_proxy")
    tagged = loans.select(
        "months_on_book", "default_flag", "value_proxy",
        F.explode(F.array(*[F.struct(F.lit(m).alias("method"), s.alias("segment")) for m, s in methods.items()])).alias("_a"),
    ).select("_a.*", "months_on_book", "default_flag", "value_proxy")
    return tagged.groupBy("method", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(seasoned).alias("ns"),
        F.count_if(seasoned & (F.col("default_flag") == 1)).alias("bad"),
        F.sum(v).cast("double").alias("sv"), F.sum((v * v).cast("decimal(38,4)")).cast("double").alias("svv"),
        F.count_if(v < 0).alias("losing"),
    )


def method_comparison(cells: DataFrame) -> DataFrame:
    book = Window.partitionBy("method")  # one row per segment
    return cells.select(
        "method", "segment", F.col("n").alias("n_loans"),
        half_even(100 * ratio(F.col("n"), F.sum("n").over(book)), 4).alias("pct_of_book"),
        half_even(100 * ratio(F.col("bad"), F.col("ns")), 4).alias("default_rate_pct"),
        half_even(ratio(F.col("sv"), F.col("n")), 2).alias("mean_value"),
        half_even(F.col("sv") / P.CRORE, 4).alias("total_value_cr"),
        half_even(100 * ratio(F.col("losing"), F.col("n")), 4).alias("pct_loss_making"),
    )


def eta_squared(n: str, s: str, ss: str) -> Column:
    """Between-group over total sum of squares, aggregated from group counts, sums and squares."""
    grand = F.sum(s) * F.sum(s) / F.sum(n)
    between = F.sum(F.when(F.col(n) > 0, F.col(s) * F.col(s) / F.col(n))) - grand
    within_total = F.sum(ss) - grand
    return half_even(between / F.when(within_total > 0, within_total), 4)


def near_duplicates(metrics: DataFrame) -> DataFrame:
    """Pairs of a method's segments alike in both risk and value. The input is one row per segment."""
    a, b = metrics.alias("a"), metrics.alias("b")
    alike = (
        (F.col("a.method") == F.col("b.method"))
        & (F.col("a.segment") < F.col("b.segment"))
        & (F.abs(F.col("a.default_rate_pct") - F.col("b.default_rate_pct")) < P.NEAR_DEFAULT_PP)
        & (F.abs(F.col("a.mean_value") - F.col("b.mean_value")) < P.NEAR_VALUE)
    )
    return a.join(b, alike).select(
        "a.method", F.col("a.segment").alias("segment_a"), F.col("b.segment").alias("segment_b")
    )


def method_scorecard(cells: DataFrame) -> DataFrame:
    """One row per segmentation: separation in risk and value, spreads, near-duplicates."""
    eta = cells.groupBy("method").agg(
        eta_squared("ns", "bad", "bad").alias("risk_eta2"), eta_squared("n", "sv", "svv").alias("value_eta2")
    )
    metrics = method_comparison(cells)
    spread = metrics.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_segments"),
        half_even(F.max("default_rate_pct") - F.min("default_rate_pct"), 4).alias("risk_spread_pp"),
        half_even(F.max("mean_value") - F.min("mean_value"), 2).alias("value_spread"),
    )
    pairs = near_duplicates(metrics).groupBy("method").agg(F.count(F.lit(1)).alias("_pairs"))
    return spread.join(eta, "method").join(pairs, "method", "left").withColumn(
        "near_duplicate_pairs", F.coalesce(F.col("_pairs"), F.lit(0))
    ).drop("_pairs").withColumn("effective_segments", F.col("n_segments") - F.col("near_duplicate_pairs"))


def adjusted_rand_index(assigned: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two assignments from their contingency table."""
    cells = assigned.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2.0

    inner = cells.agg(F.sum(pairs(F.col("n"))).alias("x"), F.sum("n").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))))
    t = inner.select("x", pairs(F.col("n")).alias("all"), rows.scalar().alias("r"), cols.scalar().alias("c"))
    expected = F.col("r") * F.col("c") / F.col("all")
    top = (F.col("r") + F.col("c")) / 2.0
    return t.select(half_even(F.when(top != expected, (F.col("x") - expected) / (top - expected)).otherwise(1.0), 6).alias("ari"))


def adjusted_rand_by(assigned: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """The same for many pairs of assignments, one per value of ``by``, from one contingency table."""
    cells = assigned.groupBy(by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))

    def pairs(n: str) -> Column:
        return F.sum(F.col(n) * (F.col(n) - 1) / 2.0)

    t = cells.groupBy(by).agg(pairs("n").alias("x"), F.sum("n").alias("n"))
    for side in ("a", "b"):
        t = t.join(cells.groupBy(by, side).agg(F.sum("n").alias("s")).groupBy(by).agg(pairs("s").alias(f"{side}_pairs")), by)
    expected = F.col("a_pairs") * F.col("b_pairs") / (F.col("n") * (F.col("n") - 1) / 2.0)
    top = (F.col("a_pairs") + F.col("b_pairs")) / 2.0
    return t.select(by, half_even(F.when(top != expected, (F.col("x") - expected) / (top - expected)).otherwise(1.0), 6).alias("ari"))


def top_category(df: DataFrame, group: str, column: str) -> DataFrame:
    """Most common value and its share per group; ties go to the smaller value."""
    counts = df.groupBy(group, F.col(column).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(group).agg(
        F.sum("_n").alias("_all"), F.max("_n").alias("_top")
    ).join(counts, group).filter(F.col("_n") == F.col("_top")).groupBy(group).agg(
        F.min("_v").alias(f"top_{column}"), half_even(100 * ratio(F.max("_top"), F.max("_all")), 4).alias(f"top_{column}_pct")
    )


def cluster_profile(customers: DataFrame, loans: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, dominant categories, behaviour, default and value per cluster."""
    seasoned = F.col("months_on_book") >= P.SEASONED_MOB
    book = Window.partitionBy()  # one row per cluster
    people = customers.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_customers"), half_even(mean("age"), 4).alias("mean_age"),
        half_even(mean("cashflow_consistency_mean", 6), 4).alias("mean_cashflow"),
        half_even(mean("credit_utilisation_mean", 6), 4).alias("mean_utilisation"),
        half_even(mean("spending_shock_rate", 6), 4).alias("mean_shock_rate"),
        half_even(100 * rate(F.col("any_default") == 1), 4).alias("customer_default_pct"),
        half_even(mean("clv"), 2).alias("mean_clv"),
    )
    theirs = loans.join(customers.select("customer_id", cluster), "customer_id").groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_loans"),
        half_even(100 * ratio(F.count_if(seasoned & (F.col("default_flag") == 1)), F.count_if(seasoned)), 4).alias("loan_default_pct"),
        half_even(mean("value_proxy"), 2).alias("mean_value"), total("value_proxy").alias("total_value"),
        half_even(100 * rate(F.col("value_proxy") < 0), 4).alias("pct_loss_making"),
    )
    out = people.join(theirs, cluster, "left")
    for c in ("region_type", "income_proxy_band", "employment_type", "primary_product"):
        out = out.join(top_category(customers, cluster, c), cluster, "left")
    return out.withColumn("pct_customers", half_even(100 * ratio(F.col("n_customers"), F.sum("n_customers").over(book)), 4))


def relabel_by_risk(loans: DataFrame, seg: str, prefix: str) -> DataFrame:
    """Segments renamed prefix1..prefixN from the safest to the riskiest (seasoned default)."""
    seasoned = F.col("months_on_book") >= P.SEASONED_MOB
    risk = loans.groupBy(seg).agg(ratio(F.count_if(seasoned & (F.col("default_flag") == 1)), F.count_if(seasoned)).alias("_risk"))
    order = Window.orderBy(F.col("_risk"), F.col(seg))  # one row per segment
    names = risk.select(seg, F.concat(F.lit(prefix), F.row_number().over(order).cast("string")).alias("label"))
    return loans.join(F.broadcast(names), seg)  # one row per segment


def poisson_draw(n: pd.Series, u: pd.Series) -> pd.Series:
    """Poisson(n) quantile at u, for any mean: probabilities from the mode outwards, summed once per distinct mean."""
    import numpy as np

    lam, p = n.to_numpy(float), u.to_numpy(float)
    out = np.zeros(len(lam), np.int64)
    for mean in np.unique(lam[lam > 0]):
        reach = 12 * math.sqrt(mean) + 30  # what lies beyond is below 1e-30
        k = np.arange(max(0, math.floor(mean - reach)), math.ceil(mean + reach) + 1)
        log = np.concatenate([[0.0], np.cumsum(np.log(mean / k[1:]))])
        mass = np.exp(log - log.max())
        at = lam == mean
        out[at] = k[np.minimum(np.searchsorted(np.cumsum(mass) / mass.sum(), p[at]), len(k) - 1)]
    return pd.Series(out)


def resampled_cells(cells: DataFrame, keys: list[str], n: str, replicates: int, seed: int) -> DataFrame:
    """Bootstrap weights per cell and replicate.

    Drawing every row with a Poisson(1) weight gives a cell of n equal rows a Poisson(n) total, so
    the draw is made per cell: rows never multiply by the number of replicates.
    """
    draw = F.pandas_udf(poisson_draw, "long")
    reps = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    h = F.xxhash64(F.lit(seed), F.col("replicate"), *[F.col(k) for k in keys])
    u = (F.pmod(h, F.lit(2**40)).cast("double") + 0.5) / float(2**40)
    return reps.withColumn("weight", draw(F.col(n).cast("double"), u))


def bootstrap_cv(loans: DataFrame, seg: Column, replicates: int = 200, seed: int = 20260603) -> DataFrame:
    """Variation of each segment's seasoned default rate over bootstrap replicates."""
    cells = loans.filter(F.col("months_on_book") >= P.SEASONED_MOB).groupBy(seg.alias("segment"), "default_flag").agg(
        F.count(F.lit(1)).alias("n")
    )
    drawn = resampled_cells(cells, ["segment", "default_flag"], "n", replicates, seed)
    rates = drawn.groupBy("segment", "replicate").agg(
        ratio(F.sum(F.col("weight") * F.col("default_flag")), F.sum("weight")).alias("r")
    )
    return rates.groupBy("segment").agg(
        F.count("r").alias("replicates"), half_even(F.avg("r"), 6).alias("mean_rate"),
        half_even(F.stddev_pop("r") / F.when(F.avg("r") > 0, F.avg("r")), 6).alias("cv"),
    )
