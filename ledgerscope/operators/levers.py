"""Policy levers under stress. The book is summed once per lever; every grid runs on those few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions import bands
from ledgerscope.functions.numeric import half_even, mean, rate, ratio, total, value_map

LEVERS = ["L1", "L2", "L4", "L5"]
LEVER_PRODUCT = {"L1": "BNPL", "L2": "Personal", "L4": "SME", "L5": "SME"}


def base_set(lever: str) -> Column:
    """The loans a lever looks at, before any cash-flow cutoff."""
    product = F.col("product_type") == LEVER_PRODUCT[lever]
    grade = F.col("origination_risk_grade")
    return {
        "L1": product & F.col("acquisition_channel").isin(*P.LEVER_CHANNELS),
        "L2": product & grade.isin("D", "E"),
        "L4": product & grade.isin("A", "B"),
        "L5": product & grade.isin("C", "D", "E"),
    }[lever]


def targets(lever: str, l2: float = P.L2_CUTOFF, l5: float = P.L5_CUTOFF) -> Column:
    cutoff = {"L2": l2, "L5": l5}.get(lever)
    if cutoff is None:
        return base_set(lever)
    return base_set(lever) & F.coalesce(F.col("cashflow_consistency_mean") < F.lit(cutoff), F.lit(False))


def lever_sums(frame: DataFrame) -> DataFrame:
    """Count, value and ticket per lever from one scan; a loan may count towards several levers."""
    one = frame.agg(*[
        c for lever in LEVERS for c in (
            F.count_if(targets(lever)).alias(f"{lever}_n"),
            F.coalesce(total(F.when(targets(lever), F.col("value_proxy"))), F.lit(0.0)).alias(f"{lever}_v"),
            F.coalesce(total(F.when(targets(lever), F.col("ticket_size"))), F.lit(0.0)).alias(f"{lever}_t"),
        )
    ])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(lever).alias("lever"), F.col(f"{lever}_n").alias("n"), F.col(f"{lever}_v").alias("value"),
                 F.col(f"{lever}_t").alias("ticket")) for lever in LEVERS
    ])).alias("s")).select("s.*")


def cease_net(value: Column, ticket: Column, lgd: Column, pp: Column) -> Column:
    """Net gain in crore of not having the loans: their value, plus stress losses avoided."""
    return (-value + ticket * lgd * pp / 100.0) / P.CRORE


def new_loans(n: Column, growth_pct: Column) -> Column:
    return half_even(n * growth_pct / 100.0, 0)


def grow_net(n: Column, value: Column, ticket: Column, lgd: Column, pp: Column, growth_pct: Column) -> Column:
    """Net gain in crore of adding loans like the average one, minus their stress losses."""
    added = new_loans(n, growth_pct)
    return (added * ratio(value, n) - added * ratio(ticket, n) * lgd * pp / 100.0) / P.CRORE


def lever_net(pp: Column, lgd_shift: Column | None = None, growth: Column | None = None) -> Column:
    growth = F.lit(float(P.GROWTH_PCT)) if growth is None else growth
    lgd = value_map("lever", {l: P.LGD[p] for l, p in LEVER_PRODUCT.items()})
    if lgd_shift is not None:
        lgd = lgd + lgd_shift
    v, t, n = F.col("value"), F.col("ticket"), F.col("n").cast("double")
    return F.when(F.col("lever") == "L4", grow_net(n, v, t, lgd, pp, growth)).otherwise(cease_net(v, t, lgd, pp))


def volume_change() -> Column:
    n = F.col("n").cast("double")
    added = new_loans(n, F.lit(float(P.GROWTH_PCT))) * ratio(F.col("ticket"), n)
    return F.when(F.col("lever") == "L4", F.coalesce(added, F.lit(0.0))).otherwise(-F.col("ticket")) / P.CRORE


def over(sums: DataFrame, grid: list[tuple], schema: str) -> DataFrame:
    """Every lever with every grid point: the grid travels inside each lever's row."""
    names = [c.split()[0] for c in schema.split(", ")]
    points = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in grid])
    return sums.withColumn("_g", F.explode(points)).select("*", "_g.*").drop("_g")


def scenario_table(frame: DataFrame) -> DataFrame:
    """Levers under 0 / 2 / 3 pp stress, and the combined rows from a rollup over the levers."""
    grid = over(lever_sums(frame), [(m, float(pp)) for m, pp in P.STRESS_LEVELS], "macro string, pp double")
    per = grid.select("lever", "macro", volume_change().alias("vol"), lever_net(F.col("pp")).alias("net"))
    rolled = per.groupingSets(
        [[F.col("macro"), F.col("lever")], [F.col("macro")]], F.col("macro"), F.col("lever")
    ).agg(F.sum("vol").alias("vol"), F.sum("net").alias("net"))
    return rolled.select(
        F.coalesce(value_map("lever", P.LEVER_NAMES), F.lit(P.COMBINED_NAME)).alias("scenario"), "macro",
        half_even("vol", 2).alias("volume_delta_cr"), half_even("net", 2).alias("net_delta_cr"),
    )


def wide(per: DataFrame, key: str) -> DataFrame:
    cols = [F.sum(F.when(F.col("lever") == l, F.col("net"))) for l in LEVERS]
    return per.groupBy(key).agg(
        *[half_even(c, 2).alias(l) for c, l in zip(cols, LEVERS)], half_even(F.sum("net"), 2).alias("combined")
    )


def extended_stress(frame: DataFrame) -> DataFrame:
    grid = over(lever_sums(frame), [(float(s),) for s in P.EXTENDED_STRESS], "stress_pp double")
    return wide(grid.select("lever", "stress_pp", lever_net(F.col("stress_pp")).alias("net")), "stress_pp")


def lgd_sensitivity(frame: DataFrame, pp: float = 3.0) -> DataFrame:
    grid = over(lever_sums(frame), P.LGD_FLEX, "scenario string, shift double")
    net = lever_net(F.lit(pp), F.col("shift"))
    return wide(grid.select("lever", "scenario", net.alias("net")), "scenario")


def cutoff_sensitivity(frame: DataFrame) -> DataFrame:
    """Cash-flow cutoffs for L2 and L5: all cutoffs are conditional sums of the same scan."""
    x = F.col("cashflow_consistency_mean")
    aggs = []
    for i, c in enumerate(P.CUTOFFS):
        for lever in ("L2", "L5"):
            hit = base_set(lever) & F.coalesce(x < F.lit(c), F.lit(False))
            aggs += [F.count_if(hit).alias(f"{lever}_n{i}"),
                     F.coalesce(total(F.when(hit, F.col("value_proxy"))), F.lit(0.0)).alias(f"{lever}_v{i}"),
                     F.coalesce(total(F.when(hit, F.col("ticket_size"))), F.lit(0.0)).alias(f"{lever}_t{i}")]
    one = frame.filter(base_set("L2") | base_set("L5")).agg(*aggs)

    def fields(i: int, c: float) -> Column:
        out = [F.lit(c).alias("cutoff")]
        for lever in ("L2", "L5"):
            lgd = F.lit(P.LGD[LEVER_PRODUCT[lever]])
            v, t = F.col(f"{lever}_v{i}"), F.col(f"{lever}_t{i}")
            out += [F.col(f"{lever}_n{i}").alias(f"{lever}_loans"),
                    half_even(cease_net(v, t, lgd, F.lit(0.0)), 2).alias(f"{lever}_base"),
                    half_even(cease_net(v, t, lgd, F.lit(3.0)), 2).alias(f"{lever}_3pp")]
        return F.struct(*out)

    return one.select(F.explode(F.array(*[fields(i, c) for i, c in enumerate(P.CUTOFFS)])).alias("s")).select("s.*")


def growth_sensitivity(frame: DataFrame) -> DataFrame:
    grid = over(lever_sums(frame).filter(F.col("lever") == "L4"), [(float(g),) for g in P.GROWTH_RATES], "growth_pct double")
    n = F.col("n").cast("double")
    base, stressed = lever_net(F.lit(0.0), growth=F.col("growth_pct")), lever_net(F.lit(3.0), growth=F.col("growth_pct"))
    added = new_loans(n, F.col("growth_pct"))
    return grid.select(
        "growth_pct", added.cast("long").alias("new_loans"),
        half_even(added * ratio(F.col("ticket"), n) / P.CRORE, 2).alias("origination_cr"),
        half_even(base, 2).alias("baseline_cr"), half_even(stressed, 2).alias("stress_3pp_cr"),
        half_even(stressed - base, 2).alias("delta_cr"),
    )


def break_points(frame: DataFrame) -> DataFrame:
    """Stress in pp at which a lever's net gain is zero (null where it never falls)."""
    base, slope = lever_net(F.lit(0.0)), lever_net(F.lit(1.0)) - lever_net(F.lit(0.0))
    return lever_sums(frame).select(
        "lever", half_even(base, 4).alias("base_cr"), half_even(slope, 6).alias("slope_cr_per_pp"),
        half_even(F.when(slope < 0, -base / slope), 2).alias("break_pp"),
    )


def band_view(frame: DataFrame, lever: str) -> DataFrame:
    """The lever's loans by cash-flow band."""
    return frame.filter(base_set(lever)).withColumn("band", bands.cashflow_band("cashflow_consistency_mean")).filter(
        F.col("band").isNotNull()
    ).groupBy("band").agg(
        F.count(F.lit(1)).alias("n_loans"), half_even(mean("value_proxy"), 2).alias("mean_value"),
        half_even(total("value_proxy") / P.CRORE, 4).alias("total_cr"),
        half_even(100 * rate(F.col("default_flag") == 1), 4).alias("default_rate_pct"),
    )


def channel_view(frame: DataFrame, product: str = "BNPL") -> DataFrame:
    """Channels within a product, the worst mean value first."""
    return frame.filter(F.col("product_type") == product).groupBy("acquisition_channel").agg(
        F.count(F.lit(1)).alias("n_loans"), half_even(mean("value_proxy"), 2).alias("mean_value"),
        half_even(total("value_proxy") / P.CRORE, 4).alias("total_cr"),
        half_even(100 * rate(F.col("default_flag") == 1), 4).alias("default_rate_pct"),
    ).orderBy("mean_value", "acquisition_channel")


def reconcile_segments(recomputed: DataFrame, published: DataFrame) -> DataFrame:
    """Old and new totals per segment side by side, with their difference."""
    return recomputed.join(published, "segment", "left").select(
        "segment", "recomputed_cr", "published_cr",
        half_even(F.col("recomputed_cr") - F.col("published_cr"), 4).alias("diff"),
    )


def lever_profile(frame: DataFrame) -> DataFrame:
    """Size, mean and total value and loss-making share of each lever's targets, in one scan."""
    hit = F.filter(F.array(*[F.when(targets(l), F.lit(l)) for l in LEVERS]), lambda x: x.isNotNull())
    return frame.select("value_proxy", F.explode(hit).alias("lever")).groupBy("lever").agg(
        F.count(F.lit(1)).alias("n"), half_even(mean("value_proxy"), 2).alias("mean_value"),
        total("value_proxy").alias("total_value"),
        half_even(100 * rate(F.col("value_proxy") < 0), 4).alias("pct_loss_making"),
    )
