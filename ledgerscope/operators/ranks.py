"""Positions in a global order, and what follows from them: quantiles, AUC, KS, deciles.

Rows are first summed per distinct value. The distinct values are cut into value ranges holding at
most about ``VALUES_PER_TASK`` each, running sums are taken inside a range, and the totals of the
earlier ranges are added. No task ever sees more than one range, and nothing is approximated: the
range borders only decide where a value is counted. Quantiles need no such order: they are selected inside brackets.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.numeric import col, half_even, ratio
from ledgerscope.sources.scratch import settle

VALUES_PER_TASK = 500_000
MAX_RANGES = 20_000


def positions(
    df: DataFrame, value: Column, groups: list[str] | None = None,
    weights: dict[str, Column] | None = None, values_per_task: int | None = None,
) -> DataFrame:
    """Per (group, value): each weight's sum, the sum over smaller values, and the group's total.

    Columns: groups, ``value``, and for every weight w: w, w_before, w_all.
    """
    groups = groups or []
    weights = weights or {"n": F.lit(1)}
    per_task = values_per_task or VALUES_PER_TASK
    by_value = settle(
        df.select(*groups, value.cast("double").alias("value"), *[c.alias(n) for n, c in weights.items()])
        .filter(F.col("value").isNotNull())
        .groupBy(*groups, "value").agg(*[F.sum(n).alias(n) for n in weights])
    )
    n_ranges = min(MAX_RANGES, math.ceil(by_value.count() / per_task))
    earlier_values = Window.partitionBy(*groups).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    if n_ranges <= 1:
        whole = Window.partitionBy(*groups)
        return by_value.select(
            *groups, "value", *weights,
            *[F.coalesce(F.sum(n).over(earlier_values), F.lit(0)).alias(f"{n}_before") for n in weights],
            *[F.sum(n).over(whole).alias(f"{n}_all") for n in weights],
        )
    probs = [i / n_ranges for i in range(1, n_ranges)]
    borders = by_value.agg(F.percentile_approx("value", probs, 10 * n_ranges).alias("b")).first()["b"]
    splits = [-math.inf, *sorted(set(borders)), math.inf]
    ranged = Bucketizer(splits=splits, inputCol="value", outputCol="_range").transform(by_value)
    sums = ranged.groupBy(*groups, "_range").agg(*[F.sum(n).alias(n) for n in weights])
    earlier_ranges = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = sums.select(
        *groups, "_range",
        *[F.coalesce(F.sum(n).over(earlier_ranges), F.lit(0)).alias(f"_{n}_offset") for n in weights],
        *[F.sum(n).over(whole).alias(f"{n}_all") for n in weights],
    )
    in_range = Window.partitionBy(*groups, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select(
        "*", *[F.coalesce(F.sum(n).over(in_range), F.lit(0)).alias(f"_{n}_own") for n in weights]
    )
    return own.join(offsets, [*groups, "_range"]).select(
        *groups, "value", *weights,
        *[(F.col(f"_{n}_own") + F.col(f"_{n}_offset")).alias(f"{n}_before") for n in weights],
        *[F.col(f"{n}_all") for n in weights],
    )


#: Relative rank error of the sketch that brackets a quantile is 1 / ACCURACY; brackets are MARGIN times as wide to each side.
ACCURACY, MARGIN = 10_000, 8


def quantiles(
    df: DataFrame, value: Column, probs: list[float], groups: list[str] | None = None, accuracy: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles q0, q1, ... per group, by selection: nothing is sorted as a whole.

    A sketch brackets each quantile; groups too small for that are bracketed by their ends. A second scan looks up each row once among the
    ends of the brackets, however many quantiles are asked: rows between brackets are counted, and only the values inside one, about
    2 * MARGIN / ACCURACY of the group per quantile, are ranked. A quantile outside its bracket (which the sketch's bound excludes) is an
    error, never a wrong number.
    """
    groups = groups or []
    accuracy = accuracy or ACCURACY
    rows = df.select(*groups, value.cast("double").alias("_x")).filter("_x is not null")
    ends = [F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_first"), F.max("_x").alias("_last")]
    wide = MARGIN / accuracy
    asked = [min(max(p + side * wide, 0.0), 1.0) for p in probs for side in (-1, 1)]
    marks = rows.groupBy(*groups).agg(*ends, F.percentile_approx("_x", asked, accuracy).alias("_m"))
    few = F.col("_n") <= accuracy // 2
    h = [F.lit(float(p)) * (F.col("_n") - 1).cast("double") for p in probs]
    lows = [F.when(few | F.lit(asked[2 * i] == 0), F.col("_first")).otherwise(F.col("_m")[2 * i]) for i in range(len(probs))]
    highs = [F.when(few | F.lit(asked[2 * i + 1] == 1), F.col("_last")).otherwise(F.col("_m")[2 * i + 1]) for i in range(len(probs))]
    wanted = [side(r).cast("double") for r in h for side in (F.floor, F.ceil)]
    marks = marks.filter("_n > 0").select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        *[F.sort_array(F.array(*c)).alias(n) for n, c in (("_lows", lows), ("_highs", highs), ("_wanted", wanted))], F.array(*h).alias("_h"),
    )
    marks = settle(marks)  # a row per group, whose size then decides how it is joined

    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    met = rows.join(F.broadcast(marks) if not groups else marks, same)
    met = met.withColumn("_opened", _places("_lows", len(probs), F.col("_x")))
    # brackets opened and not all closed; rows between two brackets are one cell
    within = (F.col("_opened") > 0) & (F.element_at("_highs", F.greatest(F.col("_opened"), F.lit(1))) >= F.col("_x"))
    met = met.select(*groups, "_x", (2 * F.col("_opened") + F.when(within, 0).otherwise(1)).alias("_at"))
    value = F.when(F.col("_at") % 2 == 0, F.col("_x"))
    cells = settle(met.groupBy(*groups, "_at", value.alias("_v")).agg(F.count(F.lit(1)).alias("_c")))  # read twice
    earlier = Window.partitionBy(*groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * probs + 1 rows a group
    starts = cells.groupBy(*groups, "_at").agg(F.sum("_c").alias("_all")).select(
        *[F.col(g).alias(f"_s_{g}") for g in groups], F.col("_at").alias("_s_at"), F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_start"))
    upto = Window.partitionBy(*groups, "_at").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    own = cells.filter("_v is not null").withColumn("_own", F.sum("_c").over(upto))
    beside = F.col("_at") == F.col("_s_at")
    for g in groups:
        beside = beside & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    ends = own.join(starts, beside).select(*groups, "_v", "_c", (F.col("_start") + F.col("_own")).cast("double").alias("_end"))
    of = marks.select(*[f"_g_{g}" for g in groups], "_wanted")
    ends = ends.join(F.broadcast(of) if not groups else of, same)
    # values that hold a wanted rank, counted from 0
    n_before = _places("_wanted", 2 * len(probs), F.col("_end") - F.col("_c") - 1)
    ends = ends.withColumn("_hits", _places("_wanted", 2 * len(probs), F.col("_end") - 1) - n_before)
    hits = ends.filter("_hits > 0").select(*groups, "_v", "_c", "_end")
    each = marks.select(*[f"_g_{g}" for g in groups], F.posexplode("_h").alias("_i", "_r")).join(hits, same, "left").drop(*groups)
    each = each.withColumnsRenamed({f"_g_{g}": g for g in groups})
    found = [
        F.max(F.when((F.col("_end") - F.col("_c") <= r) & (r < F.col("_end")), F.col("_v"))).alias(side)
        for side, r in (("_lo", F.floor("_r")), ("_hi", F.ceil("_r")))
    ]
    each = each.groupBy(*groups, "_i").agg(*found, F.max(F.col("_r") - F.floor("_r").cast("double")).alias("_part"))
    missed = F.raise_error("a quantile lies outside its bracket").cast("double")
    q = F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), missed).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
    return each.groupBy(*groups).agg(*[F.max(F.when(F.col("_i") == i, q)).alias(f"q{i}") for i in range(len(probs))])


def _places(array: str, size: int, x: Column) -> Column:
    """How many elements of the sorted array of ``size`` are at most x, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])

    def step(found: Column, more: Column) -> Column:
        at = found + more
        return F.when((at <= size) & (F.element_at(array, F.least(at, F.lit(size))) <= x), at).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def quantile_values(df: DataFrame, value: Column, probs: list[float]) -> list[float]:
    """The same, ungrouped, as plain numbers: one row comes to the driver."""
    row = quantiles(df, value, probs).first()
    return [row[f"q{i}"] for i in range(len(probs))]


def score_positions(
    df: DataFrame, score: str, label: str, groups: list[str] | None = None, weight: Column | None = None
) -> DataFrame:
    w = weight if weight is not None else F.lit(1)
    y = F.col(label).cast("long")
    return positions(df, F.col(score), groups, {"p": y * w, "q": (1 - y) * w})


def discrimination(
    df: DataFrame, score: str, label: str, groups: list[str] | None = None, weight: Column | None = None
) -> DataFrame:
    """Counts, tie-averaged AUC and KS per group, from one table of summed scores."""
    groups = groups or []
    pos = score_positions(df, score, label, groups, weight)
    wins = F.col("p") * (2 * F.col("q_before") + F.col("q"))
    gap = ratio(F.col("p_all") - F.col("p_before"), F.col("p_all")) - ratio(
        F.col("q_all") - F.col("q_before"), F.col("q_all")
    )
    return pos.groupBy(*groups).agg(
        F.max(F.col("p_all") + F.col("q_all")).alias("n"), F.max("p_all").alias("pos"),
        F.sum(wins.cast("decimal(38,0)")).alias("_wins"),
        F.max("p_all").alias("_p"), F.max("q_all").alias("_q"), F.max(gap).alias("_ks"),
    ).select(
        *groups, "n", "pos",
        half_even(ratio(F.col("pos"), F.col("n")), 6).alias("base_rate"),
        half_even(
            F.col("_wins").cast("double") / F.when(
                (F.col("_p") > 0) & (F.col("_q") > 0),
                F.lit(2.0) * F.col("_p").cast("double") * F.col("_q").cast("double"),
            ), 6
        ).alias("auc"),
        half_even("_ks", 6).alias("ks"),
    )


def global_rank(df: DataFrame, score: str, order: list[str], descending: bool = False) -> DataFrame:
    """Adds rank, 1..n over the rows with a score, by (score, order), and n_all, their number. Ties are ranked by ``order`` both ways.

    Rows are dealt into ranges of (score, order) and written, and a row's number is its place in its range after the rows of earlier
    ranges: many rows of one score are spread, and nothing is joined by score. Rows without a score stay, without a rank.
    """
    by = [F.desc_nulls_last(score) if descending else F.asc_nulls_last(score), *order]
    dealt = df.repartitionByRange(F.col(score).isNull(), *by).sortWithinPartitions(F.col(score).isNull(), *by)
    spread = settle(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    parts = spread.groupBy(part.alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.count(score).alias("_scored"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = parts.select("_p", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_scored").over(Window.partitionBy(F.lit(1))).alias("n_all"))
    joined = spread.join(F.broadcast(offsets), part == F.col("_p"))
    rank = F.when(F.col(score).isNotNull(), F.col("_before") + F.col("_at") - F.col("_first") + 1)
    return joined.select(*df.columns, rank.alias("rank"), "n_all")


def deciles(df: DataFrame, score: str, order: list[str], bins: int = 10) -> DataFrame:
    """Adds ``decile`` 0..bins-1 by global rank, edges as for equal-width cuts of the ranks; null where the score is."""
    ranked = global_rank(df, score, order)
    r, n = F.col("rank"), F.col("n_all")
    steps = (r - 1) * bins / F.when(n > 1, n - 1)
    place = F.greatest(F.ceil(steps) - 1, F.lit(0)).cast("int")
    return ranked.select(*df.columns, F.when(r.isNotNull(), place).alias("decile"))


def top_fraction(df: DataFrame, score: str, order: list[str], share: float) -> DataFrame:
    """The floor(share * n) best of the rows with a score, at least one; the rows stay distributed."""
    ranked = global_rank(df, score, order, descending=True)
    k = F.greatest(F.floor(F.col("n_all") * share), F.lit(1))
    return ranked.filter(F.col("rank") <= k).select(*df.columns)


def average_rank(df: DataFrame, value: Column) -> DataFrame:
    """Distinct values with their tie-averaged rank."""
    return positions(df, value).select(
        "value", "n", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("avg_rank")
    )
