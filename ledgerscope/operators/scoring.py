"""How well a score separates: by population, by share flagged, by decile, over bootstrap replicates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions.numeric import half_even, mean, rate, ratio
from ledgerscope.operators import ranks
from ledgerscope.sources.scratch import settle


def by_population(test: DataFrame, score: str, label: str = "label") -> DataFrame:
    """AUC and KS on current loans, on the operating book and on everything, from one summed table."""
    dpd = F.col("dpd_current")
    member = F.filter(
        F.array(F.when(dpd == 0, F.lit("clean")), F.when(dpd < P.ESCALATION_DPD, F.lit("operating")), F.lit("all")),
        lambda x: x.isNotNull(),
    )
    return ranks.discrimination(test.select(score, label, F.explode(member).alias("population")), score, label, ["population"])


def by_segment(test: DataFrame, score: str, segments: list[str] = P.PRIORITY_SEGMENTS) -> DataFrame:
    operating = test.filter((F.col("dpd_current") < P.ESCALATION_DPD) & F.col("segment").isin(segments))
    return ranks.discrimination(operating, score, "label", ["segment"])


def lift_table(df: DataFrame, score: str, order: list[str]) -> DataFrame:
    return ranks.deciles(df, score, order).groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("pos"),
        half_even(rate(F.col("label") == 1), 6).alias("rate"),
    )


def top_decile_lift(df: DataFrame, score: str, order: list[str]) -> DataFrame:
    top = F.col("decile") == 9
    y = F.col("label") == 1
    return ranks.deciles(df, score, order).agg(
        half_even(ratio(ratio(F.count_if(top & y), F.count_if(top)), rate(y)), 6).alias("lift")
    )


def precision_recall(df: DataFrame, score: str, shares: tuple = (0.05, 0.10, 0.20)) -> DataFrame:
    """Flags, precision and recall at the score of each top share; one scan for all shares."""
    cuts = ranks.quantile_values(df, F.col(score), [1 - s for s in shares])
    y = F.col("label") == 1
    one = df.agg(F.count_if(y).alias("pos"), *[
        c for i, cut in enumerate(cuts) for c in (
            F.count_if(F.col(score) >= F.lit(cut)).alias(f"n{i}"), F.count_if(y & (F.col(score) >= F.lit(cut))).alias(f"t{i}"),
        )
    ])
    return one.select(F.explode(F.array(*[
        F.struct(
            F.lit(s).alias("top_share"), F.lit(half).alias("threshold"), F.col(f"n{i}").alias("n_flagged"),
            half_even(F.col(f"t{i}") / F.greatest(F.col(f"n{i}"), F.lit(1)), 6).alias("precision"),
            half_even(F.col(f"t{i}") / F.greatest(F.col("pos"), F.lit(1)), 6).alias("recall"),
        ) for i, (s, half) in enumerate(zip(shares, [round(c, 6) for c in cuts]))
    ])).alias("s")).select("s.*")


def calibration(df: DataFrame, scores: list[str]) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("n"), rate(F.col("label") == 1).alias("a"), *[mean(s, 6).alias(f"p_{s}") for s in scores])
    return one.select("n", "a", F.explode(F.array(*[
        F.struct(F.lit(s).alias("score"), F.col(f"p_{s}").alias("p")) for s in scores
    ])).alias("s")).select("s.score", "n", half_even("s.p", 6).alias("mean_predicted"), half_even("a", 6).alias("actual"))


def coincidence(df: DataFrame, score: str, order: list[str], share: float = 0.01) -> DataFrame:
    """Of the top flags, how many are already 30+ or 60+ days late."""
    return ranks.top_fraction(df, score, order, share).agg(
        F.count(F.lit(1)).alias("n_top"), half_even(rate(F.col("dpd_current") >= 30), 6).alias("share_30"),
        half_even(rate(F.col("dpd_current") >= 60), 6).alias("share_60"),
    )


#: Poisson(1) weight of a 32-bit draw: how many of these bounds it reaches. Beyond the last lies less than one draw.
POISSON_BOUNDS = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(13)]
DRAWS_PER_HASH = 4
#: Rows of one score in a batch from which they travel summed.
SUMMED_FROM = 16


def replicate_weights(keys: list[str], replicates: int, seed: int) -> np.ndarray:
    """(keys, replicates) Poisson(1) weights. Draw r of a key is the r % 4th 32-bit piece of md5(seed:key:r div 4)."""
    hashes = -(-replicates // DRAWS_PER_HASH)
    digests = b"".join(hashlib.md5(f"{seed}:{k}:{i}".encode()).digest() for k in keys for i in range(hashes))
    draws = np.frombuffer(digests, ">u4").reshape(len(keys), hashes * DRAWS_PER_HASH)[:, :replicates]
    return np.searchsorted(np.array(POISSON_BOUNDS), draws.astype(np.int64), side="right")


def replicate_auc(df: DataFrame, score: str, label: str, key: list[str], replicates: int = 200, seed: int = 20260603) -> DataFrame:
    """(replicate, auc): tie-averaged AUC on Poisson resamples of the rows, replicates without both labels left out.

    Rows never multiply by the replicates. They are dealt into ranges of the score; a task keeps running sums of the weights of all
    replicates and returns one row with its wins and totals, to which the totals of the lower ranges are then added. Rows of one score stand in one
    range, so where a batch holds many of them they are summed before they travel. Rows without a score are left out.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"), F.concat_ws(":", *[F.col(k).cast("string") for k in key]).alias("k"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            many = b.groupby("s")["s"].transform("size") >= SUMMED_FROM
            yield b[~many].assign(w=None)
            out = []
            for (s, y), part in b[many].groupby(["s", "y"]):
                w = sum(replicate_weights(part["k"].iloc[lo : lo + 1000].tolist(), replicates, seed).sum(0) for lo in range(0, len(part), 1000))
                out.append((s, y, None, w.astype(np.int64).tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["s", "y", "k", "w"])

    def wins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, before, total, won = None, np.zeros((2, replicates)), np.zeros(replicates), np.zeros((2, replicates)), np.zeros(replicates)
        part = None
        for b in batches:
            for lo in range(0, len(b), 2000):
                c = b.iloc[lo : lo + 2000]
                w = np.zeros((len(c), replicates))
                raw = c["w"].isna().to_numpy()
                if raw.any():
                    w[raw] = replicate_weights(c["k"][raw].tolist(), replicates, seed)
                for i in np.flatnonzero(~raw):
                    w[i] = np.frombuffer(c["w"].iloc[i], np.int64)
                part = int(c["part"].iloc[0])
                for i, (s, y) in enumerate(zip(c["s"], c["y"], strict=True)):
                    if s != at:
                        won += own[1] * (2 * before + own[0])
                        before, total = before + own[0], total + own
                        at, own = s, np.zeros((2, replicates))
                    own[y] += w[i]
        if part is not None:
            won += own[1] * (2 * before + own[0])
            total = total + own
            yield pd.DataFrame({"part": part, "replicate": np.arange(replicates), "won": won, "p": total[1], "q": total[0]})

    dealt = rows.mapInPandas(summed, "s double, y int, k string, w binary").repartitionByRange("s").sortWithinPartitions("s")
    ranges = dealt.withColumn("part", F.spark_partition_id()).mapInPandas(wins, "part int, replicate int, won double, p double, q double")
    lower = Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    whole = ranges.withColumn("won", F.col("won") + 2 * F.col("p") * F.coalesce(F.sum("q").over(lower), F.lit(0.0)))
    sums = whole.groupBy("replicate").agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums.filter("p > 0 and q > 0").select("replicate", half_even(F.col("won") / (2 * F.col("p") * F.col("q")), 6).alias("auc"))


def bootstrap_auc(df: DataFrame, score: str, label: str, key: list[str], replicates: int = 200, seed: int = 20260603) -> DataFrame:
    """Mean and 95 % interval of the AUC over resamples of the rows."""
    per = settle(replicate_auc(df, score, label, key, replicates, seed))
    ends = ranks.quantiles(per, F.col("auc"), [0.025, 0.975])
    return per.agg(F.count(F.lit(1)).alias("replicates"), half_even(F.sum(F.col("auc").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1)), 6).alias("mean_auc")).join(
        ends.select(half_even("q0", 6).alias("lo"), half_even("q1", 6).alias("hi")).withColumn("_k", F.lit(1)),
        F.lit(1) == F.col("_k"),
    ).drop("_k")
