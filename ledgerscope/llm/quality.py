"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base figures of every whole text decide base_failed. Five rates (symbols, repeated lines, repeated words, capitals, shouting) are
rules with a ladder of cutoffs. The labelled texts that pass the base rules are the holdout: for every stratum, rule and cutoff the
false rejections among its n good texts are counted. A cutoff is certified if the exact binomial test rejects "the rate of
false rejections is above RISK / rules" at level ERROR / (rules * strata), the Bonferroni share, and so do all laxer cutoffs of
that rule (a fixed testing order, so the ladder costs no further correction). Hence with probability 1 - ERROR no stratum loses
over RISK of its good texts. Of the certified cutoffs the one with the best surplus of bad over good rejections is used, the
laxest on ties; without a surplus the rule is off there.

Defined results: null and empty texts have zero words, so they fail the base rules; a null stratum is the stratum "none";
labels of no text, and null labels, count nowhere; contradicting labels of one id count as bad; too few labels certify nothing, and then
only the base rules reject. Repeated rows are judged alike. Other columns pass through; an input column named like a
result gives way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import SPACE, settle, small_or_shuffled

RISK, ERROR = 0.02, 0.05
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Cutoffs in ten-thousandths, from lax to strict.
CUTS = (9000, 8000, 7000, 6000, 5000, 4000, 3000, 2500, 2000, 1500, 1200, 1000, 800, 600, 500, 400, 300, 200, 100)
SYMBOLS, SHOUTS, CAPITALS = "#*$%&|<>", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rule: the count, and what it is a rate of.
RULES = {
    "symbols": ("n_symbols", "word_chars"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"), "shouts": ("n_shouts", "word_chars"),
}


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. words: an array that is evaluated already."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    twice = lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"]))
    covered = lambda at: F.aggregate(
        F.transform(at, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(at, k - 1), x - 3))), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(words) >= 3, bind(bind(F.sort_array(hashed), twice), covered)).otherwise(0)


def without(text: Column, characters: str) -> Column:
    """Number of characters of the text that are in characters."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base figures and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")
    of_words = bind(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    of_lines = bind(
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")),
    )
    results = {
        "n_words": F.col("_w.n"), "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")), "n_symbols": without(t, SYMBOLS),
        "n_dup_lines": F.col("_l.d"), "n_repeat_words": F.col("_w.r"), "n_lines": F.col("_l.n"), "n_capitals": without(t, CAPITALS),
        "n_shouts": without(t, SHOUTS),
    }
    kept = [c for c in docs.columns if c not in {*results, "base_failed", "kept", "failed_rules"}]
    out = docs.select(*kept).withColumns({"_w": of_words, "_l": of_lines})
    out = out.select(*kept, *[c.cast("long").alias(n) for n, c in results.items()])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: the Stirling series at x + 10, brought back by the product."""
    y = x + 10
    back = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda a, j: a + F.log(x + j))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def at_most(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k) for k below the mean, 1 from there on: terms from k downwards until they no longer count."""
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log(1 - rate)
    fall = k / (n - k + 1) * ((1 - rate) / rate)
    terms = F.least(k, F.ceil(40 / F.greatest(1 - fall, F.lit(1e-6)))).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        i = k - j  # the term of i from that of i + 1
        term = a["term"] * (i + 1) / (n - i) * ((1 - rate) / rate)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step)["sum"]).otherwise(1.0)
    return F.when(k >= n * rate, 1.0).otherwise(F.exp(top) * total)


def thresholds(holdout: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """holdout: figures with _stratum and _quality (1 good, 0 bad). Returns (_stratum, _cuts: map of rule to cutoff)."""
    cells = []
    for rule, (count, base) in RULES.items():
        for place, cut in enumerate(CUTS):
            over = 10_000 * F.col(count) > cut * F.col(base)
            cells.append(F.struct(
                F.lit(rule).alias("rule"), F.lit(place).alias("place"), F.lit(cut).alias("cut"),
                F.count_if(over & (F.col("_quality") == 1)).alias("good"), F.count_if(over & (F.col("_quality") == 0)).alias("bad"),
            ))
    counted = holdout.groupBy("_stratum").agg(F.count_if(F.col("_quality") == 1).alias("n"), F.array(*cells).alias("cells"))
    counted = settle(counted.select("_stratum", "n", F.explode("cells").alias("c")).select("_stratum", "n", "c.*"))
    strata = counted.agg(F.count_distinct("_stratum").alias("strata"))
    level = error / len(RULES) / F.col("strata")
    safe = at_most(F.col("good"), F.col("n"), risk / len(RULES)) <= level
    tested = counted.crossJoin(F.broadcast(strata)).withColumn("safe", (F.col("n") > 0) & safe)  # strata: one row
    first_unsafe = tested.groupBy("_stratum", "rule").agg(F.coalesce(F.min(F.when(~F.col("safe"), F.col("place"))), F.lit(len(CUTS))).alias("_end"))
    gain = F.col("bad") - F.col("good")
    best = tested.join(first_unsafe, ["_stratum", "rule"]).filter((F.col("place") < F.col("_end")) & (gain > 0)).groupBy("_stratum", "rule").agg(
        F.max(F.struct(gain.alias("gain"), F.col("cut"))).alias("b")
    )
    return settle(best.groupBy("_stratum").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "b.cut")))).alias("_cuts")))


def verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """docs with the figures, base_failed, failed_rules and kept."""
    rows = docs.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("none")))
    judged = settle(figures(rows, text).drop(text))
    known = labels.filter(F.col("quality").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min("quality").alias("_quality"))
    cuts = thresholds(judged.filter("not base_failed").join(known, F.col(key) == F.col("_id")))
    joined = judged.join(small_or_shuffled(cuts).withColumnRenamed("_stratum", "_s"), F.col("_stratum") == F.col("_s"), "left")
    over = [F.when(10_000 * F.col(count) > F.col("_cuts")[rule] * F.col(base), F.lit(rule)) for rule, (count, base) in RULES.items()]
    joined = joined.withColumn("failed_rules", F.array_compact(F.array(*over)))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_stratum", "_s", "_cuts")
