"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. Target weights are water-filled: a source is taken at most MAX_REPEATS times. Each source is put in a random order
that depends on ids and texts alone and repeated as often as its target asks; its stream ends before the text that would cross the
target, and one more copy of the text whose size is nearest to what is left closes the gap. The stream is cut into blocks of BLOCK_WORDS words. The block quota of a source is exact; a binary tree
divides the quotas among output shards by multivariate-hypergeometric draws, so every shard has its exact number of
blocks and a random mix of sources. A shard then owns a run of each source's permuted blocks, disjoint from those of the
others, and is shuffled locally.

A hot source never meets in one task: its order is cut into buckets of about BUCKET_ROWS rows by hash, whose sums are
prefixed in a table of buckets. The tree splits the quotas of all sources of a group at once; of more than
GROUP_SOURCES sources, groups are dealt first and each group's tree keeps to its part of every shard, so no draw holds more than a group.

Defined results: a null source is a source of its own, last in order; null and empty texts have size 0 and are never
taken; repeated rows are taken alike on average, each row by its place in the order; an empty table gives an empty mix.
Extra columns are carried along; an input column named like a result column gives way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import row_key, settle, word_count

WEIGHTS, MAX_REPEATS = (1.0, 2.0, 3.0), 3
BLOCK_WORDS, SHARDS, BUCKET_ROWS, GROUP_SOURCES, SEED = 100_000, 16, 5_000, 1_000, 17


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = MAX_REPEATS) -> DataFrame:
    """sizes: (source, source_size, ...), one row per source. Adds weight and target, water-filled below limit * source_size."""
    # one row per source: sorted in ranges, numbered within a range, shifted by the ranges before
    ranged = settle(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    shift = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    shift = shift.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(own) - 1 + F.col("_before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    t = settle(ranged.join(F.broadcast(shift), "_range").withColumn("weight", weight).drop("_range", "_before"))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    scale, capped = 0.0, -1
    while True:  # the scale only grows, and each round caps at least one more source
        full = F.lit(limit) * F.col("source_size") <= F.col("weight") * scale
        n, held, free = t.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.lit(limit) * F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == capped or not free:
            break
        capped, scale = n, (total - (held or 0)) / free
    return t.withColumn("target", F.least(F.lit(float(limit)) * F.col("source_size"), F.col("weight") * scale))


def even(total: int, shards: int) -> np.ndarray:
    """Shard totals that differ by one at most."""
    return np.diff(total * np.arange(shards + 1) // shards)


def split(quota: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(shards, kinds): quota of each kind dealt to shards of the given totals; a node of the tree draws what its left half gets of every kind."""
    if len(totals) == 1:
        return quota[None, :]
    half = len(totals) // 2
    left = rng.multivariate_hypergeometric(quota, int(totals[:half].sum()), method="marginals")
    return np.concatenate([split(left, totals[:half], rng), split(quota - left, totals[half:], rng)])


def deal(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """split among shards of near-equal totals."""
    return split(quota, even(int(quota.sum()), shards), rng)


def plan(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """quotas: (source, blocks). Returns (source, shard, first, blocks): the run of permuted blocks each shard owns."""
    n = quotas.count()
    groups = max(1, -(-n // GROUP_SOURCES))
    named = quotas.withColumn("_group", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int"))
    sums = dict(named.groupBy("_group").agg(F.sum("blocks")).collect())  # one number per GROUP_SOURCES sources
    dealt = deal(np.array([sums.get(g, 0) for g in range(groups)], np.int64), shards, np.random.default_rng(seed))
    shared = quotas.sparkSession.sparkContext.broadcast(dealt)

    def within(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("source", na_position="last")
        own = split(part["blocks"].to_numpy(np.int64), shared.value[:, key[0]], np.random.default_rng([seed, key[0] + 1]))
        first = np.cumsum(own, 0) - own
        shard, kind = np.nonzero(own)
        return pd.DataFrame({"source": part["source"].to_numpy()[kind], "shard": shard.astype(np.int32), "first": first[shard, kind], "blocks": own[shard, kind]})

    kind = quotas.schema["source"].dataType.simpleString()
    return named.groupBy("_group").applyInPandas(within, f"source {kind}, shard int, first bigint, blocks bigint")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", word_count(text))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: _key, source, size, source_size, target, taken (words, repeats counted) and places, an array of (shard, position) per copy.

    Only ids, sources and sizes are kept; join on _key (common.row_key) for the texts.
    """
    rows = settle(docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"), row_key(key, text).alias("_key"), word_count(text).alias("size"),
    ).withColumn("_turn", F.xxhash64(F.lit(seed), "_key")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    goal = settle(targets(sums))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_rows") / BUCKET_ROWS)).cast("long")
    same = F.col("g.source").eqNullSafe(F.col("r.source"))
    rows = rows.alias("r").join(goal.alias("g"), same).select("r.*", "source_size", "target", buckets.alias("_buckets"))
    # the order of a source: by bucket of the hash, then by hash
    rows = rows.withColumn("_bucket", F.pmod(F.shiftright("_turn", 8), "_buckets"))
    rows = settle(rows)
    heads = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    # a row per bucket of BUCKET_ROWS rows
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_head"))
    w = Window.partitionBy("source", "_bucket").orderBy("_turn", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum("size").over(w))
    rows = rows.join(heads, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn("_start", F.col("_head") + F.col("_end") - F.col("size"))
    # copy c of a row starts at c * source_size + _start; it is taken if it ends before the target
    whole = F.floor((F.col("target") - F.col("_start") - F.col("size")) / F.greatest("source_size", F.lit(1))) + 1
    copies = F.when(F.col("size") > 0, F.least(F.lit(MAX_REPEATS), F.greatest(F.lit(0), whole))).otherwise(0).cast("int")
    rows = settle(rows.withColumn("copies", copies).drop("_s", "_b", "_end", "_head", "_buckets"))
    # what is left of the target is less than a text: one more copy of the text nearest to it, if that brings the source closer
    short = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("_short")).withColumnRenamed("source", "_s")
    again = rows.filter((F.col("size") > 0) & (F.col("copies") < MAX_REPEATS)).join(short, F.col("source").eqNullSafe(F.col("_s")))
    again = again.filter(F.abs(F.col("size") - F.col("_short")) < F.col("_short")).groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("size") - F.col("_short")), F.col("_turn"), F.col("_key").alias("k"), F.col("_start").alias("s"))).alias("m")
    ).select(F.col("source").alias("_s"), F.col("m.k").alias("_k"), F.col("m.s").alias("_at"))
    one = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k")) & (F.col("_start") == F.col("_at"))
    rows = settle(rows.join(again, one, "left").withColumn("copies", F.col("copies") + F.col("_k").isNotNull().cast("int")).drop("_s", "_k", "_at"))
    block = F.floor(F.least(F.col("_c") * F.col("source_size") + F.col("_start"), F.greatest(F.lit(0), F.col("target") - 1)) / BLOCK_WORDS)
    cells = rows.filter("copies > 0").withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("_block", block)
    quotas = settle(cells.groupBy("source").agg((F.max("_block") + 1).alias("blocks")))
    runs = settle(plan(quotas, shards, seed)).withColumnsRenamed({"source": "_s"})
    # each source's blocks in order are dealt as runs; a row per shard and source
    owned = cells.join(
        runs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") >= F.col("first")) & (F.col("_block") < F.col("first") + F.col("blocks"))
    )
    place = F.struct("shard", F.xxhash64(F.lit(seed + 1), "_key", "_c").alias("position"), F.col("_c").alias("copy"))
    places = owned.groupBy("_key", "_start").agg(F.sort_array(F.collect_set(place)).alias("places"))
    out = rows.join(places, ["_key", "_start"], "left")
    drawn = F.coalesce("places", F.array().cast("array<struct<shard:int,position:bigint,copy:int>>"))
    return out.select(
        F.col("id").alias(key), "_key", F.col("source").alias(source), "size", "source_size", "target",
        (F.col("size") * F.size(drawn)).cast("long").alias("taken"), F.size(drawn).alias("copies"), drawn.alias("places"),
    )


def shards_of(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix as rows: every copy of every text with its shard and position, a shard at a time in shuffled order."""
    places = mixed.filter("copies > 0").groupBy("_key").agg(F.flatten(F.collect_list("places")).alias("_places"))
    kept = [c for c in docs.columns if c not in ("shard", "position", "copy", "_key", "_places")]
    rows = docs.select(*kept, row_key(key, text).alias("_key")).dropDuplicates(["_key"]).join(places, "_key")
    rows = rows.select(*kept, F.explode("_places").alias("_p"))
    return rows.select(*kept, "_p.shard", "_p.position", "_p.copy").repartition("shard", F.pmod("position", F.lit(16))).sortWithinPartitions("shard", "position")
