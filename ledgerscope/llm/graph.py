"""Connected components of an edge table by alternating large-star and small-star rounds.

While the edges are few, a step gathers the neighbours of each node, equal edges met before they move: one shuffle, and no step adds edges. Beyond that a step is a grouped minimum (map-side
combined) and a join with a row per node, in which nodes with very many neighbours are dealt over all tasks. Rounds are written to the shared
folder, which cuts the lineage; every job of a round costs the driver memory for its tasks and threads, whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import dealt_join, is_small, settle

MAX_ROUNDS = 40


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component. Loops and repeats are allowed."""
    e = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    )
    e = few_stars(e) if is_small(e) else many_stars(e)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest one; moved says whether a row changed."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sets = both.groupBy("u").agg(F.collect_set("v").alias("vs")).withColumn("m", F.least("u", F.array_min("vs")))
    larger = F.filter("vs", lambda v: v > F.col("u"))
    return sets.select(F.explode(larger).alias("x"), "m", (F.col("m") != F.col("u")).alias("moved")).withColumnsRenamed({"x": "u", "m": "v"})


def small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    sets = e.groupBy("u").agg(F.collect_set("v").alias("vs"), F.max("moved").alias("was")).withColumn("m", F.array_min("vs"))
    moving = F.transform("vs", lambda v: F.when(v == F.col("m"), F.col("u")).otherwise(v))
    return sets.select(F.explode(moving).alias("x"), "m", (F.col("was") | (F.size("vs") > 1)).alias("moved")).withColumnsRenamed({"x": "u", "m": "v"})


def few_stars(e: DataFrame) -> DataFrame:
    """The star forest (u, v) of few edges, u > v, in two rounds a job. No set of neighbours is larger than is_small allows."""
    for _ in range(MAX_ROUNDS):
        e = settle(small_star(large_star(small_star(large_star(e)))))
        if e.filter("moved").isEmpty():
            return e.select("u", "v")
    raise RuntimeError("components did not settle")


def many_stars(e: DataFrame) -> DataFrame:
    """The star forest (u, v) of any number of edges, u > v."""
    last = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = dealt_join(both.filter("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt_join(large, low, "u")
        e = settle(
            small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        )
        now = e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e
        last = now
    raise RuntimeError("components did not settle")
