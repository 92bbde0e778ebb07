"""Ordered per-entity calculations that survive very long entities.

A panel is keyed by (entity, position), position counting 1..n without gaps. Where the longest
entity is known to hold at most ``CHUNK`` rows (``sequence_number`` bounds it and notes it in the
position column's metadata), a plain window per entity is used. Otherwise entities are cut into
chunks by position, so no window partition exceeds ``CHUNK`` rows however large one entity is:
windows run per (entity, chunk) and the running value at each full chunk's last row is carried into
the later chunks by a join on the same keys, which does not shuffle the large side again.

Customer-by-month panels need none of this: one row per customer and month bounds a partition by the
number of calendar months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.sources.scratch import settle

CHUNK = 1_000_000
CHUNK_COLUMN = "panel_chunk"
LONGEST = "longest"  # no entity has more rows than this
#: Hash buckets whose sizes bound those of the keys: their counts are few enough to be summed before they travel.
BUCKETS = 1 << 14

_AGGS = {"sum": F.sum, "max": F.max, "min": F.min}


def is_short(df: DataFrame, pos: str, size: int) -> bool:
    return df.schema[pos].metadata.get(LONGEST, size + 1) <= size


def chunked(df: DataFrame, pos: str, size: int) -> DataFrame:
    """Add the chunk number, unless the frame already carries it (then its partitioning is reused)."""
    if CHUNK_COLUMN in df.columns:
        return df
    return df.withColumn(CHUNK_COLUMN, F.floor((F.col(pos) - 1) / size).cast("long"))


def _carry(own: DataFrame, key: str, pos: str, names: list[str], totals, size: int) -> DataFrame:
    """Join each later chunk with ``totals`` of the full chunks before it."""
    before = Window.partitionBy("_key").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
    ends = own.filter(F.col(pos) % size == 0).select(
        F.col(key).alias("_key"), (F.col(CHUNK_COLUMN) + 1).alias("_next"), *names
    )
    carry = totals(ends, before)
    return own.join(carry, (own[key] == carry["_key"]) & (own[CHUNK_COLUMN] == carry["_next"]), "left")


def running(
    df: DataFrame, key: str, pos: str, measures: dict[str, tuple[str, Column]], size: int | None = None
) -> DataFrame:
    """Running sum / max / min from the entity's first row to the current one."""
    size = size or CHUNK
    if is_short(df, pos, size):
        w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[_AGGS[a](c).over(w).alias(n) for n, (a, c) in measures.items()])
    kept = df.columns
    df = chunked(df, pos, size)
    w = Window.partitionBy(key, CHUNK_COLUMN).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    own = df.select("*", *[_AGGS[a](c).over(w).alias(f"_own_{n}") for n, (a, c) in measures.items()])

    def totals(ends: DataFrame, before) -> DataFrame:
        return ends.select("_key", "_next", *[
            _AGGS[a](f"_own_{n}").over(before).alias(f"_before_{n}") for n, (a, _) in measures.items()
        ])

    joined = _carry(own, key, pos, [f"_own_{n}" for n in measures], totals, size)
    combine = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + b,
        "max": F.greatest,
        "min": F.least,
    }
    return joined.select(*kept, *[
        combine[a](F.col(f"_before_{n}"), F.col(f"_own_{n}")).alias(n) for n, (a, _) in measures.items()
    ])


def neighbour(
    df: DataFrame, key: str, pos: str, value: str, name: str, step: int = 1, size: int | None = None
) -> DataFrame:
    """Value of the next (step=1) or previous (step=-1) row of the entity."""
    size = size or CHUNK
    shift = F.lead(value) if step > 0 else F.lag(value)
    if is_short(df, pos, size):
        return df.withColumn(name, shift.over(Window.partitionBy(key).orderBy(pos)))
    kept = df.columns
    df = chunked(df, pos, size)
    own = df.withColumn("_own", shift.over(Window.partitionBy(key, CHUNK_COLUMN).orderBy(pos)))
    # the row just across each chunk edge, addressed to the chunk that needs it
    facing, needing = (1 % size, 0) if step > 0 else (0, 1 % size)
    across = df.filter(F.col(pos) % size == facing).select(
        F.col(key).alias("_key"), (F.col(CHUNK_COLUMN) - step).alias("_chunk"), F.col(value).alias("_across")
    )
    joined = own.join(across, (own[key] == across["_key"]) & (own[CHUNK_COLUMN] == across["_chunk"]), "left")
    at_edge = F.col(pos) % size == needing
    return joined.select(*kept, F.coalesce(F.col("_own"), F.when(at_edge, F.col("_across"))).alias(name))


def sequence_number(df: DataFrame, key: str, order: list[str], name: str, hot_rows: int | None = None) -> DataFrame:
    """row_number() per key, also for keys (null included) that hold a large share of the table.

    The largest key is bounded first: no key has more rows than its hash bucket. Up to ``hot_rows`` rows a plain window does; only where a
    bucket is larger are the keys themselves counted. Beyond the limit, the rows of the keys above it (at most rows/hot_rows of them, so
    their list is small) are written in ranges of (key, order); they are numbered within key and range and shifted by the sizes of the
    key's earlier ranges. Both ways give the same numbers.
    """
    hot_rows = hot_rows or CHUNK

    def most(*keys: str | Column) -> tuple[DataFrame, int]:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        return counts, counts.agg(F.max("_n").alias("m")).first()["m"] or 0

    _, longest = most(F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    if longest > hot_rows:
        counts, longest = most(key)
    plain = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    if longest <= hot_rows:
        return df.withColumn(name, plain).withMetadata(name, {LONGEST: longest})
    hot = counts.filter(F.col("_n") > hot_rows).select(F.col(key).alias("_hot_key"), "_n", F.lit(True).alias("_hot"))
    pieces = -(-hot.agg(F.sum("_n")).first()[0] // hot_rows) + 1
    marked = df.join(F.broadcast(hot.drop("_n")), F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    ranged = marked.filter("_hot").select(*df.columns).repartitionByRange(pieces, key, *order)
    spread = settle(ranged.withColumn("_part", F.spark_partition_id()))
    own = spread.withColumn("_own", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    parts = spread.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and range
    offsets = parts.select("_k", "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = own.join(offsets, own[key].eqNullSafe(offsets["_k"]) & (own["_part"] == offsets["_p"]))
    numbered = joined.select(*df.columns, (F.col("_before") + F.col("_own")).cast("long").alias(name))
    rest = marked.filter("_hot is null").select(*df.columns).withColumn(name, plain)
    return rest.unionByName(numbered).withMetadata(name, {LONGEST: longest})


def run_length(df: DataFrame, key: str, pos: str, signals: dict[str, str], size: int | None = None) -> DataFrame:
    """Length of the unbroken run of positive values ending at each row.

    The run is the distance to the last row that was not positive: one running maximum, no islands.
    """
    stops = {
        f"_stop_{n}": ("max", F.when(F.coalesce(F.col(c), F.lit(0)) <= 0, F.col(pos)).otherwise(F.lit(0)))
        for n, c in signals.items()
    }
    out = running(df, key, pos, stops, size)
    return out.select(
        *df.columns, *[(F.col(pos) - F.col(f"_stop_{n}")).cast("long").alias(n) for n in signals]
    )


def rows_since(df: DataFrame, key: str, pos: str, flag: Column, name: str, cap: int, size: int | None = None) -> DataFrame:
    """Rows since the flag was last true, capped; the cap also stands for never."""
    out = running(df, key, pos, {"_last": ("max", F.when(flag, F.col(pos)))}, size)
    gap = F.coalesce(F.col(pos) - F.col("_last"), F.lit(cap))
    return out.select(*df.columns, F.least(gap, F.lit(cap)).cast("long").alias(name))


def first_occurrence(df: DataFrame, key: str, pos: str, flag: Column, name: str, size: int | None = None) -> DataFrame:
    out = running(df, key, pos, {"_seen": ("sum", F.coalesce(flag.cast("int"), F.lit(0)))}, size)
    return out.select(*df.columns, (flag & (F.col("_seen") == 1)).cast("int").alias(name))


def dpd_walk(
    df: DataFrame, key: str, pos: str, delta: Column, missed: Column | None = None, size: int | None = None
) -> DataFrame:
    """Days past due as a walk that never drops below zero: S - min(0, running min of S).

    ``missed`` adds the running count of missed periods in the same pass.
    """
    size = size or CHUNK
    missed = F.lit(0) if missed is None else missed
    kept = df.columns
    short = is_short(df, pos, size)
    if not short:
        df = chunked(df, pos, size)
    keys = [key] if short else [key, CHUNK_COLUMN]
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    own = df.select(
        "*", F.sum(delta.cast("long")).over(w).alias("_s"), F.sum(missed.cast("long")).over(w).alias("_c")
    ).withColumn("_m", F.min("_s").over(w))
    s, m, c = F.col("_s"), F.col("_m"), F.col("_c")
    if not short:

        def totals(ends: DataFrame, before) -> DataFrame:
            summed = ends.select(
                "_key", "_next", F.sum("_c").over(before).alias("_c0"),
                F.sum("_s").over(before).alias("_s0"), F.col("_s").alias("_se"), F.col("_m").alias("_me"),
            )
            return summed.select(
                "_key", "_next", "_c0", "_s0",
                F.min(F.col("_s0") - F.col("_se") + F.col("_me")).over(before).alias("_m0"),
            )

        own = _carry(own, key, pos, ["_s", "_m", "_c"], totals, size)
        s0, c0 = F.coalesce(F.col("_s0"), F.lit(0)), F.coalesce(F.col("_c0"), F.lit(0))
        s, m, c = s0 + s, F.least(F.col("_m0"), s0 + m), c0 + c
    return own.select(
        *kept, c.cast("long").alias("missed_payments_cum"), (s - F.least(F.lit(0), m)).cast("int").alias("dpd")
    )


def until_first(df: DataFrame, key: str, pos: str, stop: Column, size: int | None = None) -> DataFrame:
    """Rows up to and including the first where ``stop`` holds (a panel that ends at write-off)."""
    out = running(df, key, pos, {"_stops": ("sum", F.coalesce(stop.cast("int"), F.lit(0)))}, size)
    kept = (F.col("_stops") == 0) | ((F.col("_stops") == 1) & stop)
    return out.filter(kept).select(*df.columns)
