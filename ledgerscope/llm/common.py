"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.sources import scratch

#: Words of a text: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
words_of = re.compile(WORD).findall


#: Rows that go to a Python worker at once: texts can be long, and a worker holds a few copies of its batch.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; also bounds what Python workers get at once."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """At most ARROW_ROWS rows (fewer where the session says so) and about ARROW_BYTES bytes in a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving what its batches held back to the system when the partition ends: workers live on between stages."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Freed memory of Arrow's pool and, where the C library can, of the heap goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: computed once, with short lineage."""
    return scratch.settle(df)


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo divisor; null keys give null."""
    return F.crc32(F.col(key).cast("string")) % divisor


def is_remainder(key: str, divisor: int, value: int) -> Column:
    return F.coalesce(remainder(key, divisor) == value, F.lit(False))


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """Identity of a row by its id and text, never null: repeated rows share it and so share their result."""
    return F.concat_ws(
        ":", F.coalesce(F.col(key).cast("string"), F.lit("~")), F.hex(F.xxhash64(F.col(text))),
        F.coalesce(F.length(F.col(text)), F.lit(-1)),
    )


def word_count(text: str = "text") -> Column:
    """Number of words, JVM-side: the parts that a split at white space leaves, without empty ends."""
    parts = F.split(F.col(text), f"{SPACE}+")
    return F.coalesce(F.size(F.filter(parts, lambda w: w != "")), F.lit(0)).cast("long")


def is_small(df: DataFrame, rows: int = 200_000, size: int = 32 << 20) -> bool:
    """Whether a written table has at most so many rows and about so many bytes."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= size


def small_or_shuffled(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table, marked for broadcast while it is small; beyond that the join shuffles. The result is the same."""
    return F.broadcast(df) if is_small(df, rows) else df


def dealt_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has a row per key at most, however many rows of left share a key.

    A small right side is broadcast. Otherwise keys with more than `most` rows of left, and more than a ten-thousandth of all, are at most 10,000: their rows of right are broadcast. The others shuffle.
    Where they are known already, counts has (key, _n).
    """
    if is_small(right):
        return left.join(F.broadcast(right), key, how)
    if counts is None:
        counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = settle(counts.filter(F.col("_n") > most))
    if hot.isEmpty():
        return left.join(right, key, how)
    limit = max(most, left.count() // 10_000)
    hot = F.broadcast(hot.filter(F.col("_n") > limit).select(key, F.lit(True).alias("_hot")))
    marked = left.join(hot, key, "left")
    few = F.broadcast(right.join(hot, key, "left_semi"))
    calm = marked.filter("_hot is null").drop("_hot").join(right, key, how)
    return marked.filter("_hot").drop("_hot").join(few, key, how).unionByName(calm)
