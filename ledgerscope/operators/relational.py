"""Small relational building blocks: guarded joins, dimensions, mixes, firsts and lasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.numeric import col, half_even, ratio


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame itself, or an error when a key repeats (the one-to-one / many-to-one guard)."""
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        raise ValueError(f"key not unique: {keys}")
    return df


def left_many_to_one(df: DataFrame, dim: DataFrame, keys: list[str], guard: bool = True) -> DataFrame:
    return df.join(assert_unique(dim, keys) if guard else dim, keys, "left")


def canonical_order(df: DataFrame, column: str, order: list, fill: dict | None = None) -> DataFrame:
    """Every category of ``order`` once, missing ones with nulls or the given fills, plus its position."""
    dim = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"{column} string, position int")
    out = dim.join(df, column, "left")
    return out.fillna(fill) if fill else out


def shares(df: DataFrame, by: list[str], parent: list[str] | None = None) -> DataFrame:
    """Counts per category and their share of the parent group (or of everything).

    The window runs over the counted categories, not over the rows.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*(parent or []))
    return counts.withColumn("share", half_even(ratio(F.col("n"), F.sum("n").over(w)), 6))


def row_percent_pivot(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Crosstab in canonical column order, zero-filled, in percent of the row."""
    counts = df.groupBy(rows).pivot(columns, values).count().fillna(0)
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return counts.select(rows, *[half_even(100 * ratio(F.col(f"`{v}`"), total), 4).alias(f"p{i}") for i, v in enumerate(values)])


def mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value per group with its share; ties go to the smaller value."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group).agg(
        F.min(F.struct((-F.col("n")).alias("m"), F.col(value))).alias("s"), F.sum("n").alias("all")
    )
    return best.select(group, F.col(f"s.{value}").alias("mode"), half_even(ratio(-F.col("s.m"), F.col("all")), 6).alias("share"))


def first_row(df: DataFrame, key: str, pos: str, columns: list[str]) -> DataFrame:
    """Values of the earliest row per key, by a foldable aggregate instead of a sort."""
    return df.groupBy(key).agg(F.min(pos).alias(pos), *[F.min_by(c, pos).alias(c) for c in columns])


def last_row(df: DataFrame, key: str, pos: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max(pos).alias(pos), *[F.max_by(c, pos).alias(c) for c in columns])


def increasing_along(df: DataFrame, value: str, order: str) -> Column | DataFrame:
    """Is the value strictly increasing along the order. For small summary tables."""
    w = Window.orderBy(order)
    before = F.lag(value).over(w)
    return df.select((F.col(value) > before).alias("_up"), before.isNull().alias("_first")).agg(
        F.bool_and(F.col("_up") | F.col("_first")).alias("increasing")
    )


def outside_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values that occur but are not allowed."""
    return df.select(column).distinct().filter(~F.col(column).isin(allowed))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("n_shared"))


def coefficient_of_variation(c: str | Column) -> Column:
    return F.stddev_pop(col(c)) / F.when(F.avg(col(c)) > 0, F.avg(col(c)))
