"""Aggregations: summaries, shares, rank correlation, set combinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import median, quantile


def six_numbers(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """min, q1, median, mean, q3, max and the count of nulls."""
    v = F.col(value).cast("double")
    aggs = [F.min(v).alias("min"), quantile(v, 0.25).alias("q1"), median(v).alias("median"), F.avg(v).alias("mean"), quantile(v, 0.75).alias("q3"), F.max(v).alias("max"), F.count_if(v.isNull()).alias("n_null")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def share(df: DataFrame, by: Sequence[str], weight: Column | None = None, total: str = "n", percent: str = "pct") -> DataFrame:
    """A group's total and its percentage of all."""
    grouped = df.groupBy(*by).agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).alias(total))
    # One row a group stands under the window: the groups are few.
    return grouped.withColumn(percent, 100.0 * F.col(total) / F.sum(total).over(Window.partitionBy(F.lit(1))))


def ranks(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Average ranks: computed on distinct values, so ties cost nothing, then joined back."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn(name, F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(placed, [*by, value])


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation over rows with both values."""
    own = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    both = ranks(ranks(own, "_x", "_rx", by), "_y", "_ry", by)
    aggs = [F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n")]
    return both.groupBy(*by).agg(*aggs) if by else both.agg(*aggs)


def set_combinations(df: DataFrame, item: str, label: str, sep: str = "&") -> DataFrame:
    """How many items belong to exactly each combination of labels, with its degree."""
    sets = df.groupBy(item).agg(F.array_sort(F.collect_set(label)).alias("s"))
    return sets.groupBy(F.array_join("s", sep).alias("combo"), F.size("s").cast("long").alias("degree")).agg(F.count(F.lit(1)).alias("n"))


def set_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of two sets of keys, of their union and intersection, and the share of a that b has."""
    both = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    return both.agg(
        F.count("_a").alias("n_a"),
        F.count("_b").alias("n_b"),
        F.count(F.lit(1)).alias("n_union"),
        F.count_if(F.col("_a") & F.col("_b")).alias("n_both"),
    ).withColumn("pct_a", 100.0 * F.col("n_both") / F.col("n_a"))


def duplicates_under(df: DataFrame, value: str, norm: Column, sep: str = "|") -> DataFrame:
    """Different values that are equal after normalisation."""
    groups = df.select(norm.alias("norm"), F.col(value).alias("v")).where("norm is not null").groupBy("norm").agg(F.array_sort(F.collect_set("v")).alias("s"))
    return groups.where(F.size("s") > 1).select("norm", F.array_join("s", sep).alias("members"), F.size("s").cast("long").alias("n"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal bins from 1; below is 0, from ``hi`` on bins + 1."""
    return df.groupBy(F.width_bucket(F.col(value).cast("double"), F.lit(lo), F.lit(hi), F.lit(bins)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mirror_distinct(c: Column) -> Column:
    """Distinct values, null counting as one."""
    return F.countDistinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def order_of_magnitude(c: Column) -> Column:
    return F.max(F.floor(F.log10(F.abs(c))))


def arg_max(key: str, value: str) -> Column:
    """Aggregate: the integer key of the row with the greatest value, the least key of several such rows; rows with a null in either take no part."""
    known = F.col(key).isNotNull() & F.col(value).isNotNull()
    return F.max_by(key, F.when(known, F.struct(F.col(value), F.bitwise_not(key))))
