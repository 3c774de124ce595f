"""Running totals with their final points, carried values, top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, by: Sequence[str], date: str, value: str, name: str = "total") -> DataFrame:
    """A group's total up to each of its dates. Dates are summed first, so ties are one row."""
    daily = df.groupBy(*by, date).agg(F.sum(value).alias("_day"))
    frame = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(*by, date, F.sum("_day").over(frame).alias(name))


def add_final_totals(running: DataFrame, by: Sequence[str], date: str, name: str = "total") -> DataFrame:
    """Each group's largest total once more at the last date of all groups, where the group has no row then."""
    last = running.agg(F.max(date).alias("_last"))
    tops = running.groupBy(*by).agg(F.max(name).alias(name), F.max(date).alias("_own"))
    final = tops.join(F.broadcast(last)).where(F.col("_own") < F.col("_last")).select(*by, F.col("_last").alias(date), name)
    return running.unionByName(final)


def add_final_totals_reversed(running: DataFrame, by: Sequence[str], date: str, name: str = "total") -> DataFrame:
    """For axes that run backwards: each group's largest total at the first date, and a zero at the last."""
    ends = running.agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    tops = running.groupBy(*by).agg(F.max(name).alias(name)).join(F.broadcast(ends))
    first = tops.select(*by, F.col("_first").alias(date), name)
    last = tops.select(*by, F.col("_last").alias(date), (F.col(name) * 0).alias(name))
    return running.unionByName(first).unionByName(last)


def fill_up(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Nulls take the next known value of their group."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(value, F.first(value, ignorenulls=True).over(frame))


def top(df: DataFrame, n: int, order: Sequence, by: Sequence[str] = (), ties: bool = True) -> DataFrame:
    """The first n rows of each group in an order, with all that tie with the last or without."""
    if not by and not ties:
        return df.orderBy(*order).limit(n)
    frame = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
    return df.withColumn("_p", (F.rank() if ties else F.row_number()).over(frame)).where(F.col("_p") <= n).drop("_p")
