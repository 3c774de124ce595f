"""Samples that depend on keys and a seed alone, never on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import sample_key


def sample_n(df: DataFrame, n: int, key: str, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """n rows (of each group), all of a smaller one."""
    order = [sample_key(F.col(key), seed), F.col(key)]
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_p") <= n).drop("_p")


def sample_share(df: DataFrame, p: float, key: str, by: Sequence[str], seed: int = 0) -> DataFrame:
    """floor(p * n) rows of each group of n."""
    own = Window.partitionBy(*by)
    place = F.row_number().over(own.orderBy(sample_key(F.col(key), seed), F.col(key)))
    return df.withColumn("_p", place).withColumn("_n", F.count(F.lit(1)).over(own)).where(F.col("_p") <= F.floor(F.lit(p) * F.col("_n"))).drop("_p", "_n")


def trim_to_n(df: DataFrame, selected: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows: selected ones first, topped up with others."""
    return df.orderBy(F.when(F.col(selected), 0).otherwise(1), sample_key(F.col(key), seed), key).limit(n)


def group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """A fold (0 ..) for each row: groups stay whole, and groups of a like share of labels are dealt in turn."""
    rates = df.groupBy(group).agg(F.round(F.avg(F.col(label).cast("double")) * 4).alias("_rate"))
    deal = Window.partitionBy("_rate").orderBy(sample_key(F.col(group), seed), group)
    folds = rates.withColumn("fold", F.pmod(F.row_number().over(deal) - 1, F.lit(k)).cast("int")).select(group, "fold")
    return df.join(folds, group)


def unseen_share(df: DataFrame, entity: str, key: str, n: int, seeds: int) -> DataFrame:
    """For each seed: the share of entities that a sample of n rows doesn't see. One job for all seeds."""
    runs = df.select(key, entity).crossJoin(F.broadcast(df.sparkSession.range(seeds).withColumnRenamed("id", "seed")))
    order = F.pmod(F.pmod(F.col(key), F.lit(1_000_003)) * F.lit(2_654_435_761) + F.col("seed") * F.lit(40_503), F.lit(4_294_967_296))
    picked = runs.withColumn("_p", F.row_number().over(Window.partitionBy("seed").orderBy(order, key)))
    seen = picked.groupBy("seed").agg(F.countDistinct(F.when(F.col("_p") <= n, F.col(entity))).alias("_seen"), F.countDistinct(entity).alias("_all"))
    return seen.select("seed", (1 - F.col("_seen") / F.col("_all")).alias("unseen"))
