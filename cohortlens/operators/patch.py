"""Filling and overwriting cells of one table from another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, or a failure at run time if a key repeats."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"keys {list(keys)} are not unique")
    return df


def _joined(x: DataFrame, y: DataFrame, keys: Sequence[str], check: bool) -> tuple[DataFrame, list[str]]:
    y = assert_unique(y, keys) if check else y
    own = [c for c in y.columns if c not in keys]
    right = y.select(*keys, *[F.col(c).alias(f"_y_{c}") for c in own], F.lit(True).alias("_matched"))
    return x.join(right, list(keys), "left"), own


def rows_patch(x: DataFrame, y: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Null cells of ``x`` filled from ``y``, column by column; keys of ``y`` are unique."""
    both, own = _joined(x, y, keys, check)
    return both.select(*[F.coalesce(F.col(c), F.col(f"_y_{c}")).alias(c) if c in own else F.col(c) for c in x.columns])


def rows_update(x: DataFrame, y: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Cells of matched rows overwritten, also by null."""
    both, own = _joined(x, y, keys, check)
    return both.select(*[F.when(F.col("_matched"), F.col(f"_y_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in x.columns])


def rows_append(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.unionByName(y)
