"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """node and component (its smallest node) for each node of an edge.

    ``keep(df, name)`` writes an intermediate table and reads it back, so that no round's lineage grows and
    lost executors lose nothing. Neighbourhoods are never gathered: a round takes minima by node and joins
    them back. Self-loops and nulls are dropped; repeated edges are harmless; no edges give no rows.
    """
    flat = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    flat = keep(flat.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc0")
    previous = None
    for k in range(max_rounds):
        # Large star: every larger neighbour of u links to the smallest of u and its neighbours.
        both = flat.select("u", "v").unionAll(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours link to the smallest of them.
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        flat = keep(small, f"cc{1 + k % 2}_{k}")
        # A star forest has every node once, under a root: it no longer changes.
        sums = flat.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        state = (sums[0], sums[1])
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = flat.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return flat.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
