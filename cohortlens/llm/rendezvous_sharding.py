"""Sharding by weighted rendezvous hashing (operator 4), in DataFrame functions only.

Each shard scores each key with ``-weight / ln(u)``, where u in (0, 1) comes from a hash of key and shard;
the highest score wins. A shard's scores don't depend on the other shards, so one more shard takes rows
only into itself, and rows move in proportion to its weight. The law held is ``key``.

A row's slot in its shard is gapless from 0. Shards may be as many rows as they like: rows are numbered in
blocks of a hash of the key, and a block's first slot is the sum of the blocks before it, so no task
orders a whole shard.

Null keys hash as the word ``null``. Null texts have size 1 (no bytes, plus 1) and the CRC of no bytes.
Repeated keys go to the same shard and get slots of their own. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DIGITS = 3  # 4,096 blocks a shard


def _unit(digest_key: Column, shard: int) -> Column:
    """52 bits of MD5 as a number in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(digest_key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 ..) of a key under these weights; ties go to the smallest shard."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [F.struct((-F.lit(float(w)) / F.ln(_unit(name, s))).alias("score"), F.lit(-s).alias("minus")) for s, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["minus"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    grown = list(grown_weights or [*weights, weights[-1]])
    key = F.col(id_col)
    rows = docs.select(
        key.alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
        F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, BLOCK_DIGITS).alias("_block"),
    )
    # At most 4,096 counts a shard, whatever the rows: small enough to send to all.
    starts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    in_block = Window.partitionBy("shard", "_block").orderBy("_id", "text_crc32", "size")
    return (
        rows.withColumn("_place", F.row_number().over(in_block))
        .join(F.broadcast(starts), ["shard", "_block"])
        .select(
            F.col("_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_start") + F.col("_place") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def op4_rendezvous(spark, sf_dir):
    """Contract query: eight shards of equal weight."""
    from .common import read_table

    return shard(read_table(spark, sf_dir, "documents"), [1.0] * 8)
