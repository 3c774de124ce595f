"""Exact deduplication by sorting contents (operator 2), in DataFrame functions only.

Sampled splitters range-partition the rows by their normalised bytes (a short head and a digest of the
whole text, so that what is sampled stays small), an external sort puts equal texts side by side, and a
full comparison of neighbours finds the runs of equal texts.

A text that holds more rows than a partition should (``heavy_share`` of one partition's even share) is
dealt to several partitions by a salt; its runs, at most one for each salt, are joined again by SHA-256.
The list of such texts is bounded: no more than ``partitions / heavy_share`` texts can be that frequent.

Null texts count as empty, and all empty texts are equal. A null id stays only where no other is. Rows with the same id and text are one group
with a row each. Extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, partitions

HEAD = 24


_KEY = ["_head", "_digest", "_salt"]
_BEST = {"smallest": F.min, "largest": F.max}


def _sorted_runs(docs: DataFrame, work: Workspace, id_col: str, text_col: str, heavy_share: float, salts: int | None, carried: list[str]) -> DataFrame:
    """Rows in content order: _id, _row (the columns carried), _text, _heavy, the key, and _run, the number of the run of equal texts within the key."""
    parts = partitions(docs.sparkSession)
    salts = salts or parts
    normal = lambda text: ascii_lower(F.coalesce(text.cast("string"), F.lit("")))
    own = normal(F.col(text_col))
    base = docs.select(F.col(id_col).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"), F.xxhash64(own).alias("_digest"), F.substring(own.cast("binary"), 1, HEAD).alias("_head"))

    # Which texts are too frequent for one partition: counts of 8-byte digests, combined before the shuffle.
    counts = work.keep(base.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "counts")
    limit = max(100.0, heavy_share * docs.count() / parts)
    heavy = counts.where(F.col("_n") > limit).select("_digest", F.lit(True).alias("_heavy"))

    dealt = (
        base.join(F.broadcast(heavy), "_digest", "left")
        .withColumn("_heavy", F.coalesce("_heavy", F.lit(False)))
        .withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64("_id"), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
        .repartitionByRange(parts, *_KEY)
        .withColumn("_text", normal(F.col("_row").getField(text_col)))
    )
    by_content = Window.partitionBy(*_KEY).orderBy("_text", "_id")
    # The first row of a key has no neighbour before it.
    same = F.coalesce(F.col("_text") == F.lag("_text").over(by_content), F.lit(False))
    return dealt.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by_content.rowsBetween(Window.unboundedPreceding, 0)))


def _united(runs: DataFrame, keep: str) -> DataFrame:
    """Runs of the frequent texts, one for each salt, as one group: a row a text, bounded as said above."""
    best = _BEST[keep]
    one = runs.where("_heavy").groupBy("_sha", "_salt").agg(best("_best").alias("_best"), F.max("_size").alias("_size"))
    return one.groupBy("_sha").agg(best("_best").alias("_all_best"), F.sum("_size").alias("_all_size"))


def content_sort(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    heavy_share: float = 0.25,
    salts: int | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep`` says which identifier of a group stays, ``smallest`` or ``largest``. Of rows that repeat that
    identifier within the group, each is marked kept. A null identifier stays only where a group has no other.
    """
    work = Workspace(docs.sparkSession, "content-sort")
    runs = _sorted_runs(docs, work, id_col, text_col, heavy_share, salts, [text_col])
    runs = runs.withColumn("_sha", F.sha2("_text", 256)).select("_id", *_KEY, "_heavy", "_run", "_sha")
    of_run = Window.partitionBy(*_KEY, "_run")
    runs = runs.withColumn("_best", _BEST[keep]("_id").over(of_run)).withColumn("_size", F.count(F.lit(1)).over(of_run))
    runs = work.keep(runs.select("_id", "_heavy", "_sha", "_best", "_size", "_salt"), "runs")

    joined = runs.join(F.broadcast(_united(runs, keep).select("_sha", "_all_best", "_all_size", F.lit(True).alias("_all"))), "_sha", "left")
    out = joined.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_all"), F.col("_all_best")).otherwise(F.col("_best")).alias("keep_id"),
        F.coalesce("_all_size", "_size").cast("long").alias("group_size"),
        F.col("_sha").alias("text_sha256"),
    )
    return out.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    heavy_share: float = 0.25,
    salts: int | None = None,
) -> DataFrame:
    """The rows of ``docs`` that ``content_sort`` marks as kept, with all columns.

    The sort carries the rows, so no text travels twice; all but the kept ones end at the sort.
    """
    work = Workspace(docs.sparkSession, "keep-one")
    runs = _sorted_runs(docs, work, id_col, text_col, heavy_share, salts, docs.columns)
    of_run = Window.partitionBy(*_KEY, "_run")
    runs = runs.withColumn("_best", _BEST[keep]("_id").over(of_run)).where(F.col("_id").eqNullSafe(F.col("_best")))
    sha = F.when(F.col("_heavy"), F.sha2("_text", 256)).alias("_sha")
    kept = work.keep(runs.select("_id", "_row", "_heavy", sha, "_salt", "_best", F.lit(1).alias("_size")), "kept")
    best = _united(kept, keep).select("_sha", "_all_best")
    stays = ~F.col("_heavy") | F.col("_id").eqNullSafe(F.col("_all_best"))
    return kept.join(F.broadcast(best), "_sha", "left").where(stays).select("_row.*")


def op2_content_sort(spark, sf_dir):
    """Contract query: of equal texts, the largest doc_id stays."""
    from .common import read_table

    return content_sort(read_table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
