"""Joins beyond keys: intervals, contained terms, near strings, concepts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def natural_join(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """On all shared columns, in the order of ``a``."""
    return a.join(b, [c for c in a.columns if c in set(b.columns)], how)


def interval_join(facts: DataFrame, ranges: DataFrame, group: str, value: str, lo: str = "lo", hi: str = "hi", width: float = 10.0, how: str = "left") -> DataFrame:
    """Rows of ``facts`` with every range of their group that holds their value, both ends included.

    Ranges are cut into cells of ``width``, so that the join is by equality of group and cell and stays one
    when ranges are many; a value has one cell, so no pair comes twice.
    """
    cells = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    cut = small(ranges.where(F.col(lo) <= F.col(hi)).withColumn("_cell", F.explode(cells)))
    own = facts.withColumn("_cell", F.floor(F.col(value) / width))
    on = (own[group] == cut[group]) & (own["_cell"] == cut["_cell"]) & own[value].between(cut[lo], cut[hi])
    return own.join(cut, on, how).select(*[own[c] for c in facts.columns], *[cut[c] for c in ranges.columns if c != group])


# Rows up to which a dimension table may go to every task.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if it has no more than SMALL rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df.hint("merge")


# Rows of a large table that a task sorts or groups: some hundred megabytes.
ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, which has about so many rows, dealt by its keys to tasks of ROWS rows or less; a few tasks' rows are left to Spark.

    Spark's number of partitions is fixed, or goes by compressed bytes: with either, a task's sorts and hash tables
    grow with the table. Joins and groups by these keys need no other shuffle.
    """
    if rows <= 4 * ROWS:
        return df
    return df.repartition(max(-(-rows // ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def contains_terms(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str = "term", ignore_case: bool = True) -> DataFrame:
    """(key, term) where the text holds the term as whole words.

    The distinct words of a text, without the text, meet the first word of each term; the texts come back
    for the candidates alone, to be checked whole. So the cost follows the words that meet, and no text is
    copied for each of its words.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    tokens = F.filter(F.split(fold(F.col(text)), r"[^\p{L}\p{N}]+", -1), lambda x: x != "")
    words = texts.select(F.col(key), F.explode(F.array_distinct(tokens)).alias("_w"))
    heads = terms.select(F.col(term), F.filter(F.split(fold(F.col(term)), r"[^\p{L}\p{N}]+", -1), lambda x: x != "").alias("_t")).where(F.size("_t") > 0).distinct()
    heads = heads.select(term, F.col("_t")[0].alias("_w"), F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")).alias("_needle"))
    candidates = words.join(small(heads), "_w").groupBy(key).agg(F.collect_set(F.struct(term, "_needle")).alias("_terms"))
    hay = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    both = texts.select(key, hay.alias("_hay")).join(candidates, key)
    return both.select(key, F.explode(F.filter("_terms", lambda x: F.contains(F.col("_hay"), x["_needle"]))).alias("_x")).select(key, F.col(f"_x.{term}").alias(term)).distinct()


def near_pairs(a: DataFrame, b: DataFrame, value: str, limit: int = 2) -> DataFrame:
    """Pairs (left, right, d) of different strings within an edit distance, 0 < d <= limit.

    Two strings within ``limit`` edits, cut into limit + 1 pieces by length, share a piece at nearly the same
    place: pieces of one are looked up among substrings of the other, so no all-pairs join is made.
    """
    k = limit + 1
    v = F.col(value)
    n = F.length(v)
    left = a.select(v.alias("left"), n.alias("ln")).distinct()
    pieces = left.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    ls = F.greatest(F.lit(1), F.floor(F.col("ln") / k)).cast("int")
    pieces = pieces.select("left", "ln", "_i", (F.col("_i") * ls + 1).alias("_at"), F.when(F.col("_i") == k - 1, F.greatest(F.lit(0), F.col("ln") - F.col("_i") * ls)).otherwise(ls).alias("_len"))
    pieces = pieces.select("left", "ln", "_at", "_len", F.substring(F.col("left"), F.col("_at"), F.col("_len")).alias("_p"))
    right = b.select(v.alias("right"), n.alias("rn")).distinct()
    shape = pieces.select("ln", "_at", "_len").distinct()
    lengths = right.select("rn").distinct()
    wanted = shape.join(F.broadcast(lengths), F.abs(F.col("ln") - F.col("rn")) <= limit)
    probes = right.join(wanted, "rn").withColumn("_shift", F.explode(F.sequence(F.lit(-limit), F.lit(limit))))
    probes = probes.where((F.col("_at") + F.col("_shift") >= 1) & (F.col("_at") + F.col("_shift") + F.col("_len") - 1 <= F.col("rn")))
    probes = probes.select("right", "ln", "_at", "_len", F.substring(F.col("right"), F.col("_at") + F.col("_shift"), F.col("_len")).alias("_p"))
    found = pieces.join(probes, ["ln", "_at", "_len", "_p"]).where("left <> right").select("left", "right").distinct()
    return found.withColumn("d", F.levenshtein("left", "right", limit)).where("d >= 0")


def concept_codes(terms: DataFrame, concepts: DataFrame, term: str = "term", concept: str = "cui", name: str = "str", code: str = "code") -> DataFrame:
    """term -> codes of any concept that has the term among its names, joined and sorted."""
    names = concepts.select(F.lower(F.trim(name)).alias("_n"), concept).distinct()
    codes = concepts.where(F.col(code).isNotNull()).select(concept, code).distinct()
    hop = terms.select(term).distinct().join(names, F.lower(F.trim(term)) == F.col("_n")).join(codes, concept)
    return hop.groupBy(term).agg(F.array_join(F.array_sort(F.collect_set(code)), ", ").alias("codes"))


def best_cosine(a: DataFrame, b: DataFrame, key: str, vector: str, block: int = 4096) -> DataFrame:
    """b, sim: for each vector of ``b`` its greatest cosine to one of ``a`` with another key.

    Every pair counts, so the work is a product of both sides; it is done as matrix products of blocks, each
    side dealt to as many tasks as the other has blocks, and a task gives one row a vector.
    """
    width = lambda df: max(1, -(-df.count() // block))
    n_a, n_b = width(a), width(b)
    spread = lambda df, own, other, n, m: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.zeros(0)
        ids = right["id"].to_numpy()
        if left.num_rows and right.num_rows:
            x, y = (np.stack(t["v"].to_numpy(zero_copy_only=False)) for t in (left, right))
            x, y = (m / np.sqrt((m * m).sum(1))[:, None] for m in (x, y))
            own = np.where(ids[:, None] == left["id"].to_numpy()[None, :], -np.inf, y @ x.T)
            out = own.max(1)
        found = np.isfinite(out) if len(out) else np.zeros(len(ids), bool)
        return pa.table({"b": pa.array(ids[found], pa.int64()), "sim": pa.array(out[found] if len(out) else np.zeros(0), pa.float64())})

    left, right = spread(a, "i", "j", n_a, n_b), spread(b, "j", "i", n_b, n_a)
    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "b long, sim double")
    return pairs.groupBy("b").agg(F.max("sim").alias("sim"))
