"""Columns, delimited cells and nested values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_with(df: DataFrame, f: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[f(c) for c in df.columns])


def rename_any_of(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames those that are there."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def with_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def unite(df: DataFrame, name: str, columns: Sequence[str], sep: str = ", ") -> DataFrame:
    """Columns joined into one, nulls left out."""
    return df.withColumn(name, F.concat_ws(sep, *columns))


def separate_longer(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """A row for each piece; a null cell stays one row."""
    return df.withColumn(column, F.explode_outer(F.split(column, pattern, -1)))


def separate_longer_paired(df: DataFrame, first: str, second: str, pattern: str = r", (?![^()]*\))") -> DataFrame:
    """Two parallel cells at once; delimiters inside brackets don't count. The shorter is filled with nulls."""
    zipped = F.arrays_zip(F.split(first, pattern, -1).alias("a"), F.split(second, pattern, -1).alias("b"))
    rest = [c for c in df.columns if c not in (first, second)]
    pieces = F.when(F.col(first).isNull() & F.col(second).isNull(), None).otherwise(zipped)
    out = df.withColumn("_z", F.explode_outer(pieces))
    return out.select(*rest, F.col("_z")[F.lit("a")].alias(first), F.col("_z")[F.lit("b")].alias(second))


def separate_range(df: DataFrame, column: str, start: str, end: str, sep: str = "-") -> DataFrame:
    """``A-B`` as (A, B), a single value aligned to the end; the start then falls back to it."""
    parts = F.split(column, sep, -1)
    return df.withColumns({end: F.element_at(parts, -1), start: F.when(F.size(parts) > 1, parts[0]).otherwise(parts[0])})


def protect_phrases(c: Column, phrases: Sequence[str], sep: str = ", ", mark: str = "*") -> Column:
    """Delimiters inside known phrases replaced, so that a split leaves the phrases whole; longest first."""
    for p in sorted(phrases, key=lambda p: (-len(p), p)):
        c = F.replace(c, F.lit(p), F.lit(p.replace(sep, mark)))
    return c


def recode_cells(df: DataFrame, key: str, cell: str, mapping: DataFrame, sep: str = ", ") -> DataFrame:
    """Delimited cells through a map (term, new_term): the whole cell if it is a term, else part by part.

    Parts that aren't terms pass; terms mapped to null go; what stays is unique, in order of appearance, and
    a cell of which nothing stays is null. ``key`` identifies rows; the map's terms are unique.
    """
    m = mapping.select(F.col("term").alias("_term"), F.col("new_term").alias("_new"), F.lit(True).alias("_hit"))
    whole = df.join(m, F.col(cell) == F.col("_term"), "left")
    parts = whole.where("_hit is null").select(key, F.posexplode(F.split(cell, sep, -1)).alias("_pos", "_part"))
    mapped = parts.join(m.select("_term", F.col("_new").alias("_pnew"), F.col("_hit").alias("_phit")), F.col("_part") == F.col("_term"), "left")
    kept = mapped.select(key, "_pos", F.when(F.col("_phit"), F.col("_pnew")).otherwise(F.col("_part")).alias("_v")).where("_v is not null")
    joined = kept.groupBy(key).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda x: x["_v"])), sep).alias("_joined"))
    out = whole.join(joined, key, "left")
    return out.select(*[c for c in df.columns if c != cell], F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("_joined")).alias(cell))


def rollup_fixpoint(rules: Sequence[tuple[int, str, str]]) -> dict[str, str]:
    """Ordered rules (step, child, parent) as one map: later steps see what earlier ones made."""
    out: dict[str, str] = {}
    by_step: dict[int, dict[str, str]] = {}
    for step, child, parent in rules:
        by_step.setdefault(step, {})[child] = parent
    for step in sorted(by_step):
        now = by_step[step]
        for child in out:
            out[child] = now.get(out[child], out[child])
        for child, parent in now.items():
            out.setdefault(child, parent)
    return out


def replace_terms(c: Column, mapping: Mapping[str, str], sep: str = ", ") -> Column:
    """Whole terms of a delimited cell through a small map, order kept."""
    if not mapping:
        return c
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.array_join(F.transform(F.split(c, sep, -1), lambda x: F.coalesce(F.try_element_at(table, x), x)), sep)


def subsets(df: DataFrame, group: str, key: str, parts: str) -> DataFrame:
    """(a, b): keys of a group whose set of parts is a proper subset of another's.

    The greater sets are looked up by the smallest part of the lesser, so only sets that share a part meet.
    """
    own = df.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.array_sort(F.array_distinct(parts)).alias("_s"))
    a = own.where(F.size("_s") > 0).select("_g", F.col("_k").alias("a"), F.col("_s").alias("_a"), F.col("_s")[0].alias("_p"))
    b = own.select("_g", F.col("_k").alias("b"), F.col("_s").alias("_b"), F.explode("_s").alias("_p"))
    return a.join(b, ["_g", "_p"]).where((F.size("_a") < F.size("_b")) & (F.size(F.array_except("_a", "_b")) == 0)).select("a", "b")
