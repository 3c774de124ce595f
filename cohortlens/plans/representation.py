"""Representation of groups over time: category mapping, running totals, trait profiles, burden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import collapse_degenerate, expand_range
from ..functions.semantics import median, quantile
from ..operators.windows import add_final_totals, running_total


def map_category(df: DataFrame, label: str, mapping: DataFrame, name: str = "category", multiple: str = "Multiple") -> DataFrame:
    """Labels through a unique map (source_label, category); others with ``", "`` are ``multiple``, the rest stay."""
    m = mapping.select(F.col("source_label").alias("_l"), F.col("category").alias("_c"))
    both = df.join(m, F.col(label) == F.col("_l"), "left")
    return both.withColumn(name, F.coalesce("_c", F.when(F.contains(label, F.lit(", ")), multiple), label)).drop("_l", "_c")


def valid_counts(df: DataFrame, n: str) -> DataFrame:
    """Neither null nor zero."""
    return df.where((F.col(n) != 0) & F.col(n).isNotNull())


def group_running_totals(df: DataFrame, group: str, date: str, n: str) -> DataFrame:
    """Running totals by group with each group's final total at the last date of all."""
    return add_final_totals(running_total(valid_counts(df, n), [group], date, n, n), [group], date, n)


def trait_profile(df: DataFrame, trait: str, paper: str, n: str, in_group: Column, min_papers: int = 2) -> DataFrame:
    """For traits with more than ``min_papers`` papers: totals, the group's share, and shares over papers that have any of it."""
    own = df.where(F.coalesce(F.col(trait) != "", F.lit(False))).select(trait, paper, F.col(n).cast("double").alias("_n"), F.coalesce(in_group, F.lit(False)).alias("_g"))
    by_paper = own.groupBy(trait, paper).agg(F.sum("_n").alias("_t"), F.sum(F.when(F.col("_g"), F.col("_n"))).alias("_gn"), F.max("_n").alias("_max"), F.bool_or("_g").alias("_any"))
    share = F.when(F.col("_any"), 100.0 * F.col("_gn") / F.col("_t"))
    totals = by_paper.groupBy(trait).agg(
        F.sum("_t").alias("total_n"),
        F.coalesce(F.sum("_gn"), F.lit(0.0)).alias("group_n"),
        F.count(F.lit(1)).alias("n_papers"),
        F.max("_max").alias("max_n"),
        median(F.col("_t")).alias("median_n"),
        median(share).alias("median_share"),
        quantile(share, 0.25).alias("q1_share"),
    )
    return totals.where(F.col("n_papers") > min_papers).withColumn("group_pct", 100.0 * F.col("group_n") / F.col("total_n"))


def unattributed(daly: Column, fraction: Column) -> Column:
    """Burden that no known risk explains; negative fractions count as none."""
    return daly * (1 - F.greatest(F.lit(0.0), fraction))


def combined_fraction(c: Column) -> Column:
    """Aggregate: one minus the product of the complements."""
    return 1 - F.product(1 - c)


def provided_codes(df: DataFrame, trait: str) -> DataFrame:
    """``df`` with code and origin: a code that the trait's own text states, by the first of four ways of writing that gives one.

    The origin is set for every text of such a form, even where no code comes out.
    """
    c = F.col(trait)
    forms = [
        (c.contains("ICD10"), r"ICD10 ([^:]+(?=:)|[^ ]+)"),
        (c.contains("Source of report of"), r"Source of report of\s([A-Z][0-9]{1,2}(?:\.[0-9A-Z]+)?)\b"),
        (c.contains("Union"), r"Union ([A-Z][0-9]{1,2}(?:\.[0-9A-Z]+)?)\b"),
        (c.rlike("ICD(-10)? [A-Z][0-9]"), r"ICD(?:-10|10)?\s*([A-Z][0-9]{1,2}(?:\.[0-9A-Z]+)?)"),
    ]
    codes = [F.when(hit, F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))) for hit, pattern in forms]
    said = forms[0][0] | forms[1][0] | forms[2][0] | forms[3][0]
    return df.withColumns({"code": F.coalesce(*codes), "origin": F.when(said, "Study Provided")})


def descriptor_match(df: DataFrame, key: str, derived: str, declared: str, n: str) -> DataFrame:
    """key, matched, total, agrees: numbers of rows whose derived category is the declared one, against all."""
    out = df.groupBy(key).agg(F.sum(F.when(F.col(derived) == F.col(declared), F.col(n))).alias("matched"), F.sum(n).alias("total"))
    return out.withColumn("agrees", F.coalesce(F.col("matched") == F.col("total"), F.lit(False)))


def normalise_codes(df: DataFrame, code: str, rewrites: DataFrame, descriptions: DataFrame) -> DataFrame:
    """A row for each code of a cell: ranges expanded, (old, new) rewrites applied, with the description of (code, description) if there is one."""
    parts = F.flatten(F.transform(F.split(code, ", "), lambda x: expand_range(collapse_degenerate(x))))
    own = df.withColumn(code, F.explode(parts)).join(rewrites.select(F.col("old").alias(code), "new"), code, "left")
    own = own.withColumn(code, F.coalesce("new", code)).drop("new")
    return own.join(descriptions.select(F.col("code").alias(code), "description"), code, "left").select(*df.columns, "description")
