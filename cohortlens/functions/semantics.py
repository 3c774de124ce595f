"""Missing values, splitting and ordering as the analytics need them, where SQL's defaults differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_in(c: Column, values: Sequence) -> Column:
    """Membership that is never null: a null value is in no set."""
    return F.coalesce(c.isin(list(values)), F.lit(False)) if values else F.lit(False)


def not_in(c: Column, values: Sequence) -> Column:
    """Keeps nulls, unlike SQL's NOT IN."""
    return ~is_in(c, values)


def if_else(cond: Column, yes, no) -> Column:
    """A null condition gives null."""
    return F.when(cond, yes).when(~cond, no)


def any_known(c: Column) -> Column:
    """Whether any row is true; nulls count as false."""
    return F.bool_or(F.coalesce(c, F.lit(False)))


def all_known(c: Column) -> Column:
    return F.bool_and(F.coalesce(c, F.lit(False)))


def has_content(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strsplit(c: Column, pattern: str) -> Column:
    """No pieces of an empty string, and no trailing empty piece."""
    parts = F.split(c, pattern, -1)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(trimmed)


def split_keep(c: Column, pattern: str) -> Column:
    """One empty piece of an empty string, trailing pieces kept."""
    return F.split(c, pattern, -1)


def flatten_unique(c: Column, sep: str = ", ") -> Column:
    """Aggregate: distinct non-null values in binary order, joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def canonical_cell(c: Column, sep: str = ", ") -> Column:
    """A delimited cell with its parts unique and sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(c, sep, -1))), sep)


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def quantile(c: Column, p: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(c, F.lit(p))


def sample_key(key: Column, seed: int = 0) -> Column:
    """A pseudo-random order that depends on key and seed alone, in arithmetic that every engine has."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(1_000_003)) * F.lit(2_654_435_761) + F.lit(seed) * F.lit(40_503), F.lit(4_294_967_296))
