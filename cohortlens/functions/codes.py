"""Codes of a letter and a number: parsing, ranges, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract

CODE = r"^([A-Z])([0-9]+(\.[0-9]+)?)$"


def letter(c: Column) -> Column:
    return extract(c, CODE, 1)


def number(c: Column) -> Column:
    return extract(c, CODE, 2).try_cast("double")


def collapse_degenerate(c: Column) -> Column:
    """``X-X`` is ``X``."""
    return F.regexp_replace(c, r"^([^-]+)-\1$", "$1")


def expand_range(c: Column) -> Column:
    """``K70-K77`` as its codes, ``N18.3-N18.9`` in tenths; anything else as it is."""
    first, last = F.regexp_extract(c, r"^([A-Z][0-9.]+)-", 1), F.regexp_extract(c, r"-([A-Z][0-9.]+)$", 1)
    whole = c.rlike(r"^([A-Z])[0-9]{2}-\1[0-9]{2}$")
    tenths = c.rlike(r"^([A-Z][0-9]{2})(\.[0-9])?-\1\.[0-9]$")
    lo, hi = F.substring(first, 2, 2).try_cast("int"), F.substring(last, 2, 2).try_cast("int")
    lot = F.coalesce(F.regexp_extract(first, r"\.([0-9])$", 1).try_cast("int"), F.lit(0))
    hit = F.regexp_extract(last, r"\.([0-9])$", 1).try_cast("int")
    codes = F.transform(F.sequence(lo, hi), lambda k: F.concat(F.substring(first, 1, 1), F.lpad(k.cast("string"), 2, "0")))
    parts = F.transform(F.sequence(lot, hit), lambda k: F.concat(F.substring(first, 1, 3), F.lit("."), k.cast("string")))
    return F.when(whole & (lo <= hi), codes).when(tenths & (lot <= hit), parts).otherwise(F.array(c))


def leading_count(c: Column) -> Column:
    """``1,234 European cases`` -> 1234; null without a number at the start."""
    return F.replace(extract(c, r"^\s*([0-9][0-9,]*)", 1), F.lit(","), F.lit("")).try_cast("long")


def all_counts(c: Column) -> Column:
    """Sum of all numbers of a text; null without any."""
    numbers = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"[0-9]+"), F.lit(0))
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x.try_cast("long")))
