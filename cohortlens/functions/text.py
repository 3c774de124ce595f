"""String functions with the analytics' meaning of no match, spans and folding."""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null if there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def replace_first(c: Column, pattern: str, by: str) -> Column:
    """Only the first match; ``by`` is literal and ``pattern`` has no groups."""
    at = F.regexp_instr(c, F.lit(pattern))
    found = F.regexp_extract(c, pattern, 0)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(by), F.substring(c, at + F.length(found), F.length(c)))).otherwise(c)


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def count_literal(c: Column, what: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("long")


def locate_all(c: Column, pattern: str) -> Column:
    """All spans of a pattern: array<struct<start, end>>, from 0, end exclusive."""

    def spans(texts: pd.Series) -> pd.Series:
        expression = re.compile(pattern)
        return texts.map(lambda t: None if t is None else [{"start": m.start(), "end": m.end()} for m in expression.finditer(t)])

    return F.pandas_udf(spans, "array<struct<start:int,end:int>>")(c)


def fold(c: Column) -> Column:
    """Entities resolved, NFKC, then letters without their marks."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", unescape(t)))
            return "".join(x for x in plain if not unicodedata.combining(x))

        return texts.map(one)

    return F.pandas_udf(run, "string")(c)


def lcs_distance(a: Column, b: Column) -> Column:
    """Characters outside a longest common subsequence, of both strings."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            row = [0] * (len(y) + 1)
            for p in x:
                diagonal = 0
                for k, q in enumerate(y, 1):
                    diagonal, row[k] = row[k], diagonal + 1 if p == q else max(row[k], row[k - 1])
            return len(x) + len(y) - 2 * row[-1]

        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="Int64")

    return F.pandas_udf(run, "long")(a, b)


# How LaTeX becomes plain text, in order; what it says stays.
LATEX_RULES = [
    (r"\\\(|\\\)", ""),
    (r"\\\[|\\\]", ""),
    (r"\\{1,2}text\{([^}]*)\}", "$1"),
    (r"\\(log|ln|exp|sin|cos|tan)\b", "$1"),
    (r"\^\{([^}]*)\}", "$1"),
    (r"\^(\w)", "$1"),
    (r"_\{([^}]*)\}", "$1"),
    (r"_(\w)", "$1"),
    (r"\\left([(\[|])", "$1"),
    (r"\\right([)\]|])", "$1"),
    (r"\\frac\{([^}]*)\}\{([^}]*)\}", "$1/$2"),
    (r"\\(\w+)", "$1"),
    (r"[{}]", ""),
    (r"  +", " "),
]
# Traces of layout and citations in extracted text, in order.
CLEAN_RULES = [
    (r"\s+", " "),
    (r"^ | $", ""),
    (r"^(\d+\.)+\d*\s*", ""),
    (r"\.\s+(\d+\.)+\d*\s+", ". "),
    (r"([,;.])\s*([,;.])", "$2"),
    (r"\s+([,;.])", "$1"),
    (r"\([A-Z][a-zA-Z\s&,;.]+et al[,;\s.]*\)", ""),
    (r"\[\s*[,;–—\-\s]*\s*\]", ""),
    (r"\(\s*[,;–—\-\s]*\s*\)", ""),
    (r"\s+", " "),
    (r"^ | $", ""),
    (r"[,;]\s*[–—\-]\s*[,;.]", "."),
    (r"[,;]\s*[–—\-]\s*$", "."),
    (r"[–—\-]\s*[,;.]", "."),
    (r"\(\s+", "("),
    (r"\s+\)", ")"),
    (r"\[\s+", "["),
    (r"\s+\]", "]"),
    (r"\s+([,;.:!?])", "$1"),
    (r"\s+", " "),
    (r"^ | $", ""),
    (r"\.{2,}", "."),
    (r",{2,}", ","),
]


def apply_rules(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def rules_sql(c: str, rules: list[tuple[str, str]], trim: bool = False) -> str:
    """The same rules as SQL."""
    for pattern, by in rules:
        own = by.replace("$", "\\")
        c = f"regexp_replace({c}, '{pattern}', '{own}', 'g')"
    return f"trim({c})" if trim else c


def strip_latex(c: Column) -> Column:
    """Plain text of formulas: commands and braces go, what they hold stays; a fraction is a/b."""
    return F.trim(apply_rules(c, LATEX_RULES))


def plain(c: Column) -> Column:
    """NFKC, then entities as their characters."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unescape(unicodedata.normalize("NFKC", t)).replace("\xa0", " "))

    # Only what such a change could touch leaves the JVM.
    return F.when(c.rlike(r"[^\x00-\x7F]|&"), F.pandas_udf(run, "string")(c)).otherwise(c)


def clean(c: Column) -> Column:
    """Extracted text without section numbers, citations and what they leave of punctuation and brackets."""
    return F.trim(apply_rules(plain(c), CLEAN_RULES))


def sentences(c: Column) -> Column:
    """Pieces that end with . ! or ? before white space, but not after common abbreviations."""
    guarded = r"(?<!\be\.g\.)(?<!\bi\.e\.)(?<!\bal\.)(?<!\bFig\.)(?<!\bvs\.)(?<=[.!?])\s+"
    return F.filter(F.transform(F.split(c, guarded, -1), lambda x: F.trim(x)), lambda x: x != "")
