"""Queries over the test tables, one or more for each operator, with the SQL that gives the same rows."""

from .registry import QUERIES, SQL, load

load()

__all__ = ["QUERIES", "SQL"]
