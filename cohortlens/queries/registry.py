"""Where the query modules of this folder register themselves."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ["relational", "aggregates", "nested", "domain", "files", "mentions"]


class Tables:
    """The tables of one folder as DataFrames: ``t.orders`` reads ``orders.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``f(t: Tables) -> DataFrame`` as query ``name`` with its SQL, if it has one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
