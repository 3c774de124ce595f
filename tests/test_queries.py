import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortlens.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import os

    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def values(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if v is None or v != v else f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([[plain(r[k]) for k in order] for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert values(df.columns, df.collect()) == values(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["B3_group_totals", "B4_running_total_by_group", "B6_trait_profile", "B7_trait_correlations"])
def test_large_tables_are_dealt_to_more_tasks(spark, duck, name, monkeypatch):
    """Tasks grow in number with the table, not in rows, and the results stay."""
    from cohortlens.operators import joins
    from cohortlens.queries.domain import facts
    from cohortlens.queries.registry import Tables

    monkeypatch.setattr(joins, "ROWS", 200)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else tables this small are not shuffled at all
    try:
        most = facts(Tables(spark, DATA)).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert most <= 3 * 200
    df, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    assert values(df.columns, df.collect()) == values(want.columns, want.fetchall())


def test_pairs_are_dealt_to_more_tasks(spark, duck, monkeypatch):
    from cohortlens.operators import joins

    monkeypatch.setattr(joins, "ROWS", 200)
    df, want = QUERIES["E7_cocitation"](spark, DATA), duck.sql(SQL["E7_cocitation"])
    assert df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 3 * 200
    assert values(df.columns, df.collect()) == values(want.columns, want.fetchall())
