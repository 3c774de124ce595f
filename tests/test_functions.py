import pytest
from pyspark.sql import functions as F

from cohortlens.functions import codes, semantics as sem, text, vectors


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column.alias("x")).first()["x"]


def test_membership_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "s string")
    assert {r.s for r in df.where(sem.not_in(F.col("s"), ["a"])).collect()} == {None, "b"}
    assert [r.x for r in df.select(sem.is_in(F.col("s"), []).alias("x")).collect()] == [False] * 3


def test_if_else_of_null_is_null(spark):
    assert one(spark, None, sem.if_else(F.col("s") == "a", F.lit(1), F.lit(2))) is None


@pytest.mark.parametrize("s,keep,drop", [("", 1, 0), ("a", 1, 1), ("a|", 2, 1), ("|a", 2, 2), ("a||b", 3, 3)])
def test_splits(spark, s, keep, drop):
    assert len(one(spark, s, sem.split_keep(F.col("s"), r"\|"))) == keep
    assert len(one(spark, s, sem.strsplit(F.col("s"), r"\|"))) == drop


def test_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double")
    assert df.agg(sem.quantile(F.col("x"), 0.25), sem.median(F.col("x"))).first()[:] == (1.75, 2.5)


def test_expand_range(spark):
    expand = codes.expand_range(F.col("s"))
    assert one(spark, "L00-L08", expand) == [f"L0{k}" for k in range(9)]
    assert one(spark, "N18.3-N18.9", expand)[0] == "N18.3" and len(one(spark, "N18.3-N18.9", expand)) == 7
    assert len(one(spark, "C50-C50.9", expand)) == 10
    assert one(spark, "E10", expand) == ["E10"]


def test_text_functions(spark):
    assert one(spark, "no digits", text.extract(F.col("s"), "[0-9]+")) is None
    assert one(spark, "aXbXc", text.replace_first(F.col("s"), "X", "-")) == "a-bXc"
    assert one(spark, "é&amp;ﬁ", text.fold(F.col("s"))) == "e&fi"
    assert [(r["start"], r["end"]) for r in one(spark, "ab1c22", text.locate_all(F.col("s"), "[0-9]+"))] == [(2, 3), (4, 6)]
    assert one(spark, "One e.g. two. Three [12].", text.sentences(F.col("s"))) == ["One e.g. two.", "Three [12]."]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    row = df.select(vectors.normalise(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("z")).alias("c"), vectors.argmax(F.col("a")).alias("k"), vectors.softmax(F.col("a")).alias("s")).first()
    assert row.n == [0.6, 0.8] and row.c is None and row.k == 1 and abs(sum(row.s) - 1) < 1e-12
