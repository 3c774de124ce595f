import numpy as np
from pyspark.sql import functions as F

from cohortlens.functions import text, vectors
from cohortlens.operators import joins, reshape
from cohortlens.plans import documents as docs, representation as rep


def test_latex_keeps_what_it_says(spark):
    rows = [(1, r"costs $5 for a and $10 for b"), (2, r"\(\log_{10} x^{2}\) and \frac{a}{b}"), (3, r"\text{cFDR}  \left(y\right) \beta {z}"), (4, None)]
    got = dict(map(tuple, spark.createDataFrame(rows, "k int, t string").select("k", text.strip_latex(F.col("t"))).collect()))
    assert got == {1: "costs $5 for a and $10 for b", 2: "log10 x2 and a/b", 3: "cFDR (y) beta z", 4: None}


def test_clean(spark):
    rows = [(1, "2.1 We saw ( A ) . [1, , ] Done (Smith and Lee et al., ) ,, end"), (2, "ﬁne &amp; café [ ] x ( )"), (3, None), (4, "")]
    got = dict(map(tuple, spark.createDataFrame(rows, "k int, t string").select("k", text.clean(F.col("t"))).collect()))
    assert got[2] == "fine & café x" and got[3] is None and got[4] == ""
    assert not got[1].startswith("2.1") and "Smith" not in got[1] and " ." not in got[1]


def test_stated_codes(spark):
    rows = [("ICD10 K76: liver", "K76", True), ("Source of report of K76 (x)", "K76", True), ("Diabetes (Union E10)", "E10", True), ("x ICD-10 J45.1", "J45.1", True), ("Union of parts", None, True), ("asthma", None, False), (None, None, False)]
    got = rep.provided_codes(spark.createDataFrame([(r[0],) for r in rows], "t string"), "t").collect()
    assert [(r.t, r.code, r.origin is not None) for r in got] == rows


def test_accessions_and_numbers(spark):
    df = spark.createDataFrame([(1, "phs000001.v2.p1 and xEGAS1, EGAD00001 JGAD12 PRJNA7 NCT12345678; 1,234 patients, 9 women, n = 56")], "k int, t string")
    got = sorted((r.family, r.accession) for r in docs.accessions(df, ["k"], "t").collect())
    assert got == [("dbgap", "phs000001.v2.p1"), ("ega", "EGAD00001"), ("jgas", "JGAD12"), ("nct", "NCT12345678"), ("prj", "PRJNA7")]
    found = [(r.surface, r.n) for r in docs.numeric_mentions(df, ["k"], "t").collect()]
    assert sorted(found) == [("1,234 patients", 1234), ("n = 56", 56)]


def test_method_sections(spark):
    rows = [(1, 0, "Intro", "a"), (1, 1, "Methods", "b"), (1, 2, "Data", "c"), (1, 3, "Results", "d"), (1, 4, "Statistical methods", "e"), (2, 0, "Intro", "Participants were recruited"), (2, 1, "Results", "participants"), (3, 0, "", "Ann Lee, Bo Wu, Cy Fox, Di Roe, Ed Poe, Flo Ray"), (3, 1, "Letter", "body"), (3, 2, "References", "x")]
    got = sorted((r.k, r.pos, r.priority) for r in docs.method_sections(spark.createDataFrame(rows, "k int, pos int, title string, text string"), "k").collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 4, 1), (2, 0, 2), (3, 1, 3)]


def test_sentences_guard_abbreviations(spark):
    df = spark.createDataFrame([("We saw e.g. cats. Smith et al. did too! See Fig. 2? Yes.",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(text.sentences(F.col("t"))).collect()]
    assert got == [["We saw e.g. cats.", "Smith et al. did too!", "See Fig. 2?", "Yes."], None, []]


def test_contains_terms_plan_carries_no_text_by_word(spark):
    texts = spark.createDataFrame([(1, "Of the people, of"), (2, "off the"), (3, None), (1, "repeated LLC")], "k int, t string")
    terms = spark.createDataFrame([("of the",), ("LLC",), ("...",), (None,)], "term string")
    assert sorted(map(tuple, joins.contains_terms(texts, terms, "k", "t").collect())) == [(1, "LLC"), (1, "of the")]
    short = spark.createDataFrame([("llc",)], "term string")
    assert joins.contains_terms(texts, short, "k", "t", ignore_case=False).collect() == []
    assert docs.dictionary_match(texts, terms, terms, "k", "t").collect()[0].terms == "LLC|of the"


def test_subsets(spark):
    rows = [(1, "a", ["x"]), (1, "b", ["y", "x"]), (1, "c", ["x", "x"]), (2, "d", ["x", "y", "z"]), (1, "e", []), (1, "f", None)]
    got = sorted(map(tuple, reshape.subsets(spark.createDataFrame(rows, "g int, k string, s array<string>"), "g", "k", "s").collect()))
    assert got == [("a", "b"), ("c", "b")]


def test_explained_variance(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) @ np.random.default_rng(2).normal(size=(5, 5))
    got = [r.share for r in vectors.explained_variance(spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>"), "v", 3).orderBy("component").collect()]
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert np.allclose(got, (want / want.sum())[:3])


def test_sentence_repair():
    join = docs.repair_sentences
    assert join(["We saw (see Fig.", "2) it", ".", "and more.", "p", "= 0.05 was", "but", "Not all [15, 16-18]."]) == ["We saw (see Fig. 2) it. and more.", "p = 0.05 was but Not all."]
    assert join(["2.1. Methods here.", "3, 5 Then it ended.12", "He said “yes.", "” Then"]) == ["Methods here.", "3, 5 Then it ended.", "He said “yes. ” Then"]
    assert join(["A (b)", "c went.", " ", ""]) == ["A (b) c went."]
    assert join([]) == []


def test_detect_format(spark):
    rows = [("<?xml version='1.0'?>\n<!DOCTYPE a><j:article x='1'>", "jats"), ("<TEI>", "tei"), ("<collection>", "bioc"), ("<a><b xmlns='http://www.tei-c.org/ns/1.0'/></a>", "tei"), ("<a><passage></a>", "bioc"), ("<a><sec>", "jats"), ("<a><section>", "unknown"), ("text", "unknown"), ("", "unknown"), (None, None)]
    got = spark.createDataFrame(rows, "x string, want string").select("want", docs.detect_format(F.col("x")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
