import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import joins, patch, reshape, sampling, stats, windows
from cohortlens.operators.resolve import entity_groups
from cohortlens.plans import documents, labels


def test_patch_fills_cell_by_cell_and_refuses_repeated_keys(spark):
    x = spark.createDataFrame([(1, None, "o"), (2, "c", None), (3, None, None)], "k int, code string, origin string")
    y = spark.createDataFrame([(1, "p", "q"), (2, "r", "s")], "k int, code string, origin string")
    once = patch.rows_patch(x, y, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "p", "o"), (2, "c", "s"), (3, None, None)]
    assert sorted(map(tuple, patch.rows_patch(once, y, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    with pytest.raises(ValueError):
        patch.rows_patch(x, y.union(y), ["k"])


def test_update_overwrites_with_null(spark):
    x = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    y = spark.createDataFrame([(1, None)], "k int, v string")
    assert sorted(map(tuple, patch.rows_update(x, y, ["k"]).collect())) == [(1, None), (2, "b")]


def test_interval_join_keeps_unmatched_and_both_ends(spark):
    facts = spark.createDataFrame([(1, "E", 10.2), (2, "Z", 99.0), (3, "E", 14.0), (4, "E", 10.0)], "id int, letter string, num double")
    ranges = spark.createDataFrame([("E", 10.0, 14.0, "x"), ("E", 10.1, 11.0, "y")], "letter string, lo double, hi double, cause string")
    got = sorted((r.id, r.cause or "") for r in joins.interval_join(facts, ranges, "letter", "num").collect())
    assert got == [(1, "x"), (1, "y"), (2, ""), (3, "x"), (4, "x")]


def test_rules_see_earlier_output():
    assert reshape.rollup_fixpoint([(1, "A", "B"), (2, "B", "C")]) == {"A": "C", "B": "C"}
    assert reshape.rollup_fixpoint([(1, "B", "C"), (2, "A", "B")]) == {"B": "C", "A": "B"}


def test_recode(spark):
    df = spark.createDataFrame([(1, "a, b"), (2, "a"), (3, "z, a, q"), (4, "z"), (5, None)], "k int, cell string")
    m = spark.createDataFrame([("a", "A"), ("a, b", "whole"), ("z", None)], "term string, new_term string")
    assert dict(map(tuple, reshape.recode_cells(df, "k", "cell", m).collect())) == {1: "whole", 2: "A", 3: "A, q", 4: None, 5: None}


def test_paired_split_minds_brackets(spark):
    df = spark.createDataFrame([("a (b, c), d", "1, 2"), (None, None)], "x string, y string")
    got = reshape.separate_longer_paired(df, "x", "y").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a (b, c)", "1"), ("d", "2"), (None, None)], key=str)


def test_spearman_against_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (4.0, 9.0), (None, 1.0)], "x double, y double")
    row = stats.spearman(df, "x", "y").first()
    assert row.n == 4 and abs(row.rho - 0.8333333333) < 1e-6


def test_running_total_is_independent_of_order(spark):
    rows = [("a", 1, 2.0), ("a", 1, 3.0), ("b", 2, 1.0), ("a", 3, 1.0)]
    want = [("a", 1, 5.0), ("a", 3, 6.0), ("b", 2, 1.0), ("b", 3, 1.0)]
    for _ in range(2):
        random.shuffle(rows)
        run = windows.running_total(spark.createDataFrame(rows, "g string, d int, n double"), ["g"], "d", "n")
        assert sorted(map(tuple, windows.add_final_totals(run, ["g"], "d").collect())) == want


def test_samples_are_independent_of_partitions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("g"))
    a = {r.id for r in sampling.sample_share(df.repartition(1), 0.3, "id", ["g"]).collect()}
    b = {r.id for r in sampling.sample_share(df.repartition(9), 0.3, "id", ["g"]).collect()}
    assert a == b


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "w string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in words for b in words if a != b and distance(a, b) <= 2 and min(len(a), len(b)) > 2}
    got = {(r.left, r.right) for r in joins.near_pairs(df, df, "w").collect() if min(len(r.left), len(r.right)) > 2}
    assert got == want


def test_entities_connect_across_fields_but_not_by_blanks(spark):
    rows = [(1, "A", None, ""), (2, "x", "a ", None), (3, "q", None, "X"), (4, None, "", None), (5, None, None, " ")]
    df = spark.createDataFrame(rows, "r int, cohort string, full_name string, synonyms string")
    got = {r.r: r.group_id for r in entity_groups(df, "r", ["cohort", "full_name", "synonyms"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_bio_round_trip(spark):
    tokens = spark.createDataFrame([(1, k, 3 * k, 3 * k + 2) for k in range(5)], "doc_id int, pos int, start int, end int")
    spans = spark.createDataFrame([(1, 0, 5, "X"), (1, 6, 8, "X"), (1, 12, 14, "Y")], "doc_id int, s int, e int, tag string")
    own = labels.bio_decode(labels.bio_align(tokens, spans))
    assert sorted((r.tag, r.first_pos, r.last_pos) for r in own.collect()) == [("X", 0, 1), ("X", 2, 2), ("Y", 4, 4)]


def test_documents():
    parts = documents.parse_sections("<h1>T</h1><p>a<script>x</script> b</p><nav>no</nav><h2>U &amp; V</h2>c")
    assert [(s["level"], s["title"], s["text"]) for s in parts] == [(1, "T", "a b"), (2, "U & V", "c")]
    assert documents.parse_sections(None) == []
    assert documents.repair_sentences(["One", ".", "and two.", "Open (a", "b) end.", "orange is not a conjunction"]) == ["One. and two.", "Open (a b) end.", "orange is not a conjunction"]
    text = " ".join(f"w{k}" for k in range(1000))
    assert [len(c.split()) for c in documents.chunk(text, 400)] == [400, 400, 200]


def test_arg_max_takes_the_least_key_of_tied_rows(spark):
    rows = [(1, 5, 2.0), (1, 3, 2.0), (1, 9, 2.0), (1, 1, 1.0), (2, None, 9.0), (2, 7, 4.0), (2, 6, None), (3, 8, None), (4, -5, -1.0), (4, -7, -1.0)]
    for _ in range(3):
        random.shuffle(rows)
        df = spark.createDataFrame(rows, "g int, k long, v double").repartition(3)
        assert {r.g: r.k for r in df.groupBy("g").agg(stats.arg_max("k", "v").alias("k")).collect()} == {1: 3, 2: 7, 3: None, 4: -7}


def test_chunks_leave_as_they_are_found(spark, monkeypatch):
    """No task holds the results of a whole batch: they leave by FLUSH, as rows, with equal results."""
    from cohortlens.functions import memory

    texts = [None, "", "one", "\n\n".join(" ".join(f"w{k}" for k in range(n)) for n in (300, 200, 900))] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = sorted((k, pos, c) for k, t in enumerate(texts) for pos, c in enumerate(documents.chunk(t)))
    for flush in (1, 1000, 1 << 20):
        monkeypatch.setattr(memory, "FLUSH", flush)
        assert sorted(map(tuple, documents.chunks(df, "doc_id", "text").collect())) == want
    plan = documents.chunks(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_sections_leave_as_they_are_found(spark, monkeypatch):
    from cohortlens.functions import memory

    pages = [None, "", "<p>a</p>", "<h1>T</h1><p>a b</p><h2>U</h2>c<h3>V</h3>"] * 3
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1)
    want = sorted((k, s["pos"], s["level"], s["title"], s["text"]) for k, p in enumerate(pages) for s in documents.parse_sections(p))
    for flush in (1, 200, 1 << 20):
        monkeypatch.setattr(memory, "FLUSH", flush)
        assert sorted(map(tuple, documents.html_sections(df, "page_id", "html").collect())) == want
    assert "ArrowEvalPython" not in documents.html_sections(df, "page_id", "html")._jdf.queryExecution().executedPlan().toString()
