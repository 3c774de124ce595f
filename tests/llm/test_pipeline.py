import importlib.util

import corpus_pipeline as cp
from brute_force import brute_components, lower

DATA = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    own = {d: t for d, t in rows.items() if t and any(c.isalpha() for c in t)}
    last = {}
    for d, t in own.items():
        last[lower(t)] = max(d, last.get(lower(t), d))
    own = {d: t for d, t in own.items() if last[lower(t)] == d}
    kept = {d for d, _, c in brute_components(list(own.items())) if c == d}
    out = cp.run(spark, DATA).collect()
    assert {r.doc_id for r in out} == kept
    assert max(r.offset + r.length for r in out) <= 2048


def test_redacted_texts_are_what_is_packed(spark):
    """The ids of the pieces are those of the redacted texts of the kept documents."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from test_llm_operators import brute_spans

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [f"write to a{k}@b.example.com or +1 (269) 555-329{k} about item {k} of the list number {k * 7}" for k in range(6)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], schema)
    out = cp.pack_sequences(spark, cp.redact_personal_data(spark, docs, DATA), DATA).collect()
    names = ["EMAIL", "IP", "CARD", "PHONE"]
    for r in out:
        text = texts[r.doc_id]
        for start, kind, end in sorted(brute_spans(text), reverse=True):
            text = text[:start] + f"[{names[kind]}]" + text[end:]
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    assert len(out) == len(texts)


def test_rows_without_an_id_stay(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one text of five words and more", "en", None, 1), (None, "One text of five words and more", "en", None, 1), (None, "another text that nobody else has", "en", None, 1), (2, "one text of five words and more!", "en", "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    kept = cp.keep_one_of_equals(spark, docs, DATA)
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, rows[2][1]), (1, rows[0][1]), (2, rows[3][1])]
    near = cp.keep_one_of_similar(spark, kept, DATA)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {None, 1, 2}


def test_only_few_texts_are_shuffled(spark):
    """Sets are made of the rows that meet, and rows are dropped, without a shuffle of the texts that stay."""
    from cohortlens.llm import jaccard_join as jj
    from cohortlens.llm.common import where_among

    rows = [(k, f"text {k}") for k in range(500)] + [(None, "no id"), (-7, "negative"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for ids in ([], [7], [-7, 3, 499], list(range(0, 500, 5))):
        wanted = spark.createDataFrame([(k,) for k in ids], "id long")
        may_be, others = where_among(docs, "doc_id", wanted)
        first, rest = [tuple(r) for r in may_be.collect()], [tuple(r) for r in others.collect()]
        assert sorted(first + rest, key=str) == sorted(rows, key=str)
        assert {d for d, _ in first} >= set(ids) and not {d for d, _ in rest} & set(ids)
        assert len(first) <= sum(d in ids for d, _ in rows) + 100
        assert "Exchange" not in may_be._jdf.queryExecution().executedPlan().toString()
        sets = jj._sets(docs, wanted)
        assert {r.doc for r in sets.collect()} >= set(ids)
        assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()
    texts = [(k, f"one two three four five six {'x' if k < 2 else f'{k} {k}a {k}b'}", "en", "s", 1) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.keep_one_of_similar(spark, docs, DATA).collect()} == set(range(300)) - {1}


def test_training_holds_its_table_once():
    """The driver's memory is small; training must not hold its features twice."""
    import random
    import tracemalloc

    from cohortlens.llm import language_id as li

    rng = random.Random(3)
    samples = [(k, lang, " ".join(rng.choice(words) for _ in range(30))) for k in range(60) for lang, words in (("en", ["the", "house", "was"]), ("de", ["das", "haus", "war"]), ("fr", ["la", "maison", "était"]))]
    tracemalloc.start()
    model = li.train(samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 3 * len(samples) * li.BUCKETS * 4
    assert model.predict("das haus war das haus")[1] == "de"


def test_stages_keep_the_columns(spark):
    assert [k for k, _ in cp.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "pii", "packing"]
    docs = spark.createDataFrame([(1, "call +1 (269) 555-3296 now", "en", "s", 26), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.redact_personal_data(spark, docs, DATA)
    assert out.columns == docs.columns
    assert {r.doc_id: r.n_chars for r in out.collect()}[1] == len("call [PHONE] now")


def test_guard():
    assert importlib.util.find_spec("cohortlens.llm.registry")
