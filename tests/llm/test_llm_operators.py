import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import best_fit_packing as bf, inverted_multi_index as imi, language_id as li, merge_dropout as md, pii_bootstrap as pii, rendezvous_sharding as rs, tool_calls as tc
from cohortlens.llm.common import Workspace

SCHEMA = "doc_id long, text string"
DATA = "/root/testdata/sf0.01"


def test_rendezvous(spark):
    rows = [(k, None if k % 9 == 0 else "é" * (k % 5)) for k in range(800)] + [(3, "again"), (None, "x")]
    got = rs.shard(spark.createDataFrame(rows, SCHEMA), [1.0] * 8).collect()
    assert len(got) == len(rows)
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert {r.grown_shard for r in got if r.grown_shard != r.shard} == {8}
    assert all(r.law == "key" for r in got)
    by = Counter((r["size"], r.text_crc32) for r in got)
    assert by == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    heavy = rs.shard(spark.createDataFrame(rows, SCHEMA), [3.0, 1.0]).groupBy("shard").count().collect()
    assert 0.6 < {r.shard: r["count"] for r in heavy}[0] / len(rows) < 0.9
    assert rs.shard(spark.createDataFrame([], SCHEMA), [1.0]).collect() == []


def test_rendezvous_against_brute_force(spark):
    import hashlib

    def unit(key, s):
        return (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    def best(key, weights):
        return max(range(len(weights)), key=lambda s: (-weights[s] / np.log(unit(key, s)), -s))

    rows = [(k, "x" * (k % 7), "clash") for k in range(500)] + [(None, None, None), (4, "x" * 300_000, "long")]
    for weights in ([1.0] * 8, [0.5, 2.0, 1.0]):
        got = rs.shard(spark.createDataFrame(rows, "doc_id long, text string, shard string"), weights).collect()
        assert len(got) == len(rows)
        for r in got:
            name = "null" if r.doc_id is None else str(r.doc_id)
            assert (r.shard, r.grown_shard) == (best(name, weights), best(name, [*weights, weights[-1]]))


def test_packing_plan():
    rng = np.random.default_rng(3)
    histogram = Counter(int(x) for x in np.minimum(256, rng.lognormal(4, 1, 60_000) + 1))
    plan = bf.plan_packing(histogram, 256)
    got = Counter()
    for n, config in plan:
        assert sum(k * m for k, m in config.items()) <= 256
        for k, m in config.items():
            got[k] += n * m
    assert got == histogram
    least = sum(k * n for k, n in histogram.items()) / 256
    assert sum(n for n, _ in plan) <= 1.005 * least + 1
    assert bf.plan_packing({}, 256) == []
    assert bf.plan_packing({256: 3, 1: 0}, 256) == [(3, Counter({256: 1}))]


def fewest(items, capacity):
    """By trying all: sequences that the items need."""
    best = [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= items[k]}):
            i = rooms.index(r)
            place(k + 1, rooms[:i] + [r - items[k]] + rooms[i + 1 :])
        place(k + 1, rooms + [capacity - items[k]])

    place(0, [])
    return best[0]


def test_packing_small_instances():
    rng = random.Random(9)
    over = 0
    for _ in range(120):
        items = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 11))), reverse=True)
        histogram, least = Counter(items), fewest(items, 30)
        plan = bf.plan_packing(histogram, 30)
        got = Counter()
        for n, config in plan:
            assert sum(k * m for k, m in config.items()) <= 30
            got += Counter({k: m * n for k, m in config.items()})
        assert got == histogram
        _, bound = bf.solve_configurations({k: n for k, n in histogram.items() if k < 30}, 30)
        assert np.ceil(bound - 1e-9) + histogram[30] <= least <= sum(n for n, _ in plan)
        alone = sum(bf.best_fit(histogram, 30).values())
        assert sum(n for n, _ in plan) <= alone
        rooms = []  # best fit by hand
        for x in items:
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 30) - x)
        assert alone == len(rooms)
        over += sum(n for n, _ in plan) - least
    assert over <= 3


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["the", "Äther", "42", "\n\n", "it's", "<|endoftext|>", "  x", "漢字😀"]) for _ in range(rng.randint(0, 90)))) for k in range(150)]
    rows += [(900, None), (901, ""), (902, "word " * 500), (7, rows[7][1])]
    out = bf.pack_documents(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 64, with_ids=True).collect()
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in rows}
    places = {}
    for r in out:
        assert r.ids == want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        assert r.length == 64 or r.piece == 0
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(len(want[d]) for d, _ in rows)
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64


def test_merge_dropout(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ["".join(rng.choice(" ab\té\x00漢😀\n  theing") for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["", "a" * 3000, "▁x ▁▁"]
    plain, varied = md.Codec(path, 0.0, 1), md.Codec(path, 0.3, 1)
    for k, t in enumerate(texts):
        assert "▁" in t or plain.encode(t, k) == model.encode(t)
        assert varied.decode(varied.encode(t, k)) == t
    words = "there is nothing interesting here"
    assert len({tuple(varied.encode(words, k)) for k in range(40)}) > 1
    for chunk in ("▁interesting", "▁▁there", "abcabcab"):
        assert varied._merge_short(chunk, 1) == varied._merge_long(chunk, 1)
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    back = md.decode(md.encode(df, path, 0.2), path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, t or "") for d, t in rows)
    assert all(r.lossless for r in md.round_trip(df, path).collect())


def test_merge_dropout_by_occurrence(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec = md.Codec(path, 0.1, 1)
    word = "interesting"
    plain = tuple(md.Codec(path, 0.0, 1).encode(word, 0))
    own = [tuple(codec.encode(word, k)) for k in range(4000)]
    assert len(set(own)) > 6  # by document
    rng = random.Random(3)
    drawn = [codec.piece_ids(codec._merge_short("▁" + word, sum(1 << k for k in range(60) if rng.random() < 0.1))[0]) for _ in range(4000)]
    assert abs(own.count(plain) - drawn.count(plain)) < 200  # a draw for each candidate
    text = " ".join(rng.choice([word, "the", "x" * 40, "nothing"]) for _ in range(800))
    ids = codec.encode(text, 7)
    assert len({codec.decode(ids)}) == 1 and codec.decode(ids) == text
    cold = md.Codec(path, 0.1, 1)
    monkeypatch.setattr(md, "CACHED", 3)
    monkeypatch.setattr(md, "CACHED_SKIPS", 5)
    assert cold.encode(text, 7) == ids != codec.encode(text, 8)  # caches change nothing
    pieces = []  # each occurrence by hand, all its skips from the draws
    key = md._mix((md._mix((codec.seed * md._SKIP + 1) & md._WORD) + 7 * md._PLACE) & md._WORD)
    forms = set()
    for place, w in enumerate(text.split(" ")):
        got = codec._merge_heap("▁" + w, codec.skip_places(key, place, codec.next_gap(key, place, 0)))[0]
        pieces += codec.piece_ids(got)
        forms |= {tuple(got)} if w == word else set()
    assert pieces == ids and len(forms) > 2  # by place in a document
    every = md.Codec(path, 1.0, 1)
    assert every._merge_heap("▁the", every.skip_places(key, 0, every.next_gap(key, 0, 0)))[0] == list("▁the")
    for skips in range(64):
        assert codec._merge_short("▁interesting", skips) == codec._merge_long("▁interesting", skips)


def test_merge_dropout_in_arrays(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(5)
    words = ["interesting", "internationalization", "x" * 40, "the", "é", "▁", "漢😀", "", "ab" * 30]
    texts = ["".join(rng.choice(" ab\té\x00漢😀\n  theing▁") for _ in range(rng.randint(0, 80))) for _ in range(100)]
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)] + ["", None, " ", "a " + "ab" * 900, "the " * 300]
    keys = np.array([rng.randrange(-(2**63), 2**63) for _ in texts], np.int64)

    def same(codec, texts, keys):
        arrays, want = md.Arrays(codec), [codec.encode(t or "", k) for t, k in zip(texts, keys.tolist())]
        for _ in range(2):  # the second time from kept words
            ids, ends = arrays.encode(pa.array(texts, pa.string()), keys)
            assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
        return arrays.decode(ids, ends)

    for rate in (0.0, 0.1, 0.5, 1.0):
        assert list(same(md.Codec(path, rate, 1), texts, keys)) == [t or "" for t in texts]
    ids, ends = md.Arrays(md.Codec(path, 0.1, 1)).encode(pa.array([None, ""], pa.string()), keys[:2])
    assert ids.size == 0 and ends.tolist() == [0, 0]
    for seed in range(6):  # pieces with equal scores: leftmost first
        tied = md.Codec(path, 0.2, seed)
        pieces = sorted({"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 4))) for _ in range(60)})
        tied.ids, tied.score = {p: k for k, p in enumerate(pieces)}, {p: float(rng.randint(0, 3)) for p in pieces}
        same(tied, ["".join(rng.choice("aabbc d") for _ in range(200)) for _ in range(20)], keys[:20])
    rows = list(enumerate(texts)) + [(None, "the interesting"), (3, "again")]
    codec = md.Codec(path, 0.1, 1)
    want = Counter((d, zlib.crc32(np.asarray(ids, "<u4").tobytes()), len(ids), True) for d, t in rows for ids in [codec.encode(t or "", d or 0)])
    monkeypatch.setattr(md, "_TOGETHER", 500)
    monkeypatch.setattr(md, "CACHED", 3)
    for k in (0, 1):  # caches and portions change nothing
        batch = pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "text"])
        arrays, got = md.Arrays(codec), []
        for part, own in md._portions(batch):
            assert part.num_rows < len(rows)
            ids, ends = arrays.encode(part.column(1), own)
            got += [(d, zlib.crc32(x), x.size, True) for d, x in zip(part.column(0).to_pylist(), np.split(ids, ends[:-1]))]
        assert Counter(got) == want
        monkeypatch.setattr(md.Codec, "node", None)  # words of tables are not merged one by one
    assert Counter(tuple(r)[:1] + (r.ids_crc32, r.n_tokens, r.lossless) for r in md.round_trip(spark.createDataFrame(rows, SCHEMA), path).collect()) == want
    assert Counter((r.doc_id, zlib.crc32(np.asarray(r.ids, "<u4").tobytes()), len(r.ids), True) for r in md.encode(spark.createDataFrame(rows, SCHEMA), path).collect()) == want
    assert md.round_trip(spark.createDataFrame([], SCHEMA), path).collect() == []


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = li.identify(docs.select("doc_id", "text", "lang"), li.fit(docs, per_language=120)).withColumn("out", li.held_out(F.col("doc_id")))
    right = out.where("out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    odd = spark.createDataFrame([(1, None, None, 5.0), (2, "", "en", 1.0), (3, "123 !?", None, 0.0), (4, "le chat é", "fr", 2.0), (4, "le chat é", "fr", 2.0)], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(odd, li.fit(docs, per_language=120)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and 0 <= got[4][1] <= 1
    assert {r.lang_pred for r in li.identify(odd, None).collect()} == {"und"}


def test_language_clashing_names_and_copies(spark):
    rows = [(k, f"the text number {'abc'[k % 3]} with some words", "en", k, "x") for k in range(60)] + [(5000 + k, "el texto con algunas palabras", "es", k, None) for k in range(60)] + [(9, "le mot", None, 1, "y")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _letters int, salt string")
    out = li.identify(docs, li.fit(docs, per_language=7))
    assert out.columns[:5] == docs.columns and out.count() == len(rows)
    assert {r.lang_pred for r in out.where("lang = 'es'").collect()} == {"es"}
    assert {r.lang_pred for r in out.where("lang = 'en'").collect()} == {"en"}
    empty = docs.limit(0)
    assert li.identify(empty, li.fit(empty)).collect() == []


def test_nearest_far_from_zero():
    rng = np.random.default_rng(2)
    for offset in (0.0, 1e4, 1e8, 1e11):
        v = offset + rng.normal(size=(400, 8))
        ids = rng.permutation(400)
        for r, own, far in imi.nearest(v[:40], v, ids, None, 10):
            d = np.sqrt(((v - v[r]) ** 2).sum(1))
            assert list(own) == list(np.lexsort((ids, d))[:10]) and np.array_equal(far, d[own])


def test_multi_index_far_from_zero(spark):
    rng = np.random.default_rng(6)
    x = 1e8 + np.repeat(rng.normal(size=(20, 8)) * 5, 50, axis=0) + rng.normal(size=(1000, 8))
    rows = [(k, x[k].tolist(), "v") for k in range(1000)]
    got = imi.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string"), F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 1000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        hits += len({int(k) for k in np.argsort(d, kind="stable") if k != q and d[k] <= np.sort(d)[10]} & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 90


def test_multi_index_recall(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16))
    points = (centers[rng.integers(0, 30, 3000)] + 0.2 * rng.normal(size=(3000, 16))).astype(np.float32)
    points[1000:1400] = points[1000]  # one vector of very many rows
    rows = [(k, points[k].tolist()) for k in range(3000)] + [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [1.0, None] + [0.0] * 14), (3400, [])]
    got = imi.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = points.astype(float)
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(k) for k in np.lexsort((np.arange(3000), d)) if k != q][:10]
        own = sorted(found[q])
        assert [r[0] for r in own] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in own)
        hits += len(set(want) & {v for _, v, _ in own})
    assert hits / 300 >= 0.9 and set(found) == set(range(0, 3000, 100))
    few = imi.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>"), F.lit(True)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(0, 1, 1), (1, 1, 0)]
    assert imi.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).collect() == []


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    out = []
    for k, expression in enumerate(BASE):
        for m in re.finditer(expression, t):
            digits = "".join(re.findall("[0-9]", m[0]))
            good = [True, k == 1 and all(int(p) <= 255 for p in m[0].split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("a@.-+ 01259()%b1é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("9" * 100_000 + "@" * 100_000) == []


def test_digest_counts_each_kind(spark):
    """Counts and digest of base spans: none, one of a kind, several kinds in any order, several of one kind."""
    texts = ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+49 30 1234567", "+49 30 1234567 then a@b.co and c@d.org, 1.2.3.4", "1.2.3.4 and 5.6.7.8 of 4111-1111-1111-1111 to +49 30 1234567", "none", "", None]
    got = {r.doc_id: r for r in pii.digest_columns(pii.find(spark.createDataFrame(list(enumerate(texts)), SCHEMA))).collect()}
    for k, t in enumerate(texts):
        spans = brute_spans(t or "")
        assert [got[k][f"n_{name}"] for name in pii.KINDS] == [sum(kind == place for _, kind, _ in spans) for place in range(4)], t
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[kind]}:{s}:{e}" for s, kind, e in spans).encode()).hexdigest(), t


def test_bootstrap_finds_swallowed_entities(spark):
    rng = random.Random(4)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(k, f"text before {phone()} and after") for k in range(30)] + [(100, "both +1 (269) 555-3296 45241322646528 here"), (101, None), (102, "clean text 12 of 2024, v1.2.3"), (103, "")]
    got = {r.doc_id: r for r in pii.digest_columns(pii.find(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(got) == len(rows)
    assert "phone:5:22" in got[100].spans and got[100].n_added >= 1
    assert got[102].spans == got[101].spans == got[103].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert clean[0] == "text before [PHONE] and after" and clean[101] is None and clean[102] == rows[-2][1]
    assert pii.find(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bootstrap_finds_loose_forms(spark):
    rng = random.Random(11)
    digits = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))

    def card():
        while not pii.luhn(c := "4" + digits(15)):
            pass
        return c

    rows = []
    for k in range(40):
        rows += [(len(rows), f"please write to {digits(3)}x@mail{k}.example.com soon"), (len(rows) + 1, f"client address: 10.{k}.{k * 3}.7 was seen"), (len(rows) + 2, f"paid with {card()} last week"), (len(rows) + 3, f"or call me +1 ({rng.randint(200, 999)}) 555-{digits(4)} today")]
    loose = {"email": "ann.b [at] corp dot example.org", "ip": "172[.]16[.]9[.]31", "card": "4111.1111.1111.1111", "phone": "269 555 3296"}
    before = {"email": "write to", "ip": "client address:", "card": "paid with", "phone": "call me"}
    planted = {}
    for kind, entity in loose.items():
        text = f"somebody {before[kind]} {entity} and more"
        start = text.index(entity)
        planted[1000 + len(planted)] = f"{kind}:{start}:{start + len(entity)}"
        rows.append((999 + len(planted), text))
    clean = [(2000 + k, t) for k, t in enumerate(["the figures 269 555 3296 in a table", "meet at noon dot com is no address", "year 2024 12 31 paid with care", "call me later", "v1.2.3 of 10 2024", "4111.1111.1111.1111 alone"])]
    got = {r.doc_id: r for r in pii.digest_columns(pii.find(spark.createDataFrame(rows + clean, SCHEMA))).collect()}
    for doc_id, span in planted.items():
        assert got[doc_id].spans == span, (got[doc_id].spans, span)
    assert all(not got[d].spans for d, _ in clean)
    more = spark.createDataFrame([(d, t, 1, 2) for d, t in rows + clean], "doc_id long, text string, _pii int, kind int")
    assert pii.redact(more).columns == more.columns and pii.redact(more).where("text like '%[PHONE]%'").count() == 41


def test_score_against_brute_force(spark):
    rng = random.Random(5)
    rows, edges, counts = [], [], {}
    for p in range(12):
        pattern = (p % 3, "left", f"a b{p}")
        counts[pattern] = (rng.randint(0, 6), rng.randint(0, 3))
        for seed, n in zip((1, 0), counts[pattern]):
            if n:
                rows.append((None, None, *pattern, None, seed, None, None, n))
        for i in rng.sample(range(15), 4):
            n = rng.randint(1, 3)
            edges.append((pattern, i, n))
            rows.append((1, 2, *pattern, i, 0, 0, 5, n))
    got = pii.score(spark.createDataFrame(rows, pii._HITS), 4, Workspace(spark, "test")).collect()
    want = pii.score_graph(edges, counts, 4)
    assert {(r.kind, r.sort, r.pattern): pytest.approx(r.score, abs=1e-9) for r in got} == want


def test_tool_calls(spark):
    system = '<tools>[{"name":"f","parameters":{"type":"object","required":["x"],"properties":{"x":{"type":"integer"}}}}]</tools>'
    rows = [
        (1, 0, "system", system),
        (1, 1, "assistant", 'hi<tool_call>{"id":"b","name":"f","arguments":{"x":{"$ref":"a"}}}</tool_call><tool_call>{"id":"a","name":"f","arguments":{"x":1.0}}</tool_call>'),
        (1, 2, "tool", '<tool_result>{"id":"a","content":{"b":1,"a":2}}</tool_result>'),
        (1, 3, "tool", '<tool_result>{"id":"zz","content":1}</tool_result>'),
        (2, 0, None, None),
        (2, 1, "assistant", "<tool_call>{bad</tool_call>"),
        (3, 0, "assistant", '<tool_call>{"id":"p","name":"g","arguments":{"y":{"$ref":"q"}}}</tool_call>'),
        (3, 1, "assistant", '<tool_call>{"id":"q","name":"g","arguments":{"y":{"$ref":"p"}}}</tool_call>'),
    ]
    out = tc.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    calls = {(r.conv_id, r.id): r for r in out["calls"].collect()}
    assert calls[1, "a"].level == 0 and calls[1, "a"].linked and calls[1, "a"].valid
    assert calls[1, "b"].level == 1 and not calls[1, "b"].linked and not calls[1, "b"].valid
    assert calls[3, "p"].level == calls[3, "q"].level == -1
    assert [(r.conv_id, r.id) for r in out["orphans"].collect()] == [(1, "zz")]
    messages = {(r.conv_id, r.turn): r for r in out["messages"].collect()}
    assert len(messages) == len(rows)
    assert messages[1, 1].message == '{"content":"hi","role":"assistant","tool_calls":[{"arguments":{"x":1},"id":"a","name":"f"},{"arguments":{"x":{"$ref":"a"}},"id":"b","name":"f"}]}'
    assert messages[2, 0].message == '{"content":null,"role":null}' and messages[2, 1].malformed == 1


def test_tool_calls_odd_input(spark):
    deep = '<tool_call>{"id":"d","name":"f","arguments":' + "[" * 1500 + "]" * 1500 + "}</tool_call>"
    schemas = [{"pattern": "("}, {"minimum": "a"}, {"enum": 5}, {"required": [["x"]]}, {"properties": [1]}, {"multipleOf": 0}]
    system = "<tools>" + json.dumps([{"name": f"s{k}", "parameters": v} for k, v in enumerate(schemas)] + [{"name": "f"}]) + "</tools>"
    values = ["abc", 3, 3, {"a": 1}, {"a": 1}, 3]
    calls = "".join(f'<tool_call>{json.dumps({"id": f"k{k}", "name": f"s{k}", "arguments": v})}</tool_call>' for k, v in enumerate(values))
    rows = [
        (1, 0, "system", system, "m"),
        (1, 1, "assistant", deep, "m"),
        (1, 2, "assistant", r'<tool_call>{"id":"u","name":"f","arguments":{"x":"\ud800"}}</tool_call>', None),
        (1, 3, "assistant", calls, None),
        (1, 5, "assistant", '<tool_call>{"id":"a","name":"f","arguments":{}}</tool_call>', "A"),
        (1, 5, "assistant", '<tool_call>{"id":"b","name":"f","arguments":{}}</tool_call>', "B"),
        (1, 6, "assistant", '<tool_call>{"id":"b","name":"f","arguments":{}}</tool_call>', "again"),
        (None, None, "assistant", '<tool_call>{"id":"n","name":"f","arguments":{}}</tool_call>', None),
        (2, 0, "user", "long " * 100_000, None),
    ]
    schema = "conv_id long, turn long, role string, text string, message string"
    out = tc.link(spark.createDataFrame(rows + rows[4:5], schema))
    messages = out["messages"].collect()
    assert len(messages) == len(rows)
    own = {(r.conv_id, r.turn, r.message): r for r in messages}
    at5 = sorted(m for c, t, m in own if (c, t) == (1, 5))
    assert len(at5) == 2 and '"id":"a"' in at5[0] and '"id":"b"' not in at5[0]
    by = {(r.conv_id, r.turn): r for r in messages}
    assert by[1, 1].malformed == 1 and by[1, 1].n_calls == 0
    assert "\\ud800" in by[1, 2].message
    found = {r.id: r for r in out["calls"].where("not duplicate").collect()}
    assert all(found[f"k{k}"].errors == "bad_schema" and not found[f"k{k}"].valid for k in range(6))
    assert out["calls"].where("id = 'b' and duplicate").count() == 1
    empty = tc.link(spark.createDataFrame([], schema))
    assert all(df.collect() == [] for df in empty.values())


@pytest.mark.parametrize("value,schema,good", [(4, {"anyOf": [{"type": "string"}, {"multipleOf": 2}]}, True), (5, {"multipleOf": 2}, False), ({"a": {"a": {}}}, {"$ref": "#/$defs/t", "$defs": {"t": {"properties": {"a": {"$ref": "#/$defs/t"}}, "additionalProperties": False}}}, True), ({"a": {"b": 1}}, {"$ref": "#/$defs/t", "$defs": {"t": {"properties": {"a": {"$ref": "#/$defs/t"}}, "additionalProperties": False}}}, False), (1, {"not": {"type": "integer"}}, False), (1, {"oneOf": [{"type": "integer"}, {"type": "number"}]}, False), (1.0, {"enum": [1]}, True), (True, {"enum": [1]}, False)])
def test_validate_combined(value, schema, good):
    assert (not tc.validate(value, schema)) == good


def test_tool_calls_long_chains(spark):
    call = lambda ident, *refs: (1, int(ident[1:]), "assistant", f'<tool_call>{{"id":"{ident}","name":"f","arguments":{{"x":[' + ",".join(f'{{"$ref":"{r}"}}' for r in refs) + "]}}</tool_call>")
    n = 1300
    rows = [call("c0")] + [call(f"c{k}", f"c{k - 1}") for k in range(1, n)]
    rows += [call("m2000", "c5", f"c{n - 1}"), call("m2001", "m2000"), call("m2002", "m2001", "c0", "nowhere"), call("m2003", "m2002", "m2000")]
    rows += [call("p3000", "p3001"), call("p3001", "p3000"), call("p3002", "p3001"), call("p3003", "p3003"), call("p3004", "c1", "p3002"), call("p3005", "p3004")]
    got = {r.id: r.level for r in tc.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))["calls"].collect()}
    want = {f"c{k}": k for k in range(n)} | {"m2000": n, "m2001": n + 1, "m2002": n + 2, "m2003": n + 3} | {f"p{k}": -1 for k in range(3000, 3006)}
    assert got == want


@pytest.mark.parametrize("value,schema,errors", [({"x": 1}, {"type": "object", "additionalProperties": False}, 1), ([1, "a"], {"items": {"type": "number"}}, 1), (True, {"type": "integer"}, 1), ("ab", {"pattern": "^a", "maxLength": 2}, 0), (None, {"type": ["string", "null"]}, 0), (5, {"minimum": 6}, 1)])
def test_validate(value, schema, errors):
    assert len(tc.validate(value, schema)) == errors
