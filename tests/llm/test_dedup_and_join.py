import ctypes
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from brute_force import brute_components, lower
from cohortlens.llm import jaccard_join as jj
from cohortlens.llm.common import Workspace
from cohortlens.llm.content_sort_dedup import content_sort, keep_one
from cohortlens.llm.suffix_dedup import remove_repeats, suffix_order

SCHEMA = "doc_id long, text string"


def check_sort(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    got = content_sort(df, keep="largest").collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    most = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
    want = sorted(((d, most[t], len(g), d == most[t], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g), key=str)
    assert sorted(map(tuple, got), key=str) == want
    stay = keep_one(df, keep="largest")
    assert stay.columns == df.columns
    assert sorted(map(tuple, stay.collect()), key=str) == sorted((r for r in rows if r[0] == most[lower(r[1])]), key=str)


def test_content_sort(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["A b", "a B", "É", "é", "", None, "x" * 30 + "1", "x" * 30 + "2", str(rng.random())])) for k in range(300)]
    check_sort(spark, rows)
    check_sort(spark, [])
    check_sort(spark, [(1, "a"), (1, "a"), (2, "b"), (None, "b"), (None, "c"), (None, None)])
    check_sort(spark, [(k, "same") for k in range(2000)] + [(5000, "other")])  # a text for several partitions
    check_sort(spark, [(1, "a" * 200_000, "x", 1), (2, "A" * 200_000, None, 2)], "doc_id long, text string, keep_id string, _text int")


def near_rows(seed, n=240):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 4, 6, 8, 12, 20, 40, 90, 300]))]
        if rng.random() < 0.3:
            base = base[:40] + passage
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = w[: max(1, int(len(w) * rng.uniform(0.7, 1)))]
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else "\t".join(w)))
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, "é è"), (9005, "É È")]


@pytest.mark.parametrize("seed,boundary", [(1, None), (2, 2), (3, 30)])
def test_jaccard_join(spark, seed, boundary):
    rows = near_rows(seed)
    got = jj.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), boundary=boundary)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)


def test_jaccard_join_edges(spark):
    assert jj.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jj.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, -1), (1, 1), (3, 1), (3, 1)]


def test_linked():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(0, 40))).astype(np.uint64) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert jj.linked(a, b) == bool(both and 100 * both >= 75 * (len(a) + len(b) - both))


def test_jaccard_join_of_a_common_passage(spark, monkeypatch):
    """One passage in most documents: whole results, with blocks, chunks and turns."""
    rng = random.Random(8)
    monkeypatch.setattr(jj, "BLOCK", 16)
    passage = [f"p{k}" for k in range(100)]
    rows = []
    for k in range(700):
        own = [f"u{k}_{j}" for j in range(rng.choice([9, 12, 14, 18, 24, 60]))]
        rows.append((k, " ".join(own + passage) if rng.random() < 0.5 else " ".join(passage[: rng.randint(60, 100)] + own)))
    got = jj.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)


def test_few_sets_beside_a_large_group(spark, monkeypatch):
    """Sets that link to some of a large group are found by a sample of it, before all pairs are compared."""
    rng = random.Random(5)
    base = [f"p{k}" for k in range(120)]
    rows = []
    for k in range(400):
        own = list(base)
        for j in rng.sample(range(120), rng.choice([0, 1, 2] if k < 340 else [3, 4, 5])):
            own[j] = f"u{k}_{j}"
        rows.append((k, " ".join(own)))
    monkeypatch.setattr(jj, "WORTH", 1.0)  # one turn of stars leaves much
    compared, links = [], jj._links
    monkeypatch.setattr(jj, "_links", lambda pairs, *rest: compared.append(pairs.count()) or links(pairs, *rest))
    for many in (1e9, 0):
        monkeypatch.setattr(jj, "MANY", many)
        got = jj.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)
    whole, *sampled = compared[1], *compared[3:]
    assert len(sampled) == 3 and sum(sampled) < whole


def test_smallest_reached():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 60, 400):
        for most in (3, 40, 2000):
            src, dst = (rng.integers(-most, most, n) * 1_000_003 for _ in range(2))
            least = {k: k for k in [*src.tolist(), *dst.tolist()]}
            for _ in least:
                for a, b in zip(src.tolist(), dst.tolist()):
                    least[a] = least[b] = min(least[a], least[b])
            nodes, found = jj.smallest_reached(src, dst)
            assert dict(zip(nodes.tolist(), found.tolist())) == least and len(nodes) == len(least)


def test_components_of_few_links_take_few_tasks(spark, monkeypatch):
    """Few links are settled without shuffles, as each of those has a task for every partition; many go through tables, with equal results."""
    rng = random.Random(7)
    links = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "src long, dst long").where("src <> dst")
    tracker = spark.sparkContext.statusTracker()
    tasks, found = {}, {}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for settled in (jj.SETTLED, 10):
        monkeypatch.setattr(jj, "SETTLED", settled)
        keep = Workspace(spark, f"settled{settled}").keep
        for k, v in zip(before, ("30", "false")):
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(f"settled {settled}", "")
        found[settled] = sorted(map(tuple, jj._components(links, keep).collect()))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
        jobs = tracker.getJobIdsForGroup(f"settled {settled}")
        tasks[settled] = sum(s.numCompletedTasks for j in jobs for k in tracker.getJobInfo(j).stageIds if (s := tracker.getStageInfo(k)))
    assert found[10] == found[1 << 20]
    assert tasks[1 << 20] < 30 < 300 < tasks[10], tasks


def test_jaccard_join_of_many_links(spark, monkeypatch):
    """Components through tables, as for more links than the driver settles."""
    monkeypatch.setattr(jj, "SETTLED", 0)
    rows = near_rows(7, 120)
    got = jj.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)


def test_workers_give_memory_back():
    """What a task freed does not stay with its process, which lives on beside the next operator."""

    class Source:
        mapInArrow = staticmethod(lambda run, schema: run)

    def held():
        with open("/proc/self/smaps_rollup") as lines:
            return sum(int(x.split()[1]) for x in lines if x.startswith(("Pss_Anon", "Pss_Shmem"))) / 1024

    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(2000)]

    def batches():
        for k in range(3):
            raw = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6000)), "text": texts * 3})
            with pa.ipc.new_stream(raw, batch.schema) as out:
                out.write_batch(batch)
            yield pa.ipc.open_stream(raw.getvalue()).read_next_batch()

    for _ in jj._profile(Source())(batches()):
        pass
    after = held()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    assert after - held() < 20


def brute_repeats(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return out


def test_suffix_order():
    import tempfile

    rng = random.Random(2)
    for _ in range(40):
        strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        with tempfile.TemporaryDirectory() as folder:
            owner, size, prefix = suffix_order(strings, folder)
        got = [strings[i][len(strings[i]) - n :] for i, n in zip(owner, size)]
        assert got == sorted(s[k:] for s in strings for k in range(len(s) + 1))
        for k in range(1, len(got)):
            n = 0
            while n < min(len(got[k]), len(got[k - 1])) and got[k][n] == got[k - 1][n]:
                n += 1
            assert prefix[k] == n


def test_remove_repeats(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    rows = []
    for i in range(120):
        t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 250)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, 2300)
            t += base[k : k + rng.randint(90, 200)] + "".join(rng.choice("xyé") for _ in range(rng.randint(0, 4)))
        rows.append((i * 7 % 120, t))
    rows += [(300, "a" * 500), (301, "ab" * 400), (302, None), (303, ""), (304, "a" * 99), (305, "é" * 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, remove_repeats(df.repartition(4)).collect()))
    assert got == brute_repeats(rows, 100)
    again = {r.doc_id: tuple(r) for r in remove_repeats(df.union(df.limit(30))).collect()}  # repeated rows are one document
    assert sorted(again.values()) == got
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
