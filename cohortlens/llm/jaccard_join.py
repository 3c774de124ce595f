"""Near-duplicate classes by an n-gram Jaccard join (operator 3): size-aware, heavy and light.

A document's set holds its distinct 5-word shingles as 64-bit hashes. All sets are ordered alike: shingles
of few documents first, those of many last, by counts of the whole table. Two sets that link share much, so
they share an element among the first ones of each (the prefix).

* Small sets (up to a boundary) enumerate the 2-element subsets of a slightly longer prefix. The boundary is
  the size at which subsets cost more postings than inverted lists cost postings times list length, by
  statistics of all documents.
* Large sets post their prefix to inverted lists.

Lists of rare elements are short (under OFTEN sets, but for what ORDERED leaves out): their pairs are counted
over all lists, and those that share too few to link are dropped.

Lists of frequent elements and of subsets can be long and, for near copies, mutually alike, and only classes
are wanted. So sets are first compared with one set of their lists (a star, linear in the lists' length),
and those that link are one component; stars with other middles follow while they link much. If a few sets
then meet a large group, each is first compared with a sample of it, as one link is enough. What is left
are pairs of sets of different components that meet in a list and have enough behind the element in both,
as linked sets do at the first element that they share. Long lists are cut in blocks, and a middle's members
are dealt in chunks, so no task gathers a list or a group of copies.

Every link between components is found. A linked pair shares at least a number of prefix elements; if any is
rare, it shares so many rare ones, less the frequent ones in the shorter prefix, which is what the count asks
for. If none is, the first that it shares is frequent, and it passes there. All that remain are compared
exactly, unless stars have connected them already. Equal sets are one class by a 128-bit digest.

Null or empty texts have no shingles and link with nothing. Texts of fewer words than a shingle are one
shingle. Repeated rows are equal sets; rows of one id are one document in links. Rows with a null id get a
null component. Extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Workspace, among, lean, partitions, read_table, where_among

WORDS = 5
PERCENT = 75
# Rows of a list, and members of a star, that a task takes at once.
BLOCK = 2048
# Shingles counted at once; shingles of fewer documents than OFTEN count as rare; how many of the others are
# ordered by frequency (the most frequent ones; the rest count as rare, which costs time and loses nothing).
CHUNK_SHINGLES, OFTEN, ORDERED = 4_000_000, 8, 1 << 19
# Stars go on while one links this part of the sets that share a key.
WORTH = 0.01
# Middles that a set is compared with in a turn after the first.
MIDDLES = 8
# Pairs that lists leave, for each set, over which parts of them (one set of so many) are compared first.
MANY, SAMPLED = 32, (32, 8)
# Links whose components the driver finds itself (16 MB of them); more go through tables.
SETTLED = 1 << 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _finish(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the whole text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    total = h[:n] * _MIX[0]
    for k in range(1, WORDS):
        total = total + h[k : k + n] * _MIX[k]
    return np.unique(_finish(total))


def _digest(own: np.ndarray) -> tuple[int, int]:
    import xxhash

    raw = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def need(n: int, m: int, percent: int = PERCENT) -> int:
    """Smallest intersection of sets of sizes n and m that link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Elements of which a linked set must share one: all but the least intersection less one."""
    return n - -(-percent * n // 100) + 1


_PROFILE = "doc_id long, n long, d1 long, d2 long, span int, counted binary"


def _profile(source: DataFrame) -> DataFrame:
    """A row for each document, with set size and digest; and rows of a span of hashes, with those met in a chunk of documents.

    A span is the first 12 bits of a shingle's hash. ``counted`` holds the next 20 bits of each shingle met:
    how many have each of 16 first values (32-bit numbers), then 16 bits of each.
    """
    names = ["doc_id", "n", "d1", "d2", "span", "counted"]

    def flush(sets):
        high = np.concatenate(sets)
        sets.clear()
        high.sort()
        ends = np.searchsorted(high, np.arange(1, 1 << 16, dtype=np.uint32) << np.uint32(16))
        ends = np.concatenate([[0], ends, [len(high)]])
        sizes, low = np.diff(ends).astype("<u4"), high.astype("<u2")
        spans = [k for k in range(1 << 12) if ends[16 * k] < ends[16 * k + 16]]
        raw = [sizes[16 * k : 16 * k + 16].tobytes() + low[ends[16 * k] : ends[16 * k + 16]].tobytes() for k in spans]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(raw), pa.int64()) for _ in range(4)), pa.array(spans, pa.int32()), pa.array(raw, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            sizes, digests = [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py())
                sizes.append(len(own))
                digests.append(_digest(own))
                sets.append((own >> np.uint64(32)).astype(np.uint32))
                held += len(own)
                if held >= CHUNK_SHINGLES:
                    yield flush(sets)
                    held = 0
            d = np.array(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(sizes, np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.nulls(len(d), pa.int32()), pa.nulls(len(d), pa.binary())], names)
        if held:
            yield flush(sets)

    return source.mapInArrow(lean(run), _PROFILE)


def _counts(profile: DataFrame, parts: int) -> DataFrame:
    """bucket (first 32 bits of a shingle's hash) and m, for the most frequent ones of a task; and the sums of m and of its square over the others, with a null bucket."""

    def spans(batches):
        """Each span with the values met, ascending, and how often; many values at once are summed in a table of the whole span."""
        span, held, size, table = None, [], 0, None

        def done():
            if table is not None:
                total = table + np.bincount(np.concatenate(held), minlength=1 << 20) if held else table
                own = np.flatnonzero(total)
                return span, own, total[own]
            return span, *np.unique(np.concatenate(held), return_counts=True)

        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if span is not None and own != span:
                    yield done()
                    held, size, table = [], 0, None
                elif size > 4_000_000:
                    table = np.bincount(np.concatenate(held), minlength=1 << 20) + (0 if table is None else table)
                    held, size = [], 0
                span = own
                sizes = np.frombuffer(raw[:64], "<u4")
                held.append(np.repeat(np.arange(16, dtype=np.int64) << 16, sizes) + np.frombuffer(raw[64:], "<u2"))
                size += len(held[-1])
        if span is not None:
            yield done()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = squares = 0
        for span, values, met in spans(batches):
            often = met >= OFTEN
            buckets, counts = np.append(buckets, values[often] + (span << 20)), np.append(counts, met[often])
            rare = met[~often]
            n, squares = n + int(rare.sum()), squares + int((rare * rare).sum())
            if len(buckets) > 2 * ORDERED:
                most = np.argpartition(-counts, ORDERED)[:ORDERED]
                buckets, counts = buckets[most], counts[most]
        most = np.lexsort((buckets, -counts))[:ORDERED]
        yield pa.RecordBatch.from_arrays([pa.array(buckets[most]), pa.array(counts[most]), pa.nulls(len(most), pa.int64())], ["bucket", "m", "squares"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64()), pa.array([squares], pa.int64())], ["bucket", "m", "squares"])

    dealt = profile.where("counted is not null").select("span", "counted").repartition(parts, "span").sortWithinPartitions("span")
    return dealt.mapInArrow(lean(run), "bucket long, m long, squares long")


def choose_boundary(list_length: float, percent: int = PERCENT) -> int:
    """Largest set size whose 2-element subsets are no more postings than inverted lists' postings times their length."""
    n = 2
    while n < 200:
        p1 = prefix_length(n + 1, percent)
        if p1 * (p1 + 1) // 2 > p1 * (1 + list_length):
            break
        n += 1
    return n


def _order(own: np.ndarray, often: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """A set in the order of all sets: rare shingles by hash, then frequent ones by frequency, and how many these are. often: buckets, ascending."""
    if not len(often):
        return own, 0
    bucket = (own >> np.uint64(32)).astype(np.uint32)
    at = np.searchsorted(often, bucket)
    at[at == len(often)] = 0
    hit = often[at] == bucket
    if not hit.any():
        return own, 0
    late = own[hit]
    return np.concatenate([own[~hit], late[np.argsort(rank[at[hit]], kind="stable")]]), len(late)


def prefix_keys(own: np.ndarray, frequent: int, boundary: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of an ordered set, of which the last ``frequent`` elements are frequent, and a number for each.

    The lowest bit of a key tells sorts apart. 0: a rare element, with the number of frequent ones in the
    prefix. 1: a frequent element, with its place in the set, or a subset of a small set, with place 0.
    """
    n = len(own)
    p1 = prefix_length(n, percent)
    large = n > boundary
    keys, numbers = [own[:0]], [np.zeros(0, np.int64)]
    if n >= 3 and not large:
        first = own[: p1 + 1]
        a, b = np.triu_indices(len(first), 1)
        lo, hi = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
        keys.append(np.unique(_finish(lo * _MIX[1] + hi * _MIX[2] + _MIX[3]) | np.uint64(1)))
        numbers.append(np.zeros(len(keys[-1]), np.int64))
    if large or 100 * n >= percent * (boundary + 1):  # may link with a large one
        place = np.arange(p1)
        often = place >= n - frequent
        keys.append((own[:p1] & ~np.uint64(1)) | often.astype(np.uint64))
        numbers.append(np.where(often, place, int(often.sum())))
    return np.concatenate(keys), np.concatenate(numbers)


_POSTING = "key long, doc long, n int, number int"


def _postings(source: DataFrame, held, boundary: int, percent: int) -> DataFrame:
    """Keys of each set, once for equal sets that a task meets close together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = held.value
        seen: set[bytes] = set()
        import xxhash

        def out(parts):
            keys, numbers = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
            sizes = [len(p[0]) for p in parts]
            doc, n = (np.repeat(np.array([p[i] for p in parts], np.int64), sizes) for i in (2, 3))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(doc), pa.array(n.astype(np.int32)), pa.array(numbers.astype(np.int32))], ["key", "doc", "n", "number"])

        for batch in batches:
            parts, held_keys = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if doc is None:
                    continue
                own = shingle_set(text.as_py())
                if len(own) < 2:
                    continue
                mark = xxhash.xxh3_128_digest(own.tobytes())
                if mark in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(mark)
                keys, numbers = prefix_keys(*_order(own, often, rank), boundary, percent)
                if len(keys):
                    parts.append((keys, numbers, doc, len(own)))
                    held_keys += len(keys)
                if held_keys > 500_000:
                    yield out(parts)
                    parts, held_keys = [], 0
            yield out(parts)

    return source.mapInArrow(lean(run), _POSTING)


def _passes(n, place, m, other, percent: int):
    """Whether sets of n and m elements can link, if the first element that they share lies at these places."""
    return np.minimum(n - place, m - other) >= -(-percent * (n + m) // (100 + percent))


def _least_shared(n, m, percent: int):
    """Prefix elements that linked sets of n and m elements share at least: all common ones but those behind the prefix that ends first."""
    most = np.maximum(-(-percent * n // 100), -(-percent * m // 100)) - 1
    return -(-percent * (n + m) // (100 + percent)) - most


_LIST = "key long, doc long, n int, place int, middle long, passes boolean"


def _lists(postings: DataFrame, parts: int, percent: int, turn: int) -> DataFrame:
    """What postings of keys with two or more say, in rows of two sorts.

    Of frequent keys, the posting with a middle: one set of the key of about that size; after turn 0 not the
    same in all lists, and another each turn.
    Of rare keys (key null), pairs doc < middle with n, how many rare keys they share (summed in a task), and
    place, how many a linked pair of them shares at least.
    """
    log = float(np.log(100 / percent))
    names = ["key", "doc", "n", "place", "middle", "passes"]

    def frequent(own, middle, which):
        _, doc, n, place, _ = own
        passes = _passes(n, place, middle[1], middle[2], percent) & (doc != middle[0])
        columns = [*own[:4], middle[0], passes]
        kinds = [np.int64, np.int64, np.int32, np.int32, np.int64, bool]
        return pa.RecordBatch.from_arrays([pa.array(c[which].astype(t)) for c, t in zip(columns, kinds)], names)

    def pairs(own):
        key, doc, n, long, _ = own
        for step in range(1, len(key)):
            i = np.flatnonzero(key[step:] == key[:-step])
            if not len(i):
                break
            j = i + step
            fits = (doc[i] != doc[j]) & (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
            i, j = i[fits], j[fits]
            yield np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), np.ones(len(i), np.int64), _least_shared(n[i], n[j], percent) - np.minimum(long[i], long[j])])

    def summed(held):
        a, b, n, least = np.concatenate(held, axis=1)
        order = np.lexsort((b, a))
        a, b, n, least = a[order], b[order], n[order], least[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, int)
        return np.stack([a[first], b[first], np.add.reduceat(n, first) if len(a) else n, least[first]])

    def pair_rows(held):
        a, b, n, least = held
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(n.astype(np.int32)), pa.array(least.astype(np.int32)), pa.array(b), pa.nulls(len(a), pa.bool_())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the last rare key
        last = None  # of frequent keys: the last row, whether a row of its key came before, its middle
        held, size = [], 0
        for batch in chain(batches, [None]):
            own = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)] if batch is not None else [np.zeros(0, np.int64)] * 5
            rare = int((own[0] & 1 == 0).sum())  # they come first
            few = [c[:rare] for c in own]
            if rest is not None:
                few = [np.concatenate([r, c]) for r, c in zip(rest, few)]
                rest = None
            if len(few[0]):
                if batch is not None and rare == len(own[0]):
                    start = int(np.searchsorted(few[0], few[0][-1]))
                    rest, few = [c[start:] for c in few], [c[:start] for c in few]
                for found in pairs(few):
                    held.append(found)
                    size += found.shape[1]
                    if size > 2_000_000:
                        yield pair_rows(summed(held))
                        held, size = [], 0
            own = [c[rare:] for c in own]
            if not len(own[0]):
                continue
            if last:
                own = [np.concatenate([c, o]) for c, o in zip(last[0], own)]
            key, doc, n, place, about = own
            new_key = np.append(True, key[1:] != key[:-1])
            new = new_key | np.append(True, about[1:] != about[:-1])
            middle = np.stack([doc, n, place])[:, np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            had = ~new_key
            if last:
                had[0] = last[1]
                stop = np.flatnonzero(new[1:])
                middle[:, : stop[0] + 1 if len(stop) else len(key)] = last[2][:, None]
            yield frequent(own, middle, np.append(had[:-1] | (key[1:] == key[:-1]), False))
            last = [c[-1:] for c in own], bool(had[-1]), middle[:, -1]
        if last and last[1]:
            yield frequent(last[0], last[2][:, None], slice(None))
        if held:
            yield pair_rows(summed(held))

    about = F.floor(F.log("n") / log).cast("int")
    dealt = postings.repartition(parts, "key").withColumn("about", about)
    order = "doc" if not turn else F.xxhash64("doc", F.pmod("key", F.lit(MIDDLES)), F.lit(turn))
    return dealt.sortWithinPartitions(F.col("key").bitwiseAND(F.lit(1)), "key", "about", order, "doc").mapInArrow(lean(run), _LIST)


def _meeting_pairs(rows: DataFrame, parts: int, percent: int, sample: int = 1) -> DataFrame:
    """Pairs (a, b) of sets of different components that meet in a list and pass by place. rows: key, doc, n, place, component, sets (of the list).

    With a sample, only those in which one of the two belongs to it: one set of so many, by its hash.
    """
    names = ["a", "b"]
    drawn = lambda doc: _finish(doc.astype(np.uint64) * _MIX[0] + np.uint64(sample)) % np.uint64(sample) == 0

    def pairs(own):
        """Of one pair of blocks of a list, some rows of the triangle at a time."""
        _, lo, hi, block, doc, n, place, component = own
        one, two = (block == lo).nonzero()[0], (block == hi).nonzero()[0]
        first, second = drawn(doc[one]), drawn(doc[two])
        step = max(1, 2_000_000 // max(1, len(two)))
        for s in range(0, len(one), step):
            i = one[s : s + step, None]
            fits = (component[i] != component[two]) & (first[s : s + step, None] | second) & _passes(n[i], place[i], n[two], place[two], percent)
            if lo[0] == hi[0]:
                fits &= i < two
            i, j = fits.nonzero()
            a, b = doc[one[s + i]], doc[two[j]]
            yield np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            own = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(8)] if batch is not None else None
            if rest is not None:
                own = [np.concatenate([r, o]) for r, o in zip(rest, own)] if own else rest
            if not own or not len(own[0]):
                continue
            starts = np.flatnonzero(np.append(True, (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]) | (own[2][1:] != own[2][:-1])))
            ends = np.append(starts[1:], len(own[0]))
            if batch is not None:  # the last list may go on
                rest = [c[starts[-1] :] for c in own]
                starts, ends = starts[:-1], ends[:-1]
            _, _, _, _, doc, n, place, component = own
            i = starts[ends - starts == 2]  # most lists: at once
            i = i[(component[i] != component[i + 1]) & (drawn(doc[i]) | drawn(doc[i + 1])) & _passes(n[i], place[i], n[i + 1], place[i + 1], percent)]
            found = [(np.minimum(doc[i], doc[i + 1]), np.maximum(doc[i], doc[i + 1]))]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                for ab in pairs([c[s:e] for c in own]):
                    found.append(ab)
                    if sum(len(f[0]) for f in found[-50:]) > 500_000:
                        yield _distinct_pairs(found)
                        found = []
            if found:
                yield _distinct_pairs(found)

    def _distinct_pairs(found):
        both = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names)

    blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    cut = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc", "n", "place", "component")
    dealt = cut.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(lean(run), "a long, b long")


def linked(one: np.ndarray, two: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link, by their whole contents."""
    if len(one) > len(two):
        one, two = two, one
    if not len(one) or 100 * len(one) < percent * len(two):
        return False
    at = np.searchsorted(two, one)
    at[at == len(two)] = 0
    both = int((two[at] == one).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def _sets(source: DataFrame, met: DataFrame) -> DataFrame:
    """doc and its whole set, for the ids in ``met`` and a few others; texts are not shuffled."""

    slot, may_be = among(met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.flatnonzero(may_be(batch.column(2).to_numpy()))
            for s in range(0, len(own), 200):  # of long texts, too, no more than some at once
                part = own[s : s + 200]
                elements = [shingle_set(batch.column(1)[k].as_py()).tobytes() for k in part.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), pa.array(elements, pa.binary())], ["doc", "elements"])

    return source.where("doc_id is not null").select("doc_id", "text", slot("doc_id")).mapInArrow(lean(run), "doc long, elements binary")


def _links(pairs: DataFrame, sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, as src and dst. Members of a middle ``a`` are dealt in chunks; each chunk gets the middle's set.

    Only sets of the pairs are shuffled, and those always, so that small inputs run as large ones do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, middles = None, []
        for batch in batches:
            found = []
            for a, chunk, first, doc, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                own = np.frombuffer(raw.as_py(), np.uint64)
                if middle != (a, chunk):
                    middle, middles = (a, chunk), []
                if not first:
                    middles.append(own)  # one, but where rows repeat an id
                elif any(linked(m, own, percent) for m in middles):
                    found.append((a, doc))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["src", "dst"])

    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    members = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), F.col("b").alias("doc"))
    middles = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), F.col("a").alias("doc"))
    own = where_among(sets, "doc", pairs.select("a").unionAll(pairs.select("b")))[0]
    dealt = members.unionByName(middles).hint("merge").join(own, "doc").select("a", "chunk", "role", "doc", "elements")
    return dealt.repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", "role").mapInArrow(lean(run), "src long, dst long")


def smallest_reached(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, ascending, and for each the smallest that it reaches. Trees that a link joins become half as many in two rounds at most."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    one, two = at[: len(src)], at[len(src) :]
    root = np.arange(len(nodes))
    while len(one):
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(above := root[root], root):
            root = above
        one, two = root[one], root[two]
        apart = one != two
        one, two = one[apart], two[apart]
    return nodes, nodes[root]


def _components(links: DataFrame, keep) -> DataFrame:
    """node and component (its smallest node) for each node of the links (src, dst).

    Through tables that takes some twenty shuffles, each of as many tasks as there are partitions, whatever they hold.
    """
    if links.count() > SETTLED:
        return connected_components(links, keep)
    found = links.select("src", "dst").toArrow()
    nodes, least = smallest_reached(found["src"].to_numpy(), found["dst"].to_numpy())
    return keep(links.sparkSession.createDataFrame(pa.table({"node": nodes, "component": least})), "settled")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, boundary: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``; ids are integers and tell texts apart."""
    spark = docs.sparkSession
    parts = partitions(spark)
    work = Workspace(spark, "jaccard")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    profile = work.keep(_profile(source), "profile")
    counted = work.keep(_counts(profile, parts), "counts")
    if boundary is None:
        rare = counted.where("bucket is null").agg(F.sum("squares"), F.sum("m")).first()
        boundary = choose_boundary((rare[0] or 0) / max(1, rare[1] or 0), percent)
    # No more rows than ORDERED.
    often = counted.where("bucket is not null").orderBy(F.desc("m"), "bucket").limit(ORDERED).toArrow()
    buckets, counts = often["bucket"].to_numpy().astype(np.uint32), often["m"].to_numpy()
    rank = np.empty(len(buckets), np.int32)
    rank[np.lexsort((buckets, counts))] = np.arange(len(buckets), dtype=np.int32)
    by_bucket = np.argsort(buckets)
    held = spark.sparkContext.broadcast((buckets[by_bucket], rank[by_bucket]))
    sets_of = work.keep(profile.where("n is not null").select("doc_id", "n", "d1", "d2"), "sizes")
    work.drop("profile", "counts")
    work.release()

    lists = work.keep(_lists(_postings(source, held, boundary, percent), parts, percent, 0), "lists")
    work.release()
    close = lists.where("key is null").groupBy(F.col("doc").alias("a"), F.col("middle").alias("b")).agg(F.sum("n").alias("shared"), F.max("place").alias("least"))
    close = work.keep(close.where("shared >= least").select("a", "b"), "close")
    lists = work.keep(lists.where("key is not null"), "lists0")
    work.drop("lists")
    met = lists.select("doc").unionAll(close.select("a")).unionAll(close.select("b")).distinct()
    sets = work.keep(_sets(source, met), "sets")
    work.release()

    candidates = lists.select("doc").distinct().count()
    links = groups = None
    turn = 0
    component = lambda df, c: df.join(groups.select(F.col("node").alias(c), F.col("component").alias("_")), c, "left").withColumn(f"{c}_component", F.coalesce("_", c)).drop("_")

    def labelled(lists, links, name):
        """Components of the links, and the rows of lists with several of them."""
        nonlocal groups
        groups = _components(links, lambda df, k: work.keep(df, f"groups{name}_{k}"))
        rows = work.keep(component(lists.select("key", "doc", "n", "place"), "doc").withColumnRenamed("doc_component", "component"), f"labelled{name}")
        several = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("sets")).where("least < most")
        return rows.join(several.select("key", "sets"), "key")

    while True:
        votes = lists.where("passes").groupBy("doc", "middle").agg(F.count(F.lit(1)).alias("votes"))
        if turn:
            votes = component(component(votes, "doc"), "middle").where("doc_component <> middle_component")
        # The middle that a set meets most; later, for the sets that it did not link, several at once.
        place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("votes"), "middle"))
        chosen = votes.withColumn("place", place).where(F.col("place") <= (MIDDLES if turn else 1))
        star = work.keep(chosen.select(F.col("middle").alias("a"), F.col("doc").alias("b")), f"star{turn}")
        found = work.keep(_links(star, sets, parts, percent), f"links{turn}")
        links = found if links is None else links.unionAll(found)
        rows = labelled(lists, links, f"{turn}")
        if found.select("dst").distinct().count() <= WORTH * candidates:
            break
        turn += 1
        lists = work.keep(_lists(rows.select("key", "doc", "n", "place"), parts, percent, turn), f"lists{turn}")
        work.release()
    for sample in SAMPLED:
        same = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("own"), F.first("sets").alias("sets"))
        left = same.agg(F.sum(F.col("own") * (F.col("sets") - F.col("own")).cast("double")) / 2).first()[0] or 0
        if left <= MANY * candidates:
            break
        star = work.keep(_meeting_pairs(rows, parts, percent, sample).distinct(), f"sample{sample}")
        links = links.unionAll(work.keep(_links(star, sets, parts, percent), f"sampled{sample}"))
        rows = labelled(rows.select("key", "doc", "n", "place"), links, f"_{sample}")
    apart = component(component(close, "a"), "b").where("a_component <> b_component").select("a", "b")
    pairs = work.keep(_meeting_pairs(rows, parts, percent).unionAll(apart).distinct(), "pairs")
    links = links.unionAll(work.keep(_links(pairs, sets, parts, percent), "last_links"))
    work.drop("sets", "pairs", "close", *(f"{name}{k}" for k in range(turn + 1) for name in ("lists", "labelled", "star")), *(f"{name}{k}" for k in SAMPLED for name in ("sample", "labelled_")))
    work.release()

    classes = sets_of.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"))
    of_doc = work.keep(sets_of.join(classes, ["d1", "d2"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")), "classes")
    edges = links.select("src", "dst").unionAll(of_doc.where("doc_id <> class_id").select("doc_id", "class_id"))
    found = _components(edges, work.keep)
    return of_doc.join(found, of_doc["doc_id"] == found["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op3_jaccard_join(spark, sf_dir):
    """Contract query: components of links at a similarity of 0.75 on 5-word shingles."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
c AS (SELECT doc_id AS r, doc_id AS g FROM w UNION SELECT l.b, c.g FROM c JOIN l ON c.r = l.a)
SELECT r AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(g) AS component_id FROM c LEFT JOIN n ON r = n.doc_id GROUP BY 1
"""
