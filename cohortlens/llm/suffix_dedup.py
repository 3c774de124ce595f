"""Removal of repeated passages by a suffix structure (operator 8).

A byte goes if a ``length``-byte string that covers it also starts earlier in the collection. The order of
suffixes comes from a column-wise construction over many strings at once: each round inserts one more
symbol of every string into the collection's Burrows-Wheeler transform and updates the common prefixes of
neighbours; a round reads the columns of the round before from sequential files and writes its own.

Its rounds are as many as the longest string has symbols, and each passes over all columns, so whole
documents are out of reach (100,000 rounds over the corpus). The strings given to it are fragments instead,
found so that nothing is lost: every window of ``length`` bytes has an anchor, the smallest hash of its
``GRAM``-byte substrings, and equal windows have equal anchors at equal places. Windows that follow each
other with one anchor form an extent. Extents that are equal as wholes need no comparison of windows: all
but the earliest go. Of an anchor with several different extents, the earliest of each are the fragments,
and the windows among them that share ``length`` bytes are neighbours in suffix order.

Equal extents of one task are combined before the shuffle, so a passage of very many documents brings a row
a task at most. Null texts count as empty. Rows that repeat id and text are one document (one row a copy
comes out); ids are integers. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, partitions, per_process, read_table

LENGTH = 100
GRAM = 32
BUFFER = 1 << 20
BUNDLE = 4000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(n: int):
    """Powers of both bases and of their inverses modulo 2^64, at least n."""
    size = max(BUFFER * 2, 1 << (n - 1).bit_length() if n > 1 else 1)

    def make():
        out = []
        for base in _BASES:
            inverse = pow(base, -1, 1 << 64)
            for b in (base, inverse):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                out.append(np.cumprod(p, dtype=np.uint64))
        return out

    return per_process(("suffix powers", size), make)


def _finish(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def extents(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of texts laid end to end (``starts``, ``ends`` in ``raw``): place of the text, anchor's hash, extent's hash, first window, number of windows, sides.

    sides: 15 bits of a hash of the bytes before the anchor and as many of those behind it, half of what a
    window has besides the anchor; 0 where the text has fewer. Equal windows agree on one side at least.
    """
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    p1, i1, p2, i2 = _powers(n + 1)
    symbol = raw.astype(np.uint64) + np.uint64(1)
    sum1 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbol * p1[:n], dtype=np.uint64)])
    sum2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbol * p2[:n], dtype=np.uint64)])
    grams = _finish((sum1[gram:] - sum1[:-gram]) * i1[: n - gram + 1])
    # High half of the hash, then the place: the least is the leftmost of the smallest.
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.maximum(0, ends - starts - length + 1)
    text = np.repeat(np.arange(len(starts)), sizes)
    window = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[text]
    if not len(window):
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    own = anchor[window]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(first, len(window)))
    begin = window[first]
    size = count + length - 1
    whole = _finish((sum2[begin + size] - sum2[begin]) * i2[begin] + size.astype(np.uint64))
    half = -(-(length - gram) // 2)
    sides = np.zeros(len(first), np.int64)
    for at in (own[first] - half, own[first] + gram):
        inside = (at >= starts[text[first]]) & (at + half <= ends[text[first]])
        k = np.where(inside, at, 0)
        print_ = (_finish((sum2[k + half] - sum2[k]) * i2[k]) >> np.uint64(49)).astype(np.int64) % 32767 + 1
        sides = (sides << 15) | np.where(inside, print_, 0)
    return text[first], grams[own[first]], whole, begin - starts[text[first]], count, sides


_ROW = "key long, extent long, doc long, start int, count int, sides int, gone boolean"


def _scan(source: DataFrame, length: int) -> DataFrame:
    """Extents, the earliest of equal ones in a task's batch; of the others only where they lie (gone)."""
    names = ["key", "extent", "doc", "start", "count", "sides", "gone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(1)]
            k = 0
            while k < len(texts):
                stop, size = k, 0
                while stop < len(texts) and (stop == k or size + len(texts[stop]) <= BUFFER):
                    size += len(texts[stop])
                    stop += 1
                lengths = np.array([len(t) for t in texts[k:stop]], np.int64)
                ends = np.cumsum(lengths)
                at, key, extent, start, count, sides = extents(np.frombuffer(b"".join(texts[k:stop]), np.uint8), ends - lengths, ends, length)
                found.append((docs[k:stop][at], key, extent, start, count, sides))
                k = stop
            if not found:
                continue
            doc, key, extent, start, count, sides = (np.concatenate([f[i] for f in found]) for i in range(6))
            order = np.lexsort((start, doc, extent, key))
            doc, key, extent, start, count, sides = (c[order] for c in (doc, key, extent, start, count, sides))
            same = np.append(False, (key[1:] == key[:-1]) & (extent[1:] == extent[:-1]))[: len(key)]
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
            gone = (doc != doc[first]) | (start != start[first])  # else it is the earliest, or a repeated row of it
            # What goes here already is merged by document.
            d, s, e = doc[gone], start[gone], start[gone] + count[gone] + length - 1
            by = np.lexsort((s, d))
            d, s, e = d[by], s[by], e[by]
            if len(d):
                cut = np.concatenate([[True], d[1:] != d[:-1]])
                group = np.cumsum(cut)
                top = np.int64(e.max() + 1)
                reach = np.maximum.accumulate(e + group * top) - group * top
                new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > reach[:-1])])
                f = np.flatnonzero(new)
                d, s, e = d[f], s[f], np.append(reach[f[1:] - 1], reach[-1])
            here = ~gone & ~same
            columns = [np.concatenate([key[here].view(np.int64), d * 0x9E3779B1]), np.concatenate([extent[here].view(np.int64), np.zeros(len(d), np.int64)]), np.concatenate([doc[here], d])]
            columns += [np.concatenate([start[here], s]).astype(np.int32), np.concatenate([count[here], e - s]).astype(np.int32), np.concatenate([sides[here], np.zeros(len(d), np.int64)]).astype(np.int32), np.concatenate([np.zeros(here.sum(), bool), np.ones(len(d), bool)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return source.mapInArrow(run, _ROW)


_FOUND = "key long, doc long, start int, stop int, fragment boolean"


def _compare_extents(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """What goes (start, stop of a document), and the fragments: the earliest of each extent of an anchor that has several."""
    names = ["key", "doc", "start", "stop", "fragment"]

    def out(key, doc, start, stop, fragment):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(np.full(len(key), fragment))], names)

    def several(own):
        """Of the earliest extents, those that agree on a side with another of their key."""
        key, sides = own[0], own[5]
        run = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)]).astype(np.int64)
        many = np.zeros(len(key), bool)
        for side in (sides >> 15, sides & 32767):
            _, at, n = np.unique(run << 15 | side, return_inverse=True, return_counts=True)
            many |= (n[at] > 1) & (side > 0)
        return out(key[many], own[2][many], own[3][many], own[3][many] + own[4][many] + length - 1, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the earliest extents of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            gone = own.pop()
            yield out(own[0][gone], own[2][gone], own[3][gone], own[3][gone] + own[4][gone], False)
            own = [c[~gone] for c in own]
            if not len(own[0]):
                continue
            same = np.append(False, (own[0][1:] == own[0][:-1]) & (own[1][1:] == own[1][:-1]))
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
            doc, start = own[2][first], own[3][first]
            if held is not None and own[0][0] == held[0][-1] and own[1][0] == held[1][-1]:
                # A run of equal extents that goes on from the batch before.
                same[0] = True
                doc[first == 0], start[first == 0] = held[2][-1], held[3][-1]
            gone = same & ((own[2] != doc) | (own[3] != start))
            yield out(own[0][gone], own[2][gone], own[3][gone], own[3][gone] + own[4][gone] + length - 1, False)
            last = own[0][-1], own[1][-1]
            own = [c[~same] for c in own]
            if held is not None:
                own = [np.concatenate([h, c]) for h, c in zip(held, own)]
            cut = np.searchsorted(own[0], last[0], side="left")
            yield several([c[:cut] for c in own])
            held = [c[cut:] for c in own]
        if held is not None:
            yield several(held)

    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "extent", "doc", "start")
    return dealt.mapInArrow(run, _FOUND)


class _Columns:
    """The columns of a round in sequential files; a round reads the last one's and writes its own."""

    def __init__(self, folder: str):
        self.folder, self.round = folder, 0
        self.kinds = {"symbol": np.uint8, "prefix": np.uint8}

    def write(self, **columns: np.ndarray) -> None:
        # New names each round: a file that is written over would be forced to the disk.
        for name, values in columns.items():
            values.tofile(os.path.join(self.folder, f"{name}{self.round}"))
            if self.round:
                os.unlink(os.path.join(self.folder, f"{name}{self.round - 1}"))
        self.round += 1

    def read(self) -> list[np.ndarray]:
        return [np.fromfile(os.path.join(self.folder, f"{name}{self.round - 1}"), kind) for name, kind in self.kinds.items()]


def _range_minimum(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi], each range at least one long."""
    size = hi - lo
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table, span = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        own = level == k
        if own.any():
            out[own] = np.minimum(table[lo[own]], table[hi[own] - span])
        if len(table) > span:
            table = np.minimum(table[:-span], table[span:])
        span *= 2
    return out


def suffix_order(strings: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings in order: string, length of the suffix, common prefix with the one before (up to 255).

    Column-wise: round j inserts the suffix of length j of each string that is as long. Strings have 254
    symbols at most.
    """
    m = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(lengths)

    def symbol(string, j):
        """The symbol before the suffix of length j, from 1; 0 before the whole string."""
        at = ends[string] - j - 1
        inside = j < lengths[string]
        return np.where(inside, flat[np.where(inside, at, 0)] + 1 if len(flat) else 0, 0).astype(np.uint8)

    columns = _Columns(folder)
    names = np.arange(m, dtype=np.int32) << 8  # string and length of the suffix
    columns.write(symbol=symbol(np.arange(m), 0), prefix=np.zeros(m, np.uint8))
    place = np.arange(m)  # of the suffix that each string inserted last
    for j in range(1, int(lengths.max(initial=0)) + 1):
        before, prefix = columns.read()
        active = np.flatnonzero(lengths >= j)
        tail = place[active]
        order = np.argsort(before, kind="stable")
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.arange(len(order))
        ended = int(np.count_nonzero(before == 0))
        k = inverse[tail]
        new = m + k - ended  # behind the empty suffixes, in order of the first symbol
        total = len(before) + len(active)
        old = np.ones(total, bool)
        old[new] = False
        moved = np.flatnonzero(old)
        nxt_symbol, nxt_prefix, nxt_names = np.empty(total, np.uint8), np.empty(total, np.uint8), np.empty(total, np.int32)
        nxt_symbol[moved], nxt_prefix[moved], nxt_names[moved] = before, prefix, names
        nxt_symbol[new], nxt_names[new] = symbol(active, j), (active << 8) + j
        # Common prefixes with both neighbours: one more than the least between the places of the tails.
        own = before[tail]
        up, down = k > 0, k < len(order) - 1
        up[up] = before[order[k[up] - 1]] == own[up]
        down[down] = before[order[k[down] + 1]] == own[down]
        lo = np.concatenate([order[k[up] - 1], tail[down]]) + 1
        hi = np.concatenate([tail[up], order[k[down] + 1]]) + 1
        least = np.minimum(_range_minimum(prefix, lo, hi), 254) + 1
        nxt_prefix[new] = 0
        nxt_prefix[new[up]] = least[: int(up.sum())]
        nxt_prefix[new[down] + 1] = least[int(up.sum()) :]
        columns.write(symbol=nxt_symbol, prefix=nxt_prefix)
        names = nxt_names
        # The last suffix of every string moves with what is inserted before it.
        place = moved[place]
        place[active] = new
    return (names >> 8).astype(np.int64), (names & 255).astype(np.uint8), columns.read()[1]


def repeated_windows(strings: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, starts and stops of what windows of ``length`` bytes that also start earlier, by (doc, start), cover."""
    if len(strings) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with tempfile.TemporaryDirectory() as folder:
        owner, size, prefix = suffix_order(strings, folder)
    long = np.flatnonzero(size >= length)
    new = prefix[long] < length
    group = np.cumsum(new)
    lengths = np.array([len(s) for s in strings], np.int64)
    doc, start = docs[owner[long]], starts[owner[long]] + lengths[owner[long]] - size[long]
    order = np.lexsort((start, doc, group))
    group, doc, start = group[order], doc[order], start[order]
    again = np.append(False, group[1:] == group[:-1])[: len(group)]
    # The earliest of a group stays, in however many overlapping fragments it lies.
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(group))))
    gone = (doc != doc[first]) | (start != start[first])
    doc, start = doc[gone], start[gone]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))[: len(doc)]
    f = np.flatnonzero(new)
    last = np.append(f[1:], len(doc))[: len(f)] - 1
    return doc[f], start[f], start[last] + length


def _cut_fragments(joined: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                rows += [(f["key"], doc, f["start"], raw[f["start"] : f["stop"]]) for f in own]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["key", "doc", "start", "piece"])

    return joined.mapInArrow(run, "key long, doc long, start int, piece binary")


def _compare_windows(fragments: DataFrame, parts: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        rows: list[tuple] = []

        def flush(n):
            doc, start, stop = repeated_windows([r[2] for r in rows[:n]], np.array([r[0] for r in rows[:n]], np.int64), np.array([r[1] for r in rows[:n]], np.int64), length)
            del keys[:n], rows[:n]
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["doc", "start", "stop"])

        for batch in batches:
            keys += batch.column(0).to_pylist()
            rows += zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
            while len(rows) > BUNDLE:
                # Whole keys: the last one may go on.
                n = BUNDLE
                while n < len(keys) and keys[n] == keys[n - 1]:
                    n += 1
                if n == len(keys):
                    break
                yield flush(n)
        if rows:
            yield flush(len(rows))

    dealt = fragments.repartition(parts, "key").sortWithinPartitions("key", "doc", "start")
    return dealt.mapInArrow(run, "doc long, start int, stop int")


def _finish_documents(joined: DataFrame, with_text: bool) -> DataFrame:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                parts, end, spans = [], 0, 0
                last = -1
                for x in sorted((f["start"], f["stop"]) for f in own or ()):
                    if x[0] > last:
                        parts.append(raw[end : x[0]])
                        spans += 1
                        end = last = x[1]
                    elif x[1] > last:
                        end = last = x[1]
                kept = b"".join([*parts, raw[end:]])
                rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names) - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; ``with_text`` adds the bytes that stay."""
    if not GRAM < length <= 140:
        raise ValueError("length must be between 33 and 140 bytes")
    spark = docs.sparkSession
    parts = partitions(spark)
    work = Workspace(spark, "suffix")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    unique = source.where("doc is not null")

    found = work.keep(_compare_extents(_scan(unique, length), parts, length), "extents")
    work.release()
    wanted = found.where("fragment").groupBy("doc").agg(F.collect_set(F.struct("key", "start", "stop")).alias("own"))
    cut = unique.join(wanted, "doc").select("doc", "text", "own")
    fragments = work.keep(_cut_fragments(cut), "fragments")
    work.release()
    windows = work.keep(_compare_windows(fragments, parts, length), "windows")
    work.drop("fragments")
    gone = found.where("not fragment").select("doc", "start", "stop").unionByName(windows)
    gone = work.keep(gone.groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("own")), "gone")
    work.drop("extents", "windows")
    work.release()
    return _finish_documents(source.join(gone, "doc", "left").select("doc", "text", "own"), with_text)


def op8_suffix_dedup(spark, sf_dir):
    """Contract query: strings of 100 bytes."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))
