"""Personal data by bootstrapped contextual extraction (operator 10).

Base expressions find seed entities (email, ip, card, phone). The seeds induce lexical patterns of two
sorts: the two words before an entity, and the shape of the entity itself (runs of digits by length, runs
of letters, other characters as they are). A second reading looks, over all documents, at what follows or
fits each pattern with ``min_seeds`` distinct seeds: a seed, a candidate, or an ordinary word. Candidates
have looser forms than the base: spelled or bracketed ``at`` and ``dot``, dots in brackets, phones without a
plus, other separators, and numbers that a greedy base match swallowed and dropped. Spark scores the graph
of patterns and instances iteratively: an instance is as sure as the noisy-or of its patterns, a pattern as
sure as the mean of its instances (seeds count 1, ordinary words 0). Candidates of a pattern of high
confidence are added as spans.

Patterns may be as many as the corpus has: tasks get a bitmap of their hashes, of a fixed size, and what
they find is joined with the patterns by name. Nothing depends on the size of the input.

Base spans are never removed. Null texts count as empty. Repeated rows get a result each. An empty table
gives an empty result. Columns other than id and text are ignored by ``find``; ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Workspace, lean, read_table

KINDS = ("email", "ip", "card", "phone")
ORDER = {kind: k for k, kind in enumerate(KINDS)}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only begin where a run of digits begins, as matches end with their run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# What a candidate must look like as a whole, kind by kind.
_FORMS = (
    re.compile(rf"[{re.escape(_LOCAL)}]+@{_DOMAIN.pattern}"),
    re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    re.compile(r"\+?[0-9(][\x20().0-9-]+[0-9]"),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def holds(kind: str, entity: str) -> bool:
    """Whether a string is an entity of its kind."""
    if not _FORMS[ORDER[kind]].fullmatch(entity):
        return False
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in entity.split("."))
    digits = "".join(_DIGIT.findall(entity))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base expressions, leftmost and non-overlapping for each kind."""
    out = []
    last = floor = 0
    at = text.find("@")
    while at >= 0:
        lower = max(last, floor)
        start = lower + len(text[lower:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            last = m.end()
        floor = at + 1
        at = text.find("@", floor)
    if _DIGIT.search(text):
        for k, expression in ((1, _IP), (2, _CARD), (3, _PHONE)):
            if k == 3 and "+" not in text:
                continue
            for m in expression.finditer(text):
                if (k != 2 or m.end() - m.start() >= 12) and holds(KINDS[k], m[0]):
                    out.append((m.start(), k, m.end()))
    out.sort()
    return out


def shape(entity: str) -> str:
    """Runs of digits by length, runs of letters as ``a``, the rest as it is."""
    short = re.sub(r"[A-Za-z]+", "a", entity)
    return re.sub(r"[0-9]+", lambda m: f"{{{len(m[0])}}}", short)


_AT = r"(?:@|\x20?(?:\[at\]|\(at\)|\{at\})\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\{dot\})\x20?|\x20dot\x20)"
# Looser forms of the kinds, for what follows a pattern.
_LOOSE = (
    re.compile(rf"[{re.escape(_LOCAL)}]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I),
    re.compile(rf"[0-9]+(?:{_DOT}[0-9]+){{3}}(?![0-9])", re.I),
    re.compile(r"[0-9](?:[\x20./_-]?[0-9])+"),
    re.compile(r"\+?[0-9(][\x20()./_0-9-]*[0-9]"),
)
_NUMBERS = re.compile(r"[+(]*[0-9][\x20()./0-9-]*")
_AT_FORM, _DOT_FORM = re.compile(_AT, re.I), re.compile(_DOT, re.I)


def plain(kind: int, entity: str) -> str:
    """A loose form as the base would write it."""
    if kind == 0:
        return _DOT_FORM.sub(".", _AT_FORM.sub("@", entity, count=1))
    return _DOT_FORM.sub(".", entity) if kind == 1 else re.sub("[./_]", "-", entity)


def loose_match(kind: int, text: str, start: int) -> tuple[int, str] | None:
    """End and plain form of a loose entity at a place: of numbers with spaces the first part that holds as a phone, the longest as a card."""
    m = _LOOSE[kind].match(text, start)
    if not m:
        return None
    entity = m[0]
    if kind < 2:
        form = plain(kind, entity)
        return (m.end(), form) if holds(KINDS[kind], form) else None
    # No phone or card has more than 19 digits: what comes later can't belong to it.
    ends, digits = [], 0
    for part in re.finditer(r"\S+", entity):
        digits += len(_DIGIT.findall(part[0]))
        if digits > 19:
            break
        ends.append(part.end())
    for end in ends if kind == 3 else reversed(ends):
        if holds(KINDS[kind], form := plain(kind, entity[:end])):
            return start + end, form
    return None


def number_runs(text: str) -> Iterator[tuple[int, int]]:
    """Spans of whole parts of runs of numbers, of 4 to 19 digits: what a shape could fit."""
    for m in _NUMBERS.finditer(text):
        parts = [(p.start() + m.start(), p.end() + m.start()) for p in re.finditer(r"[^\x20]+", m[0].rstrip(" ().-/"))]
        sizes = [len(_DIGIT.findall(text[s:e])) for s, e in parts]
        for i in range(len(parts)):
            digits = 0
            for j in range(i, len(parts)):
                digits += sizes[j]
                if digits > 19:
                    break
                if digits >= 4 and sizes[j]:
                    yield parts[i][0], parts[j][1]


def folded_words(text: str) -> list[bytes]:
    """Words between ASCII white space, lower-cased, runs of digits as one 0."""
    return re.sub(r"[0-9]+", "0", text.lower()).encode("utf-8", "replace").split()


def left_context(text: str, start: int) -> str:
    """The two words before an entity, folded; empty if there aren't two."""
    if not start or text[start - 1] not in " \t\n\r\x0b\x0c":
        return ""
    # Two whole words are all that is read, however long they are.
    reach = 80
    while True:
        low = max(0, start - reach)
        before = folded_words(text[low:start])
        if len(before) >= 3 or not low:
            return b" ".join(before[-2:]).decode() if len(before) >= 2 else ""
        reach *= 4


BITS = 22


def left_slots(one: np.ndarray, two: np.ndarray, kind: int) -> np.ndarray:
    """Bits of the bitmap for pairs of words, by their CRC-32."""
    h = one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + two.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64((kind + 1) * 0x165667B19E3779F9 & (2**64 - 1))
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def shape_slot(form: str, kind: int) -> int:
    return zlib.crc32(f"{kind}:{form}".encode("utf-8", "replace")) >> (32 - BITS)


def _bitmaps(chosen: DataFrame) -> dict[str, np.ndarray]:
    """For each sort, which hashes have a pattern: 2**BITS booleans, however many patterns there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = []
            for kind, sort, pattern in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if sort == "left":
                    one, two = (np.array([zlib.crc32(w)]) for w in pattern.encode("utf-8", "replace").split(b" "))
                    slots.append(int(left_slots(one, two, kind)[0]))
                else:
                    slots.append(shape_slot(pattern, kind))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(slots, pa.int64())], ["sort", "slot"])

    found = chosen.select("kind", "sort", "pattern").mapInArrow(lean(run), "sort string, slot long").distinct().toArrow()  # pandas stays out of the driver's memory
    sorts, slots = (found.column(k).to_numpy() for k in range(2))
    maps = {sort: np.zeros(1 << BITS, bool) for sort in ("left", "shape")}
    for sort, bits in maps.items():
        bits[slots[sorts == sort]] = True
    return {sort: np.packbits(bits) for sort, bits in maps.items()}


def _instance(kind: int, entity: str) -> int:
    """A seed's or candidate's name in the graph: 63 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(f"{kind}:{entity}".encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 1


_SEEDS = "doc_id long, text_key long, spans array<struct<start:int,kind:int,end:int>>, seeds array<struct<kind:int,sort:string,pattern:string,instance:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_EDGE = pa.list_(pa.struct([("kind", pa.int32()), ("sort", pa.string()), ("pattern", pa.string()), ("instance", pa.int64())]))


def _first_reading(source: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, seeds = [], []
            for value in batch.column(1):
                text = value.as_py()
                own = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                edges = []
                for s, k, e in own:
                    instance = _instance(k, text[s:e])
                    edges.append({"kind": k, "sort": "shape", "pattern": shape(text[s:e]), "instance": instance})
                    if context := left_context(text, s):
                        edges.append({"kind": k, "sort": "left", "pattern": context, "instance": instance})
                seeds.append(edges)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, _SPAN), pa.array(seeds, _EDGE)], ["doc_id", "text_key", "spans", "seeds"])

    return source.mapInArrow(lean(run), _SEEDS)


# What an occurrence of a pattern is followed by or fits: a seed, another candidate, or an ordinary word.
_HITS = "doc_id long, text_key long, kind int, sort string, pattern string, instance long, seed int, start int, end int, n long"


def _second_reading(source: DataFrame, bitmaps: dict[str, np.ndarray]) -> DataFrame:
    """Candidates as rows of their own; seeds and ordinary words as counts (text_key null), combined in each task."""
    held = source.sparkSession.sparkContext.broadcast(bitmaps)
    names = ["doc_id", "text_key", "kind", "sort", "pattern", "instance", "seed", "start", "end", "n"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(10)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, shapes = (np.unpackbits(held.value[sort]).astype(bool) for sort in ("left", "shape"))
        any_left, any_shape = left.any(), shapes.any()
        counts: Counter = Counter()

        def total():
            out = table([(None, None, k, s, p, None, seed, None, None, n) for (k, s, p, seed), n in counts.items()])
            counts.clear()
            return out

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, value, text_key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = value.as_py()
                base = None
                if any_left:
                    words = folded_words(text)
                    sums = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
                    places = None
                    for kind in range(len(KINDS)):
                        for k in np.flatnonzero(left[left_slots(sums[:-2], sums[1:-1], kind)]).tolist():
                            if places is None:
                                places = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
                                base = {(s, k): e for s, k, e in base_spans(text)}
                            start, pattern = places[k + 2], (words[k] + b" " + words[k + 1]).decode()
                            if (start, kind) in base:
                                counts[kind, "left", pattern, 1] += 1
                            elif not (loose := loose_match(kind, text, start)):
                                counts[kind, "left", pattern, 0] += 1
                            elif not any(k == kind and s < loose[0] and start < e for (s, k), e in base.items()):
                                end, form = loose
                                instance = _instance(kind, form)
                                rows.append((doc_id, text_key, kind, "left", pattern, instance, 0, start, end, 1))
                                if kind < 2 and shapes[shape_slot(shape(form), kind)]:
                                    rows.append((doc_id, text_key, kind, "shape", shape(form), instance, 0, start, end, 1))
                if any_shape and _DIGIT.search(text):
                    if base is None:
                        base = {(s, k): e for s, k, e in base_spans(text)}
                    for start, end in number_runs(text):
                        form = shape(text[start:end])
                        for kind in (1, 2, 3):
                            if not shapes[shape_slot(form, kind)]:
                                continue
                            if base.get((start, kind)) == end:
                                counts[kind, "shape", form, 1] += 1
                            elif any(k == kind and s < end and start < e for (s, k), e in base.items()):
                                continue
                            elif holds(KINDS[kind], text[start:end]):
                                rows.append((doc_id, text_key, kind, "shape", form, _instance(kind, text[start:end]), 0, start, end, 1))
                            else:
                                counts[kind, "shape", form, 0] += 1
                if len(counts) > 100_000:
                    yield total()
            yield table(rows)
        yield total()

    return source.mapInArrow(lean(run), _HITS)


def score_graph(edges: list[tuple], counts: dict[tuple, tuple[int, int]], rounds: int) -> dict[tuple, float]:
    """Scores without Spark, for tests: edges (pattern, instance, n), counts pattern -> (seeds, ordinary words)."""
    instance = {i: 0.0 for _, i, _ in edges}
    scores: dict[tuple, float] = {}
    for _ in range(rounds):
        for p, (seeds, words) in (dict.fromkeys((e[0] for e in edges), (0, 0)) | counts).items():
            own = [(i, n) for q, i, n in edges if q == p]
            scores[p] = (seeds + sum(n * instance[i] for i, n in own)) / max(1, seeds + words + sum(n for _, n in own))
        for i in instance:
            miss = 1.0
            for p in {q for q, j, _ in edges if j == i}:
                miss *= 1 - scores[p]
            instance[i] = 1 - miss
    return scores


_PATTERN = ["kind", "sort", "pattern"]


def score(hits: DataFrame, rounds: int, work: Workspace) -> DataFrame:
    """kind, sort, pattern, score: the graph of patterns and instances, scored in turns."""
    fixed = work.keep(hits.where("text_key is null").groupBy(*_PATTERN).agg(F.sum(F.col("n") * F.col("seed")).alias("seeds"), F.sum("n").alias("known")), "fixed")
    graph = work.keep(hits.where("text_key is not null").groupBy(*_PATTERN, "instance").agg(F.sum("n").alias("n")), "graph")
    scores = None
    instances = graph.select("instance").distinct().withColumn("sure", F.lit(0.0))
    for k in range(rounds):
        own = graph.join(instances, "instance").groupBy(*_PATTERN).agg(F.sum(F.col("n") * F.col("sure")).alias("won"), F.sum("n").alias("all"))
        scores = fixed.join(own, _PATTERN, "full").select(*_PATTERN, ((F.coalesce("seeds", F.lit(0)) + F.coalesce("won", F.lit(0.0))) / F.greatest(F.lit(1), F.coalesce("known", F.lit(0)) + F.coalesce("all", F.lit(0)))).alias("score"))
        scores = work.keep(scores, f"scores{k}")
        # 1 - product of (1 - score): zero where a pattern is certain.
        miss = F.sum(F.ln(F.greatest(F.lit(1e-12), 1 - F.col("score"))))
        instances = work.keep(graph.join(scores, _PATTERN).groupBy("instance").agg((1 - F.exp(miss)).alias("sure")), f"instances{k}")
    return scores


def find(docs: DataFrame, min_seeds: int = 5, confidence: float = 0.8, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base and added (arrays of (start, kind, end) in code points, sorted): a row for each row of ``docs``.

    Ids are integers, and may be null or repeat; text_key tells different texts of an id apart.
    """
    work = Workspace(docs.sparkSession, "pii")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("text_key", F.xxhash64("text"))
    first = work.keep(_first_reading(source), "first")

    edges = first.select(F.explode("seeds").alias("e")).select("e.*").distinct()
    chosen = edges.groupBy(*_PATTERN).agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= min_seeds)
    chosen = work.keep(chosen.select(*_PATTERN), "chosen")
    # Hashes that two patterns or a pattern and another pair of words share are told apart here.
    hits = work.keep(_second_reading(source, _bitmaps(chosen)).join(chosen, _PATTERN, "left_semi"), "hits")
    scores = score(hits, rounds, work)

    added = hits.where("text_key is not null").join(scores.where(F.col("score") >= confidence).select(*_PATTERN), _PATTERN, "left_semi")
    added = added.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return first.select("doc_id", "text_key", F.col("spans").alias("base")).join(added, same, "left").drop("_id", "_key").withColumn("added", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))


def _digest(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; same columns."""
    own = uuid.uuid4().hex  # no column of the table has such names
    found = find(docs, id_col=id_col, text_col=text_col, **how).select(F.col("doc_id").alias(f"id_{own}"), F.col("text_key").alias(f"key_{own}"), F.array_sort(F.array_union("base", "added")).alias(f"spans_{own}"))
    found = found.where(F.size(f"spans_{own}") > 0).dropDuplicates([f"id_{own}", f"key_{own}"])
    at, names = docs.columns.index(text_col), docs.columns
    same = docs[id_col].cast("long").eqNullSafe(F.col(f"id_{own}")) & (F.xxhash64(docs[text_col].cast("string")) == F.col(f"key_{own}"))
    joined = docs.join(found, same, "left").select(*[docs[f"`{c}`"] for c in names], F.col(f"spans_{own}"))
    schema = StructType([f if f.name != text_col else StructField(text_col, StringType()) for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, spans in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                text, own = value.as_py(), spans.as_py()
                if own and text:
                    parts, end = [], 0
                    for x in own:
                        if x["end"] > end:
                            if x["start"] >= end:
                                parts += [text[end : x["start"]], f"[{KINDS[x['kind']].upper()}]"]
                            end = x["end"]
                    text = "".join([*parts, text[end:]])
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(lean(run), schema)


def _count(spans: str, kind: int) -> Column:
    # The lambda takes the element alone: a second parameter, even with a default, would be the element's place.
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def digest_columns(found: DataFrame) -> DataFrame:
    counts = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.array_sort(F.array_union("base", "added"))
    return found.select("doc_id", *counts, F.sha2(_digest(F.array_sort("base")), 256).alias("base_sha256"), _digest(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op10_pii(spark, sf_dir):
    """Contract query: base spans and what the bootstrapped patterns add."""
    return digest_columns(find(read_table(spark, sf_dir, "documents")))
