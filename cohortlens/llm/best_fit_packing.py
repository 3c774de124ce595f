"""Packing of documents into sequences (operator 5): a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits in one sequence. The program covers each length's count
with as few configurations as it can. Multiplicative weights solve it: each length has a price that falls
as the length is covered, a knapsack dynamic program finds the configuration of the highest price, and that
configuration is used until a length in it is covered (or for a small share of all sequences); each step's
prices give a lower bound. Rounding keeps the whole part of each configuration's use; what is left over
goes by best fit decreasing into their room and new sequences. The plan is never worse than best fit alone.

The histogram has no more entries than a sequence has tokens, so the driver's work and memory are bounded
whatever the number of documents. Documents are tokenised once; the assignment numbers the pieces of each
length in hash blocks (no task holds a whole length) and looks them up in the plan.

Null texts are empty: one separator. Repeated rows are packed each on its own. An empty table gives an
empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, lean, per_process, read_table

SEPARATOR = 0
BLOCKS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# The added token of the vocabulary: its string in a text is that one id.
SPECIAL = {"<|endoftext|>": 50256}


def load_encoder(rank_path: str, pattern: str):
    """The byte-level BPE of a rank file, as a function; per process. Its ids equal those of the JSON vocabulary."""

    def make():
        import tiktoken

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        own = tiktoken.Encoding("cohortlens", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)

        def encode(text: str) -> list[int]:
            if any(token in text for token in SPECIAL):
                return own.encode(text, allowed_special="all")
            return own.encode_ordinary(text)

        return encode

    return per_process(("bpe", rank_path), make)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = length % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, length, capacity)]


def tokenize_pieces(docs: DataFrame, rank_path: str, pattern: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece; ``with_ids`` adds the ids themselves as array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(rank_path, pattern)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            out: list[tuple] = []
            tokens: list[list[int]] = []
            for doc_id, text in zip(ids_of, batch.column(1)):
                ids = np.append(np.asarray(encode(text.as_py() or ""), "<u4"), np.uint32(SEPARATOR)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    out.append((doc_id, k, start, length, zlib.crc32(own.tobytes())))
                    if with_ids:
                        tokens.append(own.astype("i4").tolist())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([r[i] for r in out], kinds[i]) for i in range(5)]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lean(run), PIECES + (", ids array<int>" if with_ids else ""))


def _price_out(prices: np.ndarray, capacity: int) -> Counter:
    """Unbounded knapsack: the multiset of lengths of the highest total price that fits. prices: by length, -inf where none is left."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        value = prices[c:0:-1] + best[:c]  # the longest first, which wins among equals
        j = int(value.argmax())
        if value[j] > best[c - 1]:
            best[c], pick[c] = value[j], c - j
        else:
            best[c] = best[c - 1]
    config: Counter = Counter()
    c = capacity
    while c > 0:
        if pick[c]:
            config[int(pick[c])] += 1
            c -= int(pick[c])
        else:
            c -= 1
    return config


def solve_configurations(histogram: dict[int, int], capacity: int, eta: float = 2.0, share: float = 0.005, gap: float = 0.005) -> tuple[list[tuple[float, Counter]], float]:
    """Fractional uses of configurations that cover each length's count, and a lower bound of the program.

    Multiplicative weights on the dual: a length's price starts at its volume and falls by exp(-eta * part
    covered). A step uses the configuration of the highest price; it is as large as ``share`` of all
    sequences, or until a length in it is covered. Prices over the price of that configuration are feasible
    in the dual, so each step gives a bound. What is over when a part ``gap`` of the volume is left, at any
    size of the input, is left to rounding.
    """
    lengths = np.arange(capacity + 1)
    demand = np.zeros(capacity + 1)
    for k, n in histogram.items():
        if 0 < k < capacity:
            demand[k] = n
    left = demand.copy()
    volume = float(lengths @ demand)
    bound = volume / capacity
    used: list[tuple[float, Counter]] = []
    while lengths @ left > gap * volume:
        open_ = left > 1e-9
        covered = 1 - np.divide(left, demand, out=np.zeros_like(left), where=demand > 0)
        weights = np.where(open_, lengths * np.exp(-eta * covered), 0.0)
        config = _price_out(np.where(open_, weights, -np.inf), capacity)
        bound = max(bound, float(weights @ demand) / sum(weights[k] * n for k, n in config.items()))
        times = min([share * max(1.0, volume / capacity), *(left[k] / n for k, n in config.items())])
        used.append((times, config))
        for k, n in config.items():
            left[k] = max(0.0, left[k] - n * times)
    return used, bound


def best_fit(histogram: dict[int, int], capacity: int, bins: dict[tuple, int] | None = None) -> Counter:
    """Best fit decreasing: each item goes where it leaves the least room. Configurations, as sorted pairs, with their numbers.

    ``bins`` are there from the start. Equal bins are one entry with a number, and equal items are placed
    many at a time, so the work follows the lengths and not the items.
    """
    room: list[Counter] = [Counter() for _ in range(capacity + 1)]
    free = np.zeros(capacity + 1, dtype=bool)

    def put(config: tuple, n: int) -> None:
        k = capacity - sum(length * m for length, m in config)
        room[k][config] += n
        free[k] = True

    for config, n in (bins or {}).items():
        put(config, n)
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            k = int(free[length:].argmax()) + length
            if free[k]:
                config, there = room[k].popitem()
                free[k] = bool(room[k])
            else:
                k, config, there = capacity, (), n
            most = k // length  # a bin in use is the best fit for the next item, too
            full = min(there, n // most)
            for take, number in ((most, full), (n, 1 if full < there and 0 < n < most else 0), (n - full * most, 1 if full and full < there and n - full * most else 0)):
                if number and take:
                    put(tuple(sorted((Counter(dict(config)) + Counter({length: take})).items(), reverse=True)), number)
                    n -= take * number
                    there -= number
            if config and there:
                put(config, there)
    out: Counter = Counter()
    for bins_ in room:
        out += bins_
    return out


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """Whole uses of configurations that hold exactly the items of the histogram.

    The program's uses are rounded down; what is left goes by best fit, into their room too. Best fit alone
    is taken where that needs fewer sequences.
    """
    items = Counter({k: n for k, n in histogram.items() if n > 0})
    left = items.copy()
    whole: Counter = Counter()
    if left.get(capacity):
        whole[((capacity, 1),)] += left.pop(capacity)
    for times, config in solve_configurations(left, capacity)[0]:
        n = min([int(times + 1e-9), *(left[k] // m for k, m in config.items())])
        if n > 0:
            whole[tuple(sorted(config.items(), reverse=True))] += n
            for k, m in config.items():
                left[k] -= m * n
    found = min(best_fit(+left, capacity, whole), best_fit(items, capacity), key=lambda c: c.total())
    return [(n, Counter(dict(config))) for config, n in sorted(found.items(), reverse=True)]


def _lookup(plan: list[tuple[int, Counter]], capacity: int):
    """For each length, intervals of ranks: first rank, first sequence, items of the length a sequence, offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for times, config in plan:
        offset = 0
        for length, n in sorted(config.items(), reverse=True):
            rows.setdefault(length, []).append((ranks[length], sequence, n, offset))
            ranks[length] += n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, dtype=np.int64).T for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (one row a piece, with ``doc_id``, ``piece``, ``length``; read twice, so written down) with sequence_id and offset."""
    spark = pieces.sparkSession
    # At most ``capacity`` rows.
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(_lookup(plan_packing(histogram, capacity), capacity))

    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BLOCKS)).cast("int"))
    starts = blocked.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    in_block = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        blocked.withColumn("_place", F.row_number().over(in_block))
        .join(starts, ["length", "_block"])
        .withColumn("sequence_id", F.col("_start") + F.col("_place") - 1)
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("_block", "_place", "_start")
    )
    names = ranked.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("sequence_id")).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts):
                first, seq, n, off = plan[int(length[own[0]])]
                at = np.searchsorted(first, rank[own], side="right") - 1
                within = rank[own] - first[at]
                sequence[own] = seq[at] + within // n[at]
                offset[own] = off[at] + (within % n[at]) * length[own]
            columns = list(batch.columns)
            columns[names.index("sequence_id")], columns[names.index("offset")] = pa.array(sequence), pa.array(offset)
            yield pa.RecordBatch.from_arrays(columns, names)

    return ranked.mapInArrow(lean(place), ranked.schema)


def pack_documents(docs: DataFrame, rank_path: str, pattern: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    work = Workspace(docs.sparkSession, "packing")
    pieces = work.keep(tokenize_pieces(docs, rank_path, pattern, capacity, id_col, text_col, with_ids), "pieces")
    out = pack(pieces, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.select(*names, *(["ids"] if with_ids else []))


def op5_config_lp(spark, sf_dir):
    """Contract query: all documents in sequences of at most 2,048 tokens."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 2048)
