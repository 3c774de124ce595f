"""Approximate nearest neighbours by an inverted multi-index (operator 9).

The two halves of each vector are quantised separately; a pair of centroids is a cell. A query visits cells
by the sum of its two half distances, taken in order from a heap, until they hold ``target`` vectors, and
what they hold is ranked again by the exact Euclidean distance of the original vectors.

The codebooks are fitted on a bounded sample (``sample`` rows, chosen by a hash of their ids); every row is
indexed. ``target`` is measured, not guessed: ``probes`` vectors are compared with all rows, and it is the
least number that reaches ``recall`` of their true neighbours. On vectors without structure that is a large
part of all rows, and the index degrades to a scan in blocks.

Cells are dealt in blocks of about ``BLOCK`` entries (a large cell to several) and queries in chunks; a task
compares a block with a chunk, for the cells that each query visits, and emits a query's nearest only. Equal vectors are one entry that carries as many of its smallest ids as a query can want, and equal
queries are one search, so a vector that many rows share costs no more than any other. A query whose cells
were all visited has been compared with everything. Recall against brute force is measured in the tests.

Vectors that are null, empty, zero, of another length than most, or with null or non-finite components take
no part, neither as queries nor as candidates. Repeated ids of one vector count once. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, read_table


BLOCK = 4096
CHUNK = 2048


def codebook(points: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means centroids."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = ((points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)).argmin(1)
        for c in range(len(centers)):
            own = points[near == c]
            if len(own):
                centers[c] = own.mean(0)
    return centers


def half_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1))


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, target: float) -> list[tuple[int, int]]:
    """Cells in order of summed distance until they hold ``target`` entries; empty cells are passed over."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[a[0]] + second[b[0]], 0, 0)]
    pushed = {(0, 0)}
    out, held = [], 0
    while heap and held < target:
        _, i, j = heapq.heappop(heap)
        n = int(counts[a[i], b[j]])
        if n:
            out.append((int(a[i]), int(b[j])))
            held += n
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in pushed:
                pushed.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))
    return out


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(q: np.ndarray, v: np.ndarray, first: np.ndarray, allowed: np.ndarray | None, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its place, places of its nearest k entries (ties to the smaller ``first``), distances.

    A matrix product ranks roughly, on vectors moved to the mean of the entries; all that its error could
    put among the nearest are ranked by differences of the original vectors.
    """
    mean = v.mean(0) if len(v) else np.zeros(v.shape[1])
    near, far = q - mean, v - mean
    squares, own_squares = (far**2).sum(1), (near**2).sum(1)
    rough = squares - 2 * near @ far.T
    if allowed is not None:
        rough = np.where(allowed, rough, np.inf)
    most = squares.max(initial=0.0)
    for r in range(len(q)):
        reachable = np.isfinite(rough[r])
        n = int(reachable.sum())
        if not n:
            yield r, np.zeros(0, np.int64), np.zeros(0)
            continue
        kth = np.partition(rough[r], min(k, n) - 1)[min(k, n) - 1]
        # Rounding of the sums and of the centred components themselves.
        error = 8 * (v.shape[1] + 4) * np.finfo(float).eps * (most + own_squares[r] + np.sqrt(most + own_squares[r]) * (np.abs(mean).max(initial=0.0) + np.abs(q[r]).max(initial=0.0)) * v.shape[1])
        own = np.flatnonzero(reachable & (rough[r] <= kth + 2 * error))
        exact = np.sqrt(((v[own] - q[r]) ** 2).sum(1))
        order = np.lexsort((first[own], exact))[:k]
        yield r, own[order], exact[order]


def calibrate(orders: list[list[tuple[int, int]]], wanted: list[list[tuple[int, int]]], counts: np.ndarray, recall: float) -> int:
    """Entries that a traversal must hold to reach ``recall`` of the wanted cells, over all probes."""
    needs = []
    for order, cells in zip(orders, wanted):
        total = np.cumsum([counts[c] for c in order])
        at = {c: k for k, c in enumerate(order)}
        # The traversal goes on until it holds the target: the cells before must hold less.
        needs += [int(total[at[c]]) for c in cells]
    return int(np.quantile(needs, recall, method="higher")) if needs else 1


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    recall: float = 0.97,
    probes: int = 100,
    per_cell: int = 40,
    sample: int = 20_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each query row, itself excluded."""
    spark = vectors.sparkSession
    work = Workspace(spark, "multi-index")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = int(widths["w"])
    rows = rows.where(F.size("v") == width).dropDuplicates(["id", "v"])

    # Classes of equal vectors: the smallest k + 1 ids, enough for any query of the class itself.
    place = Window.partitionBy("key", "v").orderBy("id")
    least = rows.select("id", "v", F.xxhash64("v").alias("key")).withColumn("p", F.row_number().over(place)).where(F.col("p") <= k + 1)
    classes = least.groupBy("key", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = work.keep(classes.select(F.element_at("ids", 1).alias("class"), "v", "ids"), "classes")

    total = classes.count()
    fitted = np.array([r[0] for r in classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("v").collect()])
    half = (width + 1) // 2
    size = int(min(1024, max(2, round((total / per_cell) ** 0.5)), max(1, len(fitted) // 4)))
    # Halves are quantised as moved to the sample's mean, so that vectors far from zero keep their differences.
    mean = fitted.mean(0) if len(fitted) else np.zeros(width)
    centred = fitted - mean
    books = codebook(centred[:, :half], size), codebook(centred[:, half:], size) if width > half else np.zeros((1, 0))
    held = spark.sparkContext.broadcast((books, fitted[:probes]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = held.value[0]
        for batch in batches:
            x = _matrix(batch.column(1), width) - mean
            cell = half_distances(x[:, :half], one).argmin(1) * len(two) + half_distances(x[:, half:], two).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], ["class", "v", "ids", "cell"])

    entries = work.keep(classes.mapInArrow(assign, "class long, v array<double>, ids array<long>, cell long"), "entries")
    # No more rows than cells, of which there are 1024 x 1024 at most.
    shape = len(books[0]), len(books[1])
    counts = np.zeros(shape[0] * shape[1], np.int64)
    for r in entries.groupBy("cell").count().toLocalIterator():
        counts[r[0]] = r[1]
    ends = np.cumsum(counts)
    first_block, last_block = (ends - counts) // BLOCK, np.maximum(ends - 1, 0) // BLOCK

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value[1]
        for batch in batches:
            if batch.num_rows:
                v, cell, first = _matrix(batch.column(1), width), batch.column(3).to_numpy(), batch.column(0).to_numpy()
                found = [(r, int(cell[p]), float(d), int(first[p])) for r, at, far in nearest(own, v, first, None, k + 1) for p, d in zip(at, far)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found]) for i in range(4)], ["probe", "cell", "score", "class"])

    by_probe = Window.partitionBy("probe").orderBy("score", "class")
    true = entries.mapInArrow(compare, "probe long, cell long, score double, class long").withColumn("p", F.row_number().over(by_probe)).where(F.col("p") <= k + 1)
    wanted: list[list[tuple[int, int]]] = [[] for _ in fitted[:probes]]
    for r in true.select("probe", "cell").collect():
        wanted[r[0]].append(divmod(r[1], shape[1]))
    table = counts.reshape(shape)
    near, far = half_distances(centred[:probes, :half], books[0]), half_distances(centred[:probes, half:], books[1])
    target = calibrate([traverse(near[r], far[r], table, float("inf")) for r in range(len(near))], wanted, table, recall)

    chunks_ = max(1, -(-rows.where("q").count() // CHUNK))
    plan = spark.sparkContext.broadcast((table, first_block, last_block))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, start, stop = plan.value
        for batch in batches:
            cell, own = batch.column(3).to_numpy(), batch.column(0).to_numpy()
            spread = (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            block = start[cell] + spread % (stop[cell] - start[cell] + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], ["class", "v", "ids", "cell", "block"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), _ = held.value
        cells_of, start, stop = plan.value
        for batch in batches:
            x = _matrix(batch.column(1), width) - mean
            near, far = half_distances(x[:, :half], one), half_distances(x[:, half:], two)
            taken, blocks, cells = [], [], []
            for r in range(len(x)):
                by_block: dict[int, list[int]] = {}
                for i, j in traverse(near[r], far[r], cells_of, target):
                    c = i * len(two) + j
                    for b in range(start[c], stop[c] + 1):
                        by_block.setdefault(b, []).append(c)
                taken += [r] * len(by_block)
                blocks += list(by_block)
                cells += list(by_block.values())
            at = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(blocks, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], ["qclass", "qv", "block", "cells"])

    queries = rows.where("q").select("id", "v").join(classes.select(F.col("class").alias("qclass"), F.col("v").alias("cv")), F.col("v") == F.col("cv"))
    queries = work.keep(queries.select("id", "qclass", "v"), "queries")
    searches = queries.groupBy("qclass").agg(F.first("v").alias("v")).mapInArrow(visit, "qclass long, qv array<double>, block long, cells array<long>")
    searches = work.keep(searches.withColumn("chunk", F.pmod(F.xxhash64("qclass"), F.lit(chunks_)).cast("int")), "searches")
    # A block goes to the chunks that visit it, and to no other.
    visited = searches.select("block", F.col("chunk").alias("to")).distinct()
    blocks = entries.mapInArrow(deal, "class long, v array<double>, ids array<long>, cell long, block long").join(visited, "block")
    blocks = blocks.select("class", "v", "ids", "cell", "block", F.col("to").alias("chunk"))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            v, first = _matrix(left["v"].combine_chunks(), width), left["class"].to_numpy()
            cell, ids = left["cell"].to_numpy(), left["ids"].to_pylist()
            q, cells, name = _matrix(right["qv"].combine_chunks(), width), right["cells"].to_pylist(), right["qclass"].to_pylist()
            for s in range(0, len(q), 128):
                allowed = np.array([np.isin(cell, c) for c in cells[s : s + 128]])
                for r, at, far in nearest(q[s : s + 128], v, first, allowed, k + 1):
                    out += [(name[s + r], float(d), ids[p]) for p, d in zip(at, far)]
        kinds = [pa.int64(), pa.float64(), pa.list_(pa.int64())]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["qclass", "score", "ids"])

    scored = blocks.groupBy("block", "chunk").cogroup(searches.groupBy("block", "chunk")).applyInArrow(rank, "qclass long, score double, ids array<long>")
    # A class is no further than its ids: the nearest k + 1 classes hold the nearest k + 1 rows.
    by_class = Window.partitionBy("qclass").orderBy("score", F.element_at("ids", 1))
    best = scored.withColumn("p", F.row_number().over(by_class)).where(F.col("p") <= k + 1)
    by_row = Window.partitionBy("qclass").orderBy("score", "id")
    best = best.select("qclass", "score", F.explode("ids").alias("id")).withColumn("p", F.row_number().over(by_row)).where(F.col("p") <= k + 1)
    found = best.groupBy("qclass").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("found"))
    joined = queries.select(F.col("id").alias("query_id"), "qclass").join(found, "qclass")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = joined.select("query_id", F.posexplode(others).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def op9_multi_index(spark, sf_dir):
    """Contract query: rows whose id is divisible by 100 against all rows."""
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
