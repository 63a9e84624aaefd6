"""Approximate nearest neighbours by an inverted multi-index (largest inner product).

Vectors are split in two halves and each half is quantised by its own centroids,
so a vector lies in a cell of a grid. For a query, cells are visited in the order
of the summed closeness of their two centroids, found with a heap over the two
sorted lists, until enough entries are covered; the entries of those cells are
ranked again on the original vectors.

The number of centroids follows the number of rows, so that a cell holds about
one block of entries whatever the table (up to ``most_centroids`` per half). The
centroids and the part of the entries that must be covered for the wanted recall
are fitted on a bounded sample (smallest hashed ids): ``sample_rows`` vectors, or
``per_centroid`` for each centroid if that is more. Every row is indexed. Queries
go to the cells they visit; a cell is cut into blocks of entries and of the
queries that visit it, and a task works on one block of each, so entries are
copied only where more than one block of queries comes to their cell.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors of another length than most; with fewer
than k candidates all that are found come out; ties go to the smaller id; every
row is an entry of its own, also copies of a vector and rows that repeat an id:
each such row asks for itself (so its ``query_id`` has every rank once per row)
and is a candidate of the others; a null id takes no part; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.shared import deliver, in_arrow, kept, smallest_hashed


@dataclass(frozen=True)
class MultiIndex:
    """Least and most centroids per half; bounds of the sample; ``recall`` aimed at on it; block sizes."""

    centroids: int = 8
    most_centroids: int = 1_024
    sample_rows: int = 10_000
    per_centroid: int = 40
    test_queries: int = 200
    recall: float = 0.96
    entry_block: int = 4_000
    query_block: int = 2_000
    seed: int = 10

    def centroids_for(self, rows: int) -> int:
        """Centroids per half: a cell for each block of entries."""
        wanted = math.isqrt(-(-rows // self.entry_block))
        return max(self.centroids, min(self.most_centroids, wanted))


@dataclass(frozen=True)
class Fitted:
    """Centroids of both halves, the part of the entries to cover, and the sample it came from."""

    left: np.ndarray
    right: np.ndarray
    cover: float
    sample_ids: np.ndarray
    sample: np.ndarray


def usable(vec: Column) -> Column:
    """Vectors that take part."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 25) -> np.ndarray:
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        for j in range(k):
            mine = x[near == j]
            centers[j] = mine.mean(axis=0) if len(mine) else x[rng.integers(len(x))]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centers.T - (centers * centers).sum(axis=1) / 2, axis=1)


def cells_of(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    half = left.shape[1]
    return _nearest(x[:, :half], left) * len(right) + _nearest(x[:, half:], right)


def visited(query: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, need: float) -> list[int]:
    """Cells in descending order of summed closeness until their sizes add up to ``need``."""
    half = left.shape[1]
    a, b = left @ query[:half], right @ query[half:]
    i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, seen, out, have = [(-(a[i_of[0]] + b[j_of[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and have < need:
        _, i, j = heapq.heappop(heap)
        cell = int(i_of[i]) * len(right) + int(j_of[j])
        if sizes[cell]:
            out.append(cell)
            have += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(left) and y < len(right) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[i_of[x]] + b[j_of[y]]), x, y))
    return out


def fit(vectors: DataFrame, plan: MultiIndex, k: int, rows_in_all: int) -> Fitted | None:
    """Centroids and coverage from the bounded sample; None without vectors."""
    centroids = plan.centroids_for(rows_in_all)
    rows = smallest_hashed(vectors, max(plan.sample_rows, plan.per_centroid * centroids), "vec_id", plan.seed).collect()
    if not rows:
        return None
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    x = np.array([r["vec"] for r in rows], np.float64)
    rng = np.random.default_rng(plan.seed)
    half = (x.shape[1] + 1) // 2
    left, right = _kmeans(x[:, :half], centroids, rng), _kmeans(x[:, half:], centroids, rng)
    cell = cells_of(x, left, right)
    sizes = np.bincount(cell, minlength=len(left) * len(right))
    tests = x[: plan.test_queries]
    scores = tests @ x.T
    scores[np.arange(len(tests)), np.arange(len(tests))] = -np.inf
    top = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(x) - 1))]
    # Share of the sample covered when each true neighbour is reached; the quantile that gives the recall.
    reached = []
    for q, near in zip(tests, top, strict=True):
        order = visited(q, left, right, sizes, np.inf)
        ahead = np.zeros(len(sizes))
        ahead[order] = np.cumsum(sizes[order])
        reached.append(ahead[cell[near]] / len(x))
    cover = float(np.quantile(np.concatenate(reached), plan.recall))
    return Fitted(left, right, cover, ids, x)


def _assign(fitted: Fitted):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cells_of(x, fitted.left, fitted.right), pa.int32())], names=[*batch.schema.names, "cell"])

    return work


def _probe(fitted: Fitted, sizes: np.ndarray, k: int):
    """Each query (row, query_id, vec) with the ``cells`` it visits and its ``floor``.

    ``floor`` is the k-th best score among the sampled entries of the cells it
    visits: entries below it cannot be among its k nearest found.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = max(fitted.cover * sizes.sum(), k + 1)
        home = cells_of(fitted.sample, fitted.left, fitted.right)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                ids = part.column(1).to_numpy(zero_copy_only=False)
                x = np.array(part.column(2).to_pylist(), np.float64)
                scores = x @ fitted.sample.T
                scores[ids[:, None] == fitted.sample_ids[None, :]] = -np.inf
                cells = [visited(q, fitted.left, fitted.right, sizes, need) for q in x]
                seen = np.zeros(len(sizes), bool)
                for line, own in zip(scores, cells, strict=True):
                    seen[own] = True
                    line[~seen[home]] = -np.inf
                    seen[own] = False
                if scores.shape[1] > k:
                    floor = np.partition(scores, -k, axis=1)[:, -k] - 1e-9
                else:
                    floor = np.full(len(scores), -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(floor), pa.array(cells, pa.list_(pa.int32()))], names=[*part.schema.names, "floor", "cells"])

    return work


def _rerank(k: int):
    schema = pa.schema([
        ("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def work(key, entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return schema.empty_table()
        e_id, e_row = (entries.column(n).to_numpy() for n in ("vec_id", "row"))
        q_id, q_row, floors = (queries.column(n).to_numpy() for n in ("query_id", "row", "floor"))
        e, q = (np.array(t.column("vec").to_pylist(), np.float64) for t in (entries, queries))
        made = []
        # A few queries at a time: many equal vectors may all reach the floor.
        for low in range(0, len(q), 64):
            own = slice(low, low + 64)
            scores, floor = q[own] @ e.T, floors[own]
            scores[q_row[own, None] == e_row[None, :]] = -np.inf
            if scores.shape[1] > k:
                floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k] - 1e-9)
            i, j = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
            exact = np.zeros(len(i))
            for d in range(e.shape[1]):
                exact += q[low + i, d] * e[j, d]
            order = np.lexsort((e_row[j], e_id[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, exact = low + i[place < k], j[place < k], exact[place < k]
            made.append(pa.table([q_row[i], q_id[i], e_row[j], e_id[j], exact], schema=schema))
        return pa.concat_tables(made)

    return work


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, plan: MultiIndex = MultiIndex(), vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest entries found for each row where ``queries`` holds."""
    spark = vectors.sparkSession
    deliver(spark)
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    widths = rows.groupBy(F.size("vec").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    result = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("vec") == widths["w"])
    fitted = fit(rows, plan, k, widths["n"])
    kind = dict(rows.dtypes)["vec"]
    # The number of a row is fixed by writing it: it tells rows that repeat an id apart.
    entries = kept(in_arrow(rows, _assign(fitted), f"vec_id long, vec {kind}, asks boolean, cell int").withColumn(
        "row", F.monotonically_increasing_id()), "entries")
    sizes = np.zeros(len(fitted.left) * len(fitted.right), np.int64)
    counts = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    for r in counts.collect():
        sizes[r["cell"]] = r["n"]
    asked = entries.where("asks").select("row", F.col("vec_id").alias("query_id"), "vec")
    probes = kept(in_arrow(
        asked, _probe(fitted, sizes, k), f"row long, query_id long, vec {kind}, floor double, cells array<int>"), "probes")
    # Blocks per cell, by its entries and by the queries that visit it: at most most_centroids ** 2 rows.
    visits = probes.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.broadcast(counts.join(visits, "cell").select(
        "cell", F.ceil(F.col("n") / plan.entry_block).cast("int").alias("blocks"),
        F.ceil(F.col("m") / plan.query_block).cast("int").alias("query_blocks")))

    def spread(over: str, by: str) -> Column:
        return F.pmod(F.xxhash64(F.col(by)), F.col(over)).cast("int")

    def every(over: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(over) - 1))

    blocked = entries.select("row", "vec_id", "vec", "cell").join(blocks, "cell").withColumn(
        "block", spread("blocks", "row")).withColumn("query_block", every("query_blocks")).drop("blocks", "query_blocks")
    asking = probes.withColumn("cell", F.explode("cells")).drop("cells").join(blocks, "cell").withColumn(
        "query_block", spread("query_blocks", "row")).withColumn("block", every("blocks")).drop("blocks", "query_blocks")
    keys = ["cell", "block", "query_block"]
    found = blocked.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(
        _rerank(k), "query_row long, query_id long, row long, vec_id long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
