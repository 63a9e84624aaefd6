"""Mixing sources to target weights along a curriculum that changes over the training run.

Every source has a weight schedule over training time 0 to 1. Its integral is the
cumulative demand of the source; the source's documents, in a fixed shuffled
order and repeated where the demand asks for it, are laid along that demand, and
inverting the integral gives each copy the time at which it is trained on. The
copies of all sources are then put in one order by range-sorting on that time.

Defined results: a null text has size 0 and is taken once when its place in the
order is (it adds no words); a null source is a source of its own, last in order;
repeated rows are separate documents; an empty table gives no rows; extra columns
are kept by :func:`mixed` and ignored by :func:`allocation`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.shared import free_name, in_arrow, kept, ordered, part_of, ranked

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Curriculum:
    """Weights of the sources in order (repeating), how much to mix, and how demand moves.

    ``schedules[i]`` are the (time, relative demand) knots of sources with
    ``weights[i]``; demand is linear between knots, from time 0 to time 1.
    ``share`` is the mix's size over the size of all; no document is taken more
    than ``most`` times.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    schedules: tuple[tuple[tuple[float, float], ...], ...] = (
        ((0.0, 1.5), (0.6, 1.0), (1.0, 0.25)),
        ((0.0, 1.0), (1.0, 1.0)),
        ((0.0, 0.25), (0.6, 0.75), (1.0, 2.0)),
    )
    share: float = 1.5
    most: int = 2
    seed: int = 9


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def inverse_demand(knots: tuple[tuple[float, float], ...], share: np.ndarray) -> np.ndarray:
    """Times at which the integral of the schedule reaches the given shares of its total.

    Inside a piece demand is linear, so the integral is quadratic and is inverted
    in closed form.
    """
    t = np.array([k[0] for k in knots], np.float64)
    w = np.array([k[1] for k in knots], np.float64)
    area = np.concatenate(([0.0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))))
    goal = np.clip(share, 0.0, 1.0) * area[-1]
    k = np.clip(np.searchsorted(area, goal, side="right") - 1, 0, len(t) - 2)
    rest, low, slope = goal - area[k], w[k], (w[k + 1] - w[k]) / (t[k + 1] - t[k])
    root = np.sqrt(np.maximum(low * low + 2 * slope * rest, 0.0))
    return np.minimum(t[k] + np.where(low + root > 0, 2 * rest / np.maximum(low + root, 1e-300), 0.0), t[k + 1])


def targets(sizes: DataFrame, plan: Curriculum) -> DataFrame:
    """``source, source_size, tier, target`` of every source.

    Weights repeat over the sources in code point order, null last. A target stops
    at ``most`` times its source's size and the excess is shared again by weight,
    until none is above. Each round is one aggregate over the sources.
    """
    by_source = kept(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = ordered(by_source, F.col("source").isNull(), F.col("source"), name="source_order")
    weights = F.array(*(F.lit(float(w)) for w in plan.weights))
    numbered = ranked(order, F.lit(0), "place").select(
        "source", "source_size", F.pmod("place", F.lit(len(plan.weights))).cast("int").alias("tier"))
    numbered = kept(numbered.withColumn("weight", F.get(weights, F.col("tier"))), "weights")
    total = numbered.agg(F.sum("source_size")).first()[0]
    rate, want = 0.0, plan.share * (total or 0)
    most = F.col("source_size") * F.lit(float(plan.most))
    while want > 0:
        full = most <= F.col("weight") * F.lit(rate)
        free, used = numbered.agg(
            F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, most))).first()
        higher = (want - (used or 0.0)) / free if free else rate
        if not free or higher <= rate:
            break
        rate = higher
    return numbered.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(rate))).drop("weight")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the same source before each row of the partition; rows come in source order."""
    source, total = None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
        place = batch.column(batch.schema.get_field_index("source_no")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        new = np.flatnonzero(np.concatenate(([place[0] != source], place[1:] != place[:-1])))
        base = np.zeros(batch.num_rows, np.int64)
        carried = 0 if len(new) and new[0] == 0 else total
        stretch = np.zeros(batch.num_rows, np.int64)
        stretch[new] = 1
        number = np.cumsum(stretch)
        opening = np.concatenate(([-carried], (ends - size)[new]))
        base = opening[number]
        before = ends - size - base
        source, total = place[-1], int(before[-1] + size[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "before"])


def _prefix(rows: DataFrame) -> DataFrame:
    """Add ``start``: words of the source ahead of each row of :func:`ordered` rows.

    Totals per (partition, source) are windowed; their number is bounded by
    partitions plus sources.
    """
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + ", before long"
    sums = rows.withColumn("__p", part_of()).groupBy("source_no", "__p").agg(F.sum("size").alias("__n"))
    ahead = Window.partitionBy("source_no").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source_no").alias("__s"), "__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    inside = in_arrow(rows, _running, schema).withColumn("__q", part_of())
    same = (F.col("source_no") == F.col("__s")) & (F.col("__q") == F.col("__p"))
    return inside.join(starts, same).withColumn("start", F.col("before") + F.col("__ahead")).drop(
        "__s", "__p", "__q", "__ahead", "before")


def _times(plan: Curriculum):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            middle = col["start"] + col["size"] / 2
            goal, whole, tier = col["target"], col["source_size"], col["tier"]
            times = np.full((batch.num_rows, plan.most), np.nan)
            for k in range(plan.most):
                at = middle + k * whole.astype(np.float64)
                taken = (at < goal) | ((whole == 0) & (k == 0))
                share = np.where(goal > 0, at / np.maximum(goal, 1e-300), 0.0)
                for i in range(len(plan.weights)):
                    mine = taken & (tier == i)
                    times[mine, k] = inverse_demand(plan.schedules[i], share[mine])
            copies = (~np.isnan(times)).sum(axis=1)
            flat = times[~np.isnan(times)]
            ends = np.concatenate(([0], np.cumsum(copies))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(copies * col["size"], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=[*batch.schema.names, "taken", "times"])

    return work


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns, nulls told apart: rows that share it and their id are alike."""
    hashable = [F.to_json(F.struct(c)) if "map<" in k or k == "variant" else F.col(f"`{c}`") for c, k in docs.dtypes]
    return F.xxhash64(*hashable, *(c.isNull() for c in hashable))


def _allocated(docs: DataFrame, plan: Curriculum) -> DataFrame:
    """:func:`allocation` with ``row_no``, another number for every row."""
    sizes = kept(docs.select(
        "doc_id", "source", row_key(docs).alias("row_key"), word_count(F.col("text")).alias("size")), "sizes")
    goal = kept(targets(sizes, plan).withColumn("source_no", F.monotonically_increasing_id()), "targets")
    named = sizes.join(
        goal.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    keys = ("source_no", F.xxhash64(F.lit(plan.seed), "doc_id", "row_key"), "doc_id", "row_key", "size")
    rows = ordered(kept(named, "named"), *(F.col(k) if isinstance(k, str) else k for k in keys), name="mix_order")
    placed = _prefix(rows)
    schema = ", ".join(f"`{n}` {k}" for n, k in placed.dtypes) + ", taken long, times array<double>"
    return in_arrow(placed, _times(plan), schema).withColumnRenamed("__row", "row_no").drop("source_no", "start")


def allocation(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """``doc_id, source, row_key, size, source_size, target, taken, times`` of every row of ``docs``.

    ``times`` holds the training time of each copy the mix takes, so its length is
    the number of copies. ``row_key`` tells documents of one id apart by their columns.
    """
    return _allocated(docs, plan).drop("row_no")


def scheduled(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """:func:`allocation` with ``positions``: the place of each copy, from 0, in the training order of all copies.

    Copies are range-sorted by time, ties by their row; the sort carries no texts.
    """
    rows = kept(_allocated(docs, plan), "allocated")
    copies = rows.select("row_no", F.explode("times").alias("time"))
    placed = ranked(ordered(copies, F.col("time"), F.col("row_no"), name="training_order"), F.lit(0), "position")
    positions = placed.groupBy("row_no").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    none = F.array().cast("array<long>")
    return rows.join(positions, "row_no", "left").withColumn("positions", F.coalesce("positions", none)).drop("row_no")


def mixed(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """The copies of the rows that the mix takes, in training order, with the columns of ``docs``.

    Rows alike in all columns are counted on both sides, so a row that occurs twice
    is taken as often as its two entries say.
    """
    key, time, own = (free_name(docs, n) for n in ("row_key", "time", "own_id"))
    # Null ids are empty here (the key tells them apart), so rows are dealt once by these two, for the duplicates and for the join.
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    copies = kept(allocation(docs, plan).select(name.alias(own), F.col("row_key").alias(key), F.explode("times").alias(time)), "copies")
    once = docs.withColumns({own: name, key: row_key(docs)}).dropDuplicates([own, key])
    out = copies.join(once, [own, key])
    return out.repartitionByRange(time, key).sortWithinPartitions(time, key).select(*docs.columns)
