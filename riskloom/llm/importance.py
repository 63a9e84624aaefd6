"""Importance resampling: how much likelier a text is under target text than under raw text.

Two bag models over hashed words and word pairs are counted: one over all
documents (raw), one over the documents a label calls good (target). A document's
log-weight is the log-likelihood ratio of its n-grams. Gumbel noise that depends
on the document alone is added, and the k largest are the sample: k documents
drawn without replacement in proportion to their weights.

The target model is fitted on at most ``target_rows`` labelled documents (those
with the smallest hashed ids); the raw model and the sample cover all rows.

Defined results: a null text has no n-grams and log-weight 0; null labels are
ignored; a document labelled twice is good only if every label says so; with no
good label at all the ratio is 0 everywhere; repeated rows are weighed and drawn
each; ties go to the smaller id; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import in_arrow, kept, ordered, ranked, smallest_hashed, unit_noise
from riskloom.llm.words import Words, hashes, in_pieces, mixed, sums


@dataclass(frozen=True)
class Resampling:
    """``buckets``: hashed n-grams told apart (a power of two); ``share``: part of the rows drawn.

    ``share=None`` draws as many rows as have a log-weight of at least the cut that
    parts good labelled documents from others best, a good one lost counting
    ``good_counts`` times as much as another one drawn.
    """

    buckets: int = 1 << 17
    target_rows: int = 20_000
    smoothing: float = 0.5
    share: float | None = None
    good_counts: float = 2.0
    seed: int = 4


def _grams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbouring words, text by text, with their bounds."""
    words = Words(texts, lower=True)
    one = hashes(words.distinct)[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    n = words.counts
    two = mixed(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) if len(one) else one
    inside = np.ones(len(two), bool)
    ends = words.bounds[1:-1]
    inside[ends[(ends > 0) & (ends < len(one))] - 1] = False
    text_of = np.repeat(np.arange(len(n)), n)
    owner = np.concatenate((text_of, text_of[:-1][inside]))
    bucket = (np.concatenate((mixed(one), two[inside])) & np.uint64(buckets - 1)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(n)))))


def _count(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in in_pieces(batches):
            bucket, bounds = _grams(batch.column(0), buckets)
            raw += np.bincount(bucket, minlength=buckets)
            good = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(bounds))
            target += np.bincount(bucket[good], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    return work


def _weigh(ratio: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            bucket, bounds = _grams(batch.column(1), len(ratio))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(sums(ratio[bucket], bounds))],
                names=["doc_id", "n_grams", "log_weight"])

    return work


def _labels(labels: DataFrame) -> DataFrame:
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"))


def log_ratio(docs: DataFrame, labels: DataFrame, plan: Resampling = Resampling()) -> np.ndarray:
    """log target / raw of every bucket: ``buckets`` numbers, whatever the input."""
    good = smallest_hashed(_labels(labels).where("good = 1"), plan.target_rows, "doc_id", plan.seed)
    named = F.broadcast(good.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__good")))
    rows = docs.join(named, F.col("doc_id") == F.col("__id"), "left").select("text", F.coalesce("__good", F.lit(False)).alias("good"))
    counted = in_arrow(rows, _count(plan.buckets), "bucket long, raw long, target long")
    found = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(plan.buckets), np.zeros(plan.buckets)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    if not target.any():
        return np.zeros(plan.buckets)
    smooth = lambda c: np.log(c + plan.smoothing) - np.log(c.sum() + plan.smoothing * plan.buckets)
    return smooth(target) - smooth(raw)


def _cut(rows: DataFrame, labels: DataFrame, plan: Resampling, reach: int = 1000) -> float:
    """The log-weight that parts good labelled documents from the others; counted in at most 2 * ``reach`` steps."""
    step = F.floor(F.greatest(F.least("log_weight", F.lit(float(reach))), F.lit(float(-reach)))).cast("int")
    counted = rows.select("doc_id", step.alias("step")).join(_labels(labels), "doc_id").groupBy("step", "good").agg(
        F.count(F.lit(1)).alias("n")).collect()
    good, other = np.zeros(2 * reach + 2), np.zeros(2 * reach + 2)
    for r in counted:
        (good if r["good"] else other)[r["step"] + reach] += r["n"]
    if not good.any() or not other.any():
        return float("-inf")
    lost = np.concatenate(([0], np.cumsum(good)))[:-1] / good.sum()
    out = np.concatenate(([0], np.cumsum(other)))[:-1] / other.sum()
    best = int(np.argmax(out - plan.good_counts * lost))
    return float(best - reach) if best else float("-inf")


def resampled(docs: DataFrame, labels: DataFrame, plan: Resampling = Resampling()) -> DataFrame:
    """``doc_id, n_grams, log_weight, key, place, kept`` of every row; ``place`` is the rank by key."""
    ratio = log_ratio(docs, labels, plan)
    weights = in_arrow(docs.select("doc_id", "text"), _weigh(ratio), "doc_id long, n_grams long, log_weight double")
    noise = -F.log(-F.log(unit_noise("doc_id", seed=plan.seed)))
    rows = kept(weights.withColumn("key", F.col("log_weight") + noise), "weights")
    drawn = plan.share * rows.count() if plan.share is not None else rows.where(
        F.col("log_weight") >= _cut(rows, labels, plan)).count()
    ranks = ranked(ordered(rows, F.desc("key"), F.col("doc_id"), name="keys"), F.lit(0), "place")
    return ranks.withColumn("kept", F.col("place") < F.lit(drawn)).drop("__row")
