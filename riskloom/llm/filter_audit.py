"""Audit of how filters interact: what each removes, in every order of applying them (DataFrame functions only).

Four filters look at a text alone; the fifth fails a text that a smaller id has
too. For that one, a counting Bloom sketch of all texts is filled first: each task
counts the cells its texts fall on, the counts are merged, and a text that has a
cell to itself is unique for certain. Only the texts left, the possible repeats,
are shuffled; grouped by the whole text, they give the exact smallest id.

The failures of a document are one number, a bit for each filter. The audit needs
just the documents per (part, number): all orders are worked out from these sums,
so the table is read twice however many orders there are.

Bounds: the sketch has 16 cells per document, 2^28 at most; as a bit per cell it
is broadcast (at most 36 MB). Beyond that size more unique texts are shuffled, the
result stays the same. Copies are counted in each task before any shuffle.

Defined results: a null text is an empty text, a null part is the empty string; a
row with a null id never fails as a duplicate, and no row does by a null id;
rows that repeat an id and its text are all alike; a document is good (toxic) if
any of its label rows says so, labels that are null or name no document count for
nothing; an empty table gives no rows; other columns are ignored. Two texts of one
id are told apart by 128 bits of hash, all else by the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import kept

SPACES = r"[\x20\x09-\x0D]+"
DUPLICATE = "E"

#: Cells of one block of the sketch (all cells of a text lie in one), per document, and blocks at most.
BLOCK_CELLS, CELLS_PER_ROW, MOST_BLOCKS = 4096, 16, 1 << 16
#: Cells a text falls on.
PROBES = 3


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: few words, few distinct words, many capitals, odd signs."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    few_and_plain = F.transform(F.array(words), lambda w: F.struct(
        (F.size(w) < 200).alias("few"), (F.size(F.array_distinct(w)) * 100 < F.size(w) * 50).alias("plain")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"AB": few_and_plain, "C": capitals * 100 > F.length(text) * 2, "D": F.rlike(text, F.lit("[#$%&*|]"))}


def _mask(failures: Column) -> Column:
    bits = [F.col("f.AB.few"), F.col("f.AB.plain"), F.col("f.C"), F.col("f.D")]
    return sum((F.when(b, F.lit(1 << k)).otherwise(0) for k, b in enumerate(bits)), F.lit(0)).cast("int")


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(12), text).alias("k2")]


def facts(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, mask, k1, k2`` of every row, kept as a table: failures of the text alone and two hashes of it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.struct(*(c.alias(n) for n, c in text_failures(text).items())).alias("f"), *_keys(text))
    return kept(rows.select("doc_id", "part", _mask(F.col("f")).alias("mask"), "k1", "k2"), "audit_facts")


def _block(blocks: int) -> Column:
    return F.pmod("k1", F.lit(blocks)).cast("int")


def _cells() -> list[Column]:
    return [F.shiftrightunsigned("k2", 12 * j).bitwiseAND(F.lit(BLOCK_CELLS - 1)).cast("int") for j in range(PROBES)]


def sketch(keys: DataFrame, blocks: int) -> DataFrame:
    """``block, words``: a bit for each cell that at least two rows fall on, kept as a table.

    Counts are added up per cell within each task, then merged over tasks.
    """
    cells = keys.select(_block(blocks).alias("block"), F.explode(F.array_distinct(F.array(*_cells()))).alias("cell"))
    counters = cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    bit = F.expr("shiftleft(1L, cell & 63)")
    words = counters.groupBy("block", F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    per_block = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_CELLS // 64 - 1)), lambda w: F.coalesce(
        F.try_element_at("m", w), F.lit(0).cast("long")))
    return kept(per_block.select("block", dense.alias("words")), "audit_sketch")


def possible_repeats(keys: DataFrame, cells: DataFrame, blocks: int) -> DataFrame:
    """Add ``repeat``: False where the sketch proves that no other row has the text."""
    held = F.lit(True)
    for cell in _cells():
        held &= F.getbit(F.get("words", F.shiftright(cell, 6)), cell.bitwiseAND(F.lit(63))) == 1
    marked = keys.withColumn("block", _block(blocks)).join(F.broadcast(cells), "block", "left")
    return marked.withColumn("repeat", F.coalesce(held, F.lit(False))).drop("block", "words")


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents per set of failed filters; the sums of parts of a table add up."""
    known = facts(docs, part)
    blocks = min(MOST_BLOCKS, max(1, -(-known.count() * CELLS_PER_ROW // BLOCK_CELLS)))
    cells = sketch(known, blocks)

    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *_keys(text))
    again = possible_repeats(texts, cells, blocks).where("repeat")
    firsts = again.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    first = kept(firsts.select("doc_id", *_keys(F.col("text")), F.lit(True).alias("is_first")), "audit_firsts")

    open_case = F.col("repeat") & F.col("doc_id").isNotNull()
    rows = possible_repeats(known, cells, blocks).groupBy(
        "doc_id", "part", "mask", *(F.when(open_case, F.col(k)).alias(k) for k in ("k1", "k2"))).agg(F.count(F.lit(1)).alias("n"))
    judged = rows.join(first.distinct(), ["doc_id", "k1", "k2"], "left")
    later = F.col("k1").isNotNull() & F.col("is_first").isNull()
    says = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    flagged = judged.withColumn("mask", F.col("mask") + F.when(later, F.lit(16)).otherwise(0)).groupBy(
        "doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(says, "doc_id", "left")
    only = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).cast("long").alias(c)
    return flagged.groupBy("part", "mask").agg(F.sum("n").cast("long").alias("n"), only("good"), only("toxic"))


def _bit(letters: str, letter: Column) -> Column:
    """The bit of a filter; 0 for the empty string."""
    return sum((F.when(letter == name, F.lit(1 << k)).otherwise(0) for k, name in enumerate(letters)), F.lit(0))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps, removes and costs.

    ``letters`` names the filters in the order of their bits. ``shapley`` is what the
    filter removes, summed over all orders.
    """
    return effects(mask_counts(docs, labels, part), letters)


def effects(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """The audit from the documents per (part, mask)."""
    per_part = kept(counts.groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")), "audit_masks")
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    steps = F.sequence(F.lit(1), F.lit(len(letters)))
    rows = per_part.select("part", "masks", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(steps).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), "")
    before = F.aggregate(earlier, F.lit(0), lambda a, c: a + _bit(letters, c))
    rows = rows.withColumn("bit", _bit(letters, letter)).withColumn("before", before)

    def total(holds: Callable[[Column], Column], field: str = "n", weight: Callable[[Column], Column] | None = None) -> Column:
        def add(a: Column, x: Column) -> Column:
            value = x[field] if weight is None else x[field] * weight(x["mask"])
            return a + F.when(holds(x["mask"]), value).otherwise(F.lit(0).cast("long"))

        return F.aggregate("masks", F.lit(0).cast("long"), add)

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    all_orders = F.lit(math.factorial(len(letters))).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"), total(here).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"), total(lambda m: m == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        total(fails, "n", lambda m: F.floor(all_orders / F.bit_count(m)).cast("long")).alias("shapley"))
