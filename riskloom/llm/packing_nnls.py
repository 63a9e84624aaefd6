"""Packing by non-negative least squares over a length histogram.

Piece lengths are counted in units of a few ids. All combinations of up to
``depth`` lengths that fill a window exactly are enumerated; non-negative least
squares finds how often each should be used to match the histogram; the repeat
counts are rounded to what the histogram has; and what is left is packed greedily
in the histogram (longest first, with the longest that still fits), again as
repeated combinations. All of this works on at most window / unit counts, however
many documents there are. The pieces then take their places by their rank within
their length, which follows from counts per task and length: no order over all
pieces, no group gathered. The ids travel once, as bytes, to their sequence, where
:func:`filled` joins and pads them.

Defined results: a null or empty text is its end id alone; a document longer than
the window is cut into whole windows and a rest; repeated rows are packed each; an
empty table gives no rows; extra columns are ignored; pieces of one length are
placed in the order in which the tasks read them, so another split of the input
may place them otherwise.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.shared import in_arrow, kept
from riskloom.llm.tokens import encoder, pieces_of, tokenizer_path
from riskloom.llm.words import in_pieces, ranges

WINDOW = 2048
UNIT = 8
DEPTH = 3
END_ID = 1
#: Counts per task and length are broadcast up to this many rows of 16 bytes, and joined by a shuffle beyond.
BROADCAST_STARTS = 1 << 20

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _kind(path: str) -> str:
    """How ids are stored on the way: two bytes each where the tokenizer's ids fit."""
    return "<u2" if encoder(path).whole.get_vocab_size() <= 1 << 16 else "<u4"


def _cut(path: str, window: int, end_id: int, with_ids: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in in_pieces(batches):
            ids, row, start, length, at, size = pieces_of(enc, batch.column(1), window, end_id)
            flat = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * a: 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [
                batch.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(size, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                stored = np.ascontiguousarray(ids, _kind(path))
                bounds = (np.concatenate(([0], np.cumsum(length))) * stored.itemsize).astype(np.int32)
                columns.append(pa.Array.from_buffers(
                    pa.binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(stored.tobytes())]))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return work


def pieces(
    docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """The pieces of every document with their ids as bytes, or without where asked for. One narrow stage."""
    schema = PIECE + (", ids binary" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(rows, _cut(tokenizer or tokenizer_path(), window, end_id, with_ids), schema)


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All descending tuples of up to ``depth`` positive numbers with the sum ``units``."""
    out: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(chosen)
        elif len(chosen) < depth:
            for n in range(min(left, chosen[-1] if chosen else left), 0, -1):
                extend((*chosen, n), left - n)

    extend((), units)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method; ``rounds`` bounds the columns tried."""
    gram, rhs, n = a.T @ a, a.T @ b, a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, float(np.abs(rhs).max(initial=0.0)))
    for _ in range(rounds or 3 * a.shape[0]):
        gain = np.where(active, -np.inf, rhs - gram @ x)
        j = int(np.argmax(gain))
        if gain[j] <= slack:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            part = gram[np.ix_(on, on)]
            s = np.linalg.solve(part + 1e-10 * np.eye(len(on)), rhs[on])
            if s.min(initial=1.0) > 0:
                x[:] = 0
                x[on] = s
                break
            bad = s <= 0
            step = (x[on][bad] / np.maximum(x[on][bad] - s[bad], 1e-300)).min()
            x[on] += step * (s - x[on])
            active[on[x[on] <= 1e-12]] = False
            x[~active] = 0
    return x


def plan(histogram: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with repeat counts that use every counted piece exactly once."""
    left = np.zeros(units + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    out: list[tuple[tuple[int, ...], int]] = []

    def use(combo: tuple[int, ...], want: int) -> None:
        parts = Counter(combo)
        times = min(want, *(int(left[n]) // m for n, m in parts.items()))
        if times > 0:
            out.append((combo, times))
            for n, m in parts.items():
                left[n] -= m * times

    use((units,), int(left[units]))
    if left.any():
        combos = [c for c in combinations(units, depth) if len(c) > 1 and all(left[n] for n in c)]
        if combos:
            a = np.zeros((units, len(combos)))
            for j, combo in enumerate(combos):
                for n in combo:
                    a[n - 1, j] += 1
            x = nnls(a, left[1:].astype(np.float64))
            for j in np.argsort(-x, kind="stable"):
                if x[j] >= 0.5:
                    use(combos[j], int(round(x[j])))
    while left.any():
        n = int(np.flatnonzero(left)[-1])
        combo, space, taken = [n], units - n, Counter([n])
        while space:
            fits = np.flatnonzero(left[: space + 1])
            fits = [m for m in fits[::-1].tolist() if left[m] > taken[m]]
            if not fits:
                break
            combo.append(fits[0])
            taken[fits[0]] += 1
            space -= fits[0]
        use(tuple(combo), 1 << 62)
    return out


def _places(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and pieces per sequence of each combination that uses it."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for combo, times in made:
        for n, m in Counter(combo).items():
            rows.setdefault(n, []).append((used[n], sequence, m))
            used[n] += m * times
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def _seat(places: dict):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(batch.schema.get_field_index("units")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            seat = np.empty(batch.num_rows, np.int64)
            for n in np.unique(units):
                mine = units == n
                first, sequence, each = places[int(n)]
                k = np.searchsorted(first, rank[mine], side="right") - 1
                seat[mine] = sequence[k] + (rank[mine] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(seat, pa.int64())], names=[*batch.schema.names, "sequence_id"])

    return work


def _read(kind: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            flat = np.frombuffer(b"".join(batch.column(at).to_pylist()), kind).astype(np.int32)
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return work


def packed(
    docs: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, tokenizer: str | None = None,
    end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """The pieces with ``sequence_id`` (gapless from 0) and ``offset`` in the sequence, and their ids."""
    tokenizer = tokenizer or tokenizer_path()
    before = Window.partitionBy("sequence_id").orderBy(*_in_sequence()).rowsBetween(Window.unboundedPreceding, -1)
    rows = _placed(docs, window, unit, depth, tokenizer, end_id, with_ids).withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("part", "units", "nth", "rank")
    schema = ", ".join(f"`{n}` {'array<int>' if n == 'ids' else k}" for n, k in rows.dtypes)
    return in_arrow(rows, _read(_kind(tokenizer)), schema) if with_ids else rows


def _numbered(cut: Callable, unit: int, units: int):
    """The pieces with their length in units and their number among the task's pieces of that length."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(units + 1, np.int64)
        for batch in cut(batches):
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            size = -(-length // unit)
            order = np.argsort(size, kind="stable")
            alike = size[order]
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.searchsorted(alike, alike) + seen[alike]
            seen += np.bincount(size, minlength=units + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(size.astype(np.int32)), pa.array(nth)], names=[*batch.schema.names, "units", "nth"])

    return work


def _placed(docs: DataFrame, window: int, unit: int, depth: int, tokenizer: str, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces with ids as bytes, ``sequence_id``, and ``units, part, nth``, which order the pieces of a sequence.

    A piece's rank among those of its length is its number in its task plus the counts
    of the tasks before, so only those counts are shuffled, no piece.
    """
    if window % unit:
        raise ValueError("the unit must divide the window")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = PIECE + (", ids binary" if with_ids else "") + ", units int, nth long"
    cut = in_arrow(rows, _numbered(_cut(tokenizer, window, end_id, with_ids), unit, window // unit), schema)
    whole = kept(cut.withColumn("part", F.spark_partition_id()), "pieces", "zstd")
    before = Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = whole.groupBy("part", "units").agg(F.count(F.lit(1)).alias("n"))
    starts = kept(counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "starts")
    histogram = {r["units"]: r["n"] for r in starts.groupBy("units").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(histogram, window // unit, depth))
    few = starts.count() <= BROADCAST_STARTS
    starts = starts.drop("n")
    ranks = whole.join(F.broadcast(starts) if few else starts, ["part", "units"]).withColumn(
        "rank", F.col("nth") + F.col("ahead")).drop("ahead")
    return in_arrow(ranks, _seat(places), ", ".join(f"`{n}` {k}" for n, k in ranks.dtypes) + ", sequence_id long")


def _in_sequence() -> list[Column]:
    """How the pieces of one sequence lie: longest first."""
    return [F.desc("units"), F.col("part"), F.col("nth")]


def sequences(packed_rows: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids`` padded to the window, from pieces that carry their ids.

    A sequence with a power of two of ids is left as it is. A group holds at most
    one window of ids.
    """
    rows = packed_rows.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - n))
    return rows.withColumn("ids", F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(padded))


def _fill(kind: str, window: int, pad_id: int):
    """Pieces by sequence and offset: their ids joined and padded, and each measured where it lies."""
    def made(rows: pa.Table) -> pa.RecordBatch:
        col = {n: rows.column(n).to_numpy() for n in ("sequence_id", "length")}
        length, first = col["length"], np.flatnonzero(np.diff(col["sequence_id"], prepend=-1))
        used = np.add.reduceat(length, first)
        size = np.where(used & (used - 1) == 0, used, window)
        bounds = np.concatenate(([0], np.cumsum(size)))
        flat = np.full(bounds[-1], pad_id, "<u4")
        flat[ranges(bounds[:-1], used)] = np.frombuffer(b"".join(rows.column("ids").to_pylist()), kind)
        count = np.diff(np.append(first, len(length)))
        ahead = np.cumsum(length) - length
        offset = ahead - np.repeat(ahead[first], count)
        at, view = (np.repeat(bounds[:-1], count) + offset).tolist(), memoryview(flat).cast("B")
        crc = [zlib.crc32(view[4 * a: 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
        # Each sequence comes once, with its first piece.
        shown = np.full(len(length), -1, np.int64)
        shown[first] = np.arange(len(first))
        whole = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
        own = {"ids_crc32": pa.array(crc, pa.int64()), "offset": pa.array(offset, pa.int64()),
               "sequence": whole.take(pa.array(shown, mask=shown < 0))}
        return pa.RecordBatch.from_arrays(
            [own[n] if n in own else rows.column(n).combine_chunks() for n in _FILLED], names=list(_FILLED))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            # The last sequence may go on in the next batch.
            number = rows.column("sequence_id").to_numpy()
            cut = int(np.searchsorted(number, number[-1]))
            if cut:
                yield made(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield made(held)

    return work


_FILLED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence")


def filled(
    docs: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, tokenizer: str | None = None,
    end_id: int = END_ID, pad_id: int = 0,
) -> DataFrame:
    """Every sequence padded like those of :func:`sequences`, beside its first piece, and the pieces that lie in them.

    ``length`` ids from ``offset`` on in the sequence are the piece's, and
    ``ids_crc32`` is theirs as they lie there; ``sequence`` is null beside the
    other pieces. A task holds one batch of pieces at a time.
    """
    tokenizer = tokenizer or tokenizer_path()
    rows = _placed(docs, window, unit, depth, tokenizer, end_id, True)
    dealt = rows.repartition("sequence_id").sortWithinPartitions("sequence_id", *_in_sequence())
    return in_arrow(dealt, _fill(_kind(tokenizer), window, pad_id), PIECE + ", sequence_id long, offset long, sequence array<int>")
