"""Best-fit-decreasing packing of token ids into rows of one window, as binary matrices.

Documents are tokenised, closed by an end id and cut into pieces of at most one
window. The pieces of a block are packed longest first, each into the fullest
open row that still holds it; a segment tree over free capacities finds that row
in logarithmic time. Every row comes out as little-endian ids padded to the
window, the cumulative lengths of its segments, and position ids that restart at
each segment.

A block is what one task has read, up to ``block_tokens`` ids, so ids are never
shuffled; a block of thousands of pieces leaves next to no padding.

Defined results: a null or empty text is its end id alone; a very long text is
several pieces; repeated rows are packed each; an empty table gives no rows;
extra columns are ignored; ties go to the piece that comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import in_arrow
from riskloom.llm.tokens import encoder, pieces_of, tokenizer_path
from riskloom.llm.words import in_pieces, ranges

WINDOW = 2048
END_ID = 49407
PAD_ID = 0
BLOCK_TOKENS = 4 << 20

SCHEMA = (
    "sequence_id long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, "
    "starts array<long>")


class CapacityTree:
    """Which free capacities occur among the open rows: add, remove, and the smallest one that is enough."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def smallest(self, need: int) -> int:
        """The smallest capacity of at least ``need``, or -1."""
        count, node = self.count, need + self.leaves
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and offset of every piece, and the number of rows."""
    tree, free = CapacityTree(window), [[] for _ in range(window + 1)]
    row, offset, rows = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        left = tree.smallest(need)
        if left < 0:
            r, left, rows = rows, window, rows + 1
        else:
            r = free[left].pop()
            tree.change(left, -1)
        row[k], offset[k] = r, window - left
        if left > need:
            free[left - need].append(r)
            tree.change(left - need, 1)
    return row, offset, rows


def _binary_rows(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    bounds = np.arange(len(matrix) + 1, dtype=np.int64) * width
    flat = pa.py_buffer(np.ascontiguousarray(matrix).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(bounds), flat]).cast(pa.binary())


def _packed(ids, doc_id, start, length, at, window: int, kind: str, first: int) -> Iterator[pa.RecordBatch]:
    row, offset, rows = best_fit_decreasing(length, window)
    order = np.lexsort((offset, row))
    row, offset, length, at = row[order], offset[order], length[order], at[order]
    doc_id, start = doc_id[order], start[order]
    ends = np.searchsorted(row, np.arange(rows + 1))
    step = max(1, (1 << 20) // window)
    for low in range(0, rows, step):
        high = min(rows, low + step)
        part = slice(ends[low], ends[high])
        n = length[part]
        place = ranges(np.zeros(len(n), np.int64), n)
        line = np.repeat(row[part] - low, n)
        column = np.repeat(offset[part], n) + place
        matrix = np.full((high - low, window), PAD_ID, kind)
        matrix[line, column] = ids[ranges(at[part], n)]
        position = np.zeros((high - low, window), kind)
        position[line, column] = place
        per_row = np.diff(ends[low: high + 1])
        bounds = np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)
        tokens = np.add.reduceat(n, bounds[:-1])
        # Each row's cumulative lengths: the offsets of its segments, then its number of ids.
        slots = bounds + np.arange(len(bounds), dtype=np.int32)
        cumulative = np.empty(len(n) + high - low, np.int32)
        cumulative[slots[1:] - 1] = tokens
        cumulative[np.arange(len(n)) + (row[part] - low)] = offset[part]
        yield pa.RecordBatch.from_arrays([
            pa.array(first + low + np.arange(high - low), pa.int64()), pa.array(tokens, pa.int32()),
            _binary_rows(matrix), _binary_rows(position),
            pa.ListArray.from_arrays(pa.array(slots), pa.array(cumulative)),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(doc_id[part], pa.int64())),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(start[part], pa.int64())),
        ], names=["sequence_id", "n_tokens", "ids", "position_ids", "cu_seqlens", "doc_ids", "starts"])


def _work(path: str, window: int, end_id: int, block_tokens: int, kind: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, held, size = encoder(path), [], 0
        first = TaskContext.get().partitionId() << 40

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, first
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            ids = np.concatenate([h[0] for h in held])
            doc_id, start, length = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            at = np.concatenate([h[4] + base[k] for k, h in enumerate(held)])
            held, size = [], 0
            for out in _packed(ids, doc_id, start, length, at, window, kind, first):
                first += out.num_rows
                yield out

        for batch in in_pieces(batches):
            ids, row, start, length, at, _ = pieces_of(enc, batch.column(1), window, end_id)
            doc_id = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            held.append((ids, doc_id[row], start, length, at))
            size += len(ids)
            if size >= block_tokens:
                yield from flush()
        if held:
            yield from flush()

    return work


def packed(
    docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS, wide: bool = False,
) -> DataFrame:
    """One row per packed sequence (:data:`SCHEMA`).

    Ids and position ids are unsigned 16-bit numbers, 32-bit when ``wide`` (for
    vocabularies or windows above 65 536). ``doc_ids`` and ``starts`` name the
    document and first id of each segment (a null id shows as -1). ``sequence_id`` is unique; it is made of
    the number of the partition read and a counter.
    """
    kind = "<u4" if wide or window > 65_536 else "<u2"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    work = _work(tokenizer or tokenizer_path(), window, end_id, block_tokens, kind)
    return in_arrow(rows, work, SCHEMA)


def write(packed_rows: DataFrame, path: str) -> None:
    """Write the matrices: one Parquet row per sequence, a file per task."""
    packed_rows.write.mode("overwrite").parquet(path)


def unpacked(ids: bytes, cu_seqlens: list[int], wide: bool = False) -> list[list[int]]:
    """The segments of one written row, for readers of the files."""
    flat = np.frombuffer(ids, "<u4" if wide else "<u2")
    return [flat[a:b].tolist() for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False)]
