"""Words of whole texts as arrays: maximal runs of bytes other than space and tab to carriage return."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is one piece of its own.
PIECE_BYTES = 4 << 20


def as_large(texts: pa.Array) -> pa.Array:
    """Null texts become empty; offsets get 64 bits."""
    return texts.cast(pa.large_string()).fill_null("")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the ``n + 1`` bounds of the texts in them."""
    texts = as_large(texts)
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[bounds[0]: bounds[-1]], bounds - bounds[0]


def in_pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; every row comes exactly once."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index(text)
        _, bounds = text_bytes(batch.column(at))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def _cut(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, the bounds of the words in them, and the bounds of the texts in the words."""
    data, starts = text_bytes(texts)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    opens = starts[:-1][starts[:-1] < starts[1:]]
    first[opens] = solid[opens]
    begins = np.flatnonzero(first)
    ends = np.cumsum(solid, dtype=np.int64)
    offsets = np.empty(len(begins) + 1, np.int64)
    offsets[:-1] = ends[begins] - 1
    offsets[-1] = ends[-1] if len(ends) else 0
    return np.ascontiguousarray(data[solid]), offsets, np.searchsorted(begins, starts).astype(np.int64)


class Words:
    """Words of some texts: ``codes`` into ``distinct`` (bytes), with ``bounds`` per text."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        compact, offsets, self.bounds = _cut(texts, lower)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(compact)])
        encoded = words.dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct: list[bytes] = encoded.dictionary.to_pylist()

    @property
    def counts(self) -> np.ndarray:
        """Words per text."""
        return np.diff(self.bounds)


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same on every machine."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def hashed(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, as :func:`hashes` gives it, and the bounds of the texts in them."""
    compact, offsets, bounds = _cut(texts, lower)
    return _xxh64(compact, offsets), bounds


# The constants of the hash.
_XXH = tuple(np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer words are hashed one by one: the hash treats them in stripes.
_SHORT = 31


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _xxh64(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each stretch of the bytes, all stretches at a time."""
    p1, p2, p3, p4, p5 = _XXH
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight, four = (np.ndarray((len(data) + 1,), kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    at, left = offsets[:-1].copy(), np.diff(offsets)
    long = np.flatnonzero(left > _SHORT)
    left[long] = 0
    h = left.astype(np.uint64) + p5
    while len(some := np.flatnonzero(left >= 8)):
        h[some] = _turned(h[some] ^ (_turned(eight[at[some]] * p2, 31) * p1), 27) * p1 + p4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero(left >= 4)
    h[some] = _turned(h[some] ^ (four[at[some]].astype(np.uint64) * p1), 23) * p2 + p3
    at[some] += 4
    left[some] -= 4
    while len(some := np.flatnonzero(left > 0)):
        h[some] = _turned(h[some] ^ (padded[at[some]].astype(np.uint64) * p5), 11) * p1
        at[some] += 1
        left[some] -= 1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    h[long] = hashes([data[offsets[k]: offsets[k + 1]].tobytes() for k in long.tolist()])
    return h


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds; empty stretches give zero."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]
