"""Vectorised hashing of words, byte strings and sliding windows over Arrow text batches (numpy only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95))
_TABLES = [np.random.default_rng(7 + i).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1) for i in range(2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(stream)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (int(_BASES[stream]), pow(int(_BASES[stream]), -1, 1 << 64)):
            a = np.full(size, b, _U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _POWERS[stream] = (out[0], out[1])
    return have


def _prefix(values: np.ndarray, stream: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _powers(len(values) + 1, stream)[0][: len(values)], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, stream: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each pair, from the prefix sums of the sequence."""
    return mix((prefix[end] - prefix[start]) * _powers(len(prefix), stream)[1][start] + (end - start).astype(_U))


class Texts:
    """One slice of an Arrow text column: bytes, document bounds, words."""

    def __init__(self, col: pa.Array):
        col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
        col = col.fill_null(b"") if col.null_count else col
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = col.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
        self.bounds = off - off[0] if len(col) else np.zeros(1, np.int64)
        self.n = len(col)

    def byte_prefix(self, stream: int = 0) -> np.ndarray:
        return _prefix(_TABLES[stream][self.data], stream)

    def find_words(self) -> None:
        """Sets start, end (bytes), wb: the bounds of each document in the sequence of all words."""
        solid = ~_SPACE[self.data]
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.bounds] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.wb = np.searchsorted(self.start, self.bounds)

    def word_hashes(self, stream: int = 0) -> np.ndarray:
        return spans_hash(self.byte_prefix(stream), self.start, self.end, stream)


def doc_of(bounds: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, positions, "right") - 1


def windows(values: np.ndarray, length: int, stream: int = 0) -> np.ndarray:
    """Hash of each run of `length` values (empty if there are too few)."""
    if len(values) < length:
        return np.zeros(0, _U)
    p = _prefix(values, stream)
    n = len(values) - length + 1
    return mix((p[length:] - p[:n]) * _powers(len(p), stream)[1][:n])


def inside(bounds: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n window starts keep the whole window of `length` inside one document."""
    left = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return np.arange(n) + length <= left


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each run of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(grams: np.ndarray, ok: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """grams: a hash for each position; ok: which windows of `width` grams are whole.

    Returns the smallest hash of each window (0 where not whole) and the flags of positions that are smallest in
    some whole window. Equal windows choose equal positions, so what repeats is found from chosen positions alone.
    """
    low = sliding(grams, width, np.minimum)
    low = np.where(ok[: len(low)], low, _U(0))
    pad = np.zeros(width - 1, _U)
    high = sliding(np.concatenate((pad, low, pad)), width, np.maximum)
    return low, high == grams


def last_equal(grams: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """The last position of each window of `width` grams that holds the window's smallest hash."""
    n = len(low)
    out = np.arange(n) + width - 1
    open_ = np.flatnonzero(grams[out] != low)
    for back in range(2, width + 1):
        if not len(open_):
            break
        at = open_ + width - back
        out[open_] = at
        open_ = open_[grams[at] != low[open_]]
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows again in slices of about `most` bytes (what fits in a core's cache); a longer document stands alone."""
    for batch in batches:
        size = np.fromiter((x or 0 for x in _lengths(batch.column(batch.schema.get_field_index(column)))), np.int64, batch.num_rows)
        part = np.cumsum(size) // most
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def _lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
