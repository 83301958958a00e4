"""Hashed n-grams of a whole Arrow batch of texts at once, from the bytes of its buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial hashes (golden ratio and a prime near 2^63).
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)

# Letters A-Z to lower case, control characters and space to space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[:33] = 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    start = int(offsets[0]) if len(offsets) else 0
    return raw[start : int(offsets[-1]) if len(offsets) else 0], offsets - start


def pieces(offsets: np.ndarray, size: int):
    """Row ranges [a, z) whose bytes come to about size; a row is never cut."""
    a, n = 0, len(offsets) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(z, n)
        a = z


def fold(raw: np.ndarray) -> np.ndarray:
    return _FOLD[raw]


def char_grams(raw: np.ndarray, width: int, bits: int) -> np.ndarray:
    """A bucket for each window of `width` folded bytes; one fewer than width positions fewer than bytes."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        h *= STEP
        h += raw[k : k + n]
    h *= MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def words(raw: np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of folded bytes, and where each starts. No word runs over an offset."""
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    letter = raw != 32
    begin = np.concatenate(([True], ~letter[:-1]))
    if offsets is not None:
        begin[offsets[offsets < len(raw)]] = True
    starts = np.flatnonzero(letter & begin)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    place = np.zeros(len(raw), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    value = (raw.astype(np.uint64) + np.uint64(1)) * _power(int(place.max()) + 1)[place]
    value[~letter] = 0
    h = np.add.reduceat(value, starts)
    h ^= h >> np.uint64(29)
    return h * MIX, starts


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 4096), STEP))), dtype=np.uint64)
    return _powers


def word_grams(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of single words, and of pairs of neighbouring words (one fewer); a word and itself make one common pair."""
    one = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    two = ((hashes[:-1] * STEP + hashes[1:]) * MIX >> np.uint64(64 - bits)).astype(np.int64)
    two[hashes[:-1] == hashes[1:]] = 0
    return one, two
