"""Words of whole text columns as numpy arrays: byte masks, spans and 64-bit hashes, many documents at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes handled at once; a longer document makes a slice of its own.
SLICE = 1 << 20

#: Ranges of up to so many bytes are hashed together, longer ones one by one.
SHORT = 64
_STEP = 0x9E3779B97F4A7C15
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in one array and the n + 1 offsets of the values; null is empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(col: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `size` bytes of text each."""
    _, at = text_bytes(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words before each document (n + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~GAP[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = at[:-1][at[:-1] < at[1:]]
    begin[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cuts[1:] - 1] = inside[cuts[1:] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number each; zeros beyond the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def equal(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each byte range holds the same bytes as the range whose number stands in `other`."""
    live = np.flatnonzero(other != np.arange(len(other)))
    size = ends - starts
    if (size[live] != size[other[live]]).any():
        return False
    long = live[size[live] > SHORT]
    if any(not np.array_equal(raw[starts[i] : ends[i]], raw[starts[j] : ends[j]]) for i, j in zip(long.tolist(), other[long].tolist(), strict=True)):
        return False
    eight, step = eights(raw), 0
    live = live[size[live] <= SHORT]
    while len(live):
        mask = _FIRST[np.minimum(size[live] - step, 8)]
        if (((eight[starts[live] + step] ^ eight[starts[other[live]] + step]) & mask) != 0).any():
            return False
        step += 8
        live = live[size[live] > step]
    return True


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges. Short ranges take eight bytes at a time, mixed with all before them, so that up
    to eight bytes no two of one length share a hash; longer ones have their BLAKE2."""
    size = ends - starts
    out = mix((size.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP))
    eight = eights(raw)
    live = np.flatnonzero((size > 0) & (size <= SHORT))
    step = 0
    while len(live):
        chunk = eight[starts[live] + step] & _FIRST[np.minimum(size[live] - step, 8)]
        out[live] = mix(out[live] * np.uint64(_STEP) ^ chunk)
        step += 8
        live = live[size[live] > step]
    long = np.flatnonzero(size > SHORT)
    for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        out[i] = int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little")
    return out


def word_hashes(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words before each row (n + 1 values)."""
    parts, counts = [], [np.zeros(1, np.int64)]
    before = 0
    for lo, hi in slices(col):
        raw, at = text_bytes(col.slice(lo, hi - lo))
        if lower:
            raw = LOWER[raw]
        starts, ends, words = spans(raw, at)
        parts.append(hashes(raw, starts, ends))
        counts.append(words[1:] + before)
        before += len(starts)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(counts)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n values in a row; len(h) - n + 1 values."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n if len(out) else 0):
        out = mix(out * np.uint64(_STEP) + h[i : len(h) - n + 1 + i] + np.uint64(n))
    return out
