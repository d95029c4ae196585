"""Vectorised word scanning over Arrow string buffers.

Text stays in the UTF-8 buffer that Arrow hands over; words, their hashes and windows of words are numpy arrays
over many documents at once. A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 are
never part of a longer character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text scanned at a time; a longer document is scanned alone.
SPAN = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_QINV = np.uint64(pow(int(_Q), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[int(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (every input bit reaches every output bit)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(texts: pa.Array, limit: int = SPAN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them); nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    """Words of several documents: byte ranges, document index, hash, and first word of each document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # length documents + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    n = len(data)
    solid = np.zeros(n + 1, dtype=bool)
    np.logical_not(BLANK[data], out=solid[:n])
    begin = solid[:n].copy()
    begin[1:] &= ~solid[: n - 1] if n else begin[1:]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    begin[inner] = solid[inner]
    start = np.flatnonzero(begin)
    stop = solid[:n] & ~solid[1:]
    last = inner[inner > 0] - 1
    stop[last] = solid[last]
    end = np.flatnonzero(stop) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h = np.zeros(0, dtype=np.uint64)
    if hashed:
        h = range_hash(LOWER[data] if lower else data, start, end)
    return Words(start, end, doc, h, first)


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair, in time linear in the data."""
    n = len(data)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=acc[1:])
    h = (acc[end] - acc[start]) * powers(_PINV, n + 1)[start]
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for each i; the caller masks windows that leave a document."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * powers(_Q, n), out=acc[1:])
    out = (acc[k:] - acc[:-k]) * powers(_QINV, n)[: n - k + 1]
    return mix(out + np.uint64(k))


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of h[start:end] for each pair."""
    acc = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(_Q, len(h)), out=acc[1:])
    return mix((acc[end] - acc[start]) * powers(_QINV, len(h) + 1)[start] + (end - start).astype(np.uint64))


def windows_inside(first: np.ndarray, n_windows: int, k: int) -> np.ndarray:
    """Mask of window starts 0..n_windows-1 whose k words lie in one document."""
    ok = np.ones(n_windows, dtype=bool)
    for j in range(1, k):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < n_windows)]] = False
    return ok


def characters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points in each row: bytes that don't continue a character."""
    acc = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=acc[1:])
    return acc[offsets[1:]] - acc[offsets[:-1]]
