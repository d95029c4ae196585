"""Exchange of 64-bit keys between chunks of documents and buckets of keys.

A chunk sends each bucket its distinct keys, sorted, with counts; the bucket merges what chunks sent and answers in
the order in which each chunk asked. However often a key occurs, a chunk sends it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillspark.llm._common import lean

_U = np.uint64


# Blobs: sorted 64-bit keys as byte planes of their differences, and small counts as bytes with a list of larger ones,
# both compressed.


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def pack_keys(k: np.ndarray) -> bytes:
    return squeezed(np.diff(k, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(unsqueezed(b), dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=_U)


def pack_counts(c: np.ndarray) -> bytes:
    at = np.flatnonzero(c >= 255)
    return squeezed(np.array([len(c), len(at)], dtype="<i8").tobytes() + np.minimum(c, 255).astype(np.uint8).tobytes() + at.astype("<i8").tobytes() + c[at].astype("<i8").tobytes())


def unpack_counts(b: bytes) -> np.ndarray:
    b = unsqueezed(b)
    n, m = np.frombuffer(b, dtype="<i8", count=2)
    c = np.frombuffer(b, dtype=np.uint8, count=n, offset=16).astype(np.int64)
    c[np.frombuffer(b, dtype="<i8", count=m, offset=16 + n)] = np.frombuffer(b, dtype="<i8", count=m, offset=16 + n + 8 * m)
    return c


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of keys, equal shares of the 64-bit numbers."""
    return (((key >> _U(40)) * _U(n)) >> _U(24)).astype(np.int64)


def distinct(key: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(sorted distinct keys of each bucket, place of each key in the buckets' keys laid end to end)."""
    order = np.argsort(key)
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
    place = np.empty(len(k), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    k = k[new]
    return np.split(k, np.searchsorted(bucket_of(k, n), np.arange(1, n))), place


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows sorted by their first ``keys`` columns, a table for each key."""
    lean()
    at, held = None, []
    for b in batches:
        lead = list(zip(*(c.to_pylist() for c in b.columns[:keys]), strict=True))
        i = 0
        while i < len(lead):
            j = i + 1
            while j < len(lead) and lead[j] == lead[i]:
                j += 1
            if lead[i] != at and held:
                yield at, pa.Table.from_batches(held)
                held = []
            at = lead[i]
            held.append(b.slice(i, j - i))
            i = j
    if held:
        yield at, pa.Table.from_batches(held)
    held = []
    lean(end=True)


#: Rows that chunks send.
PIECE = "kind int, bucket int, chunk int, keys binary, counts binary"


def piece(kind: int, chunk: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """PIECE rows of one chunk: keys and counts by bucket, without buckets that get none."""
    on = [i for i, k in enumerate(keys) if len(k)]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(on), pa.int32()), pa.array(on, pa.int32()), pa.array([chunk] * len(on), pa.int32()), pa.array([pack_keys(keys[i]) for i in on], pa.binary()), pa.array([pack_counts(counts[i]) for i in on], pa.binary())],
        ["kind", "bucket", "chunk", "keys", "counts"],
    )


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(keys, counts summed, [(chunk, places of its keys)])."""
    chunks = table.column("chunk").to_pylist()
    pieces = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    keys, place = np.unique(np.concatenate(pieces), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()]), minlength=len(keys)).astype(np.int64)
    return keys, counts, list(zip(chunks, np.split(place, np.cumsum([len(p) for p in pieces])[:-1]), strict=True))


