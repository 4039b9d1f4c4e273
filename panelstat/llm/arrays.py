"""Sorted arrays that blocks of documents and partitions of hashes send each other, packed into binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U, NULL_ID = np.uint64, np.int64(2**63 - 1)


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().cast(pa.int64()).fill_null(int(NULL_ID)), np.int64)


def parts(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition of each sorted hash by its leading bits: the partitions that occur and where each begins (one end more)."""
    part = (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(h) else np.zeros(0, np.int64)
    return part[at], np.append(at, len(h))


def grouped(h: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct h, ascending, with the least and the largest v of each."""
    if not len(h):
        return h, v, v
    order = np.argsort(h)
    h, v = h[order], v[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[at], np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which x are in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def blobs(block: int, bits: int, h: np.ndarray, *payloads: np.ndarray) -> pa.Table:
    part, at = parts(h, bits)
    cols = [[p[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] for p in payloads]
    return pa.table([pa.array(part, pa.int64()), pa.array(np.full(len(part), block), pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], names=["_part", "_block", *[f"_p{i}" for i in range(len(cols))]])
