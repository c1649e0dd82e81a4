"""Compact byte strings for hash postings that Spark shuffles.

A posting list is shipped as one binary value per (chunk, bucket): integers are
delta coded where sorted and laid out in byte planes, so that the codec of the
shuffle drops the planes that are zero.
"""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64


def planes(values: np.ndarray) -> bytes:
    """Little-endian byte planes; as many as the largest value needs."""
    n = len(values)
    top = int(values.max()) if n else 0
    width = max(1, (top.bit_length() + 7) // 8)
    cells = values.astype(U64).view(np.uint8).reshape(n, 8)[:, :width]
    return struct.pack("<IB", n, width) + np.ascontiguousarray(cells.T).tobytes()


def read_planes(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    n, width = struct.unpack_from("<IB", blob, at)
    at += 5
    cells = np.zeros((n, 8), dtype=np.uint8)
    if n:
        cells[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
    return cells.reshape(-1).view(U64), at + n * width


def rising(values: np.ndarray) -> bytes:
    """Planes of the differences of ascending unsigned values."""
    v = values.astype(U64)
    return planes(np.diff(v, prepend=U64(0)))


def read_rising(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    d, at = read_planes(blob, at)
    return np.cumsum(d, dtype=U64), at


def bucket_of(hashes: np.ndarray, n_buckets: int, bits: int = 64) -> np.ndarray:
    """The range of the hash space, of n_buckets equal ones, that each hash falls in."""
    top = hashes >> U64(bits - 32)
    return ((top * U64(n_buckets)) >> U64(32)).astype(np.int64)


def group_starts(sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    starts = group_starts(sorted_values).tolist()
    return list(zip(starts, [*starts[1:], len(sorted_values)][: len(starts)], strict=True))


def only(blobs) -> bytes:
    """The one table of documents of a chunk; two would mean that chunks were mixed."""
    if len(blobs) != 1:
        raise AssertionError(f"a chunk has {len(blobs)} tables of documents")
    return blobs.iloc[0]
