"""Vectorised word splitting and hashing used inside Arrow tasks.

A *word* is a maximal run of characters other than space and U+0009..U+000D.
All functions work on a :class:`Chunk`, a few megabytes of whole documents laid
out in one byte buffer, so that numpy does the per-character work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

U64 = np.uint64
CHUNK_BYTES = 4 << 20
STRETCH_BYTES = 256 << 10
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_WINDOW_MULTIPLIER = 0xD1B54A32D192ED03
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """multiplier**i and its inverse modulo 2**64 for i <= n; grown on demand."""
    have = _powers.get(multiplier)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, STRETCH_BYTES + 1)
        out = []
        for m in (multiplier, pow(multiplier, -1, 1 << 64)):
            p = np.full(size, m, dtype=U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= CHUNK_BYTES:
            _powers[multiplier] = have
    return have


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2**64, then mixed) of values[starts:ends] from prefix sums."""
    up, down = powers(multiplier, len(values))
    prefix = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


@dataclass
class Chunk:
    """Whole documents in one buffer. first[d]:first[d + 1] are the words of document d."""

    rows: np.ndarray
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hashes(self, fold_case: bool = False) -> np.ndarray:
        """A hash a word. Bytes are taken in stretches of whole words, as they need 50 bytes of memory each."""
        out = [np.zeros(0, dtype=U64)]
        a = 0
        while a < len(self.starts):
            low = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, low + STRETCH_BYTES, side="right")))
            raw = self.raw[low : self.ends[b - 1]]
            if fold_case:
                raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
            h = rolling(_BYTE_CODES[raw], self.starts[a:b] - low, self.ends[a:b] - low, _MULTIPLIER)
            out.append(mix(h + (self.ends[a:b] - self.starts[a:b]).astype(U64)))
            a = b
        return np.concatenate(out)

    def gram_hashes(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of every n consecutive words of one document, with document and position."""
        count = np.maximum(self.n_words - (n - 1), 0)
        doc = np.repeat(np.arange(len(count)), count)
        base = np.concatenate(([0], np.cumsum(count)))[:-1]
        pos = np.arange(len(doc)) - np.repeat(base, count)
        at = self.first[doc] + pos
        return rolling(words, at, at + n, _WINDOW_MULTIPLIER), doc, pos

    def whole_hashes(self, words: np.ndarray) -> np.ndarray:
        """The hash of each document's whole word sequence."""
        h = rolling(words, self.first[:-1], self.first[1:], _WINDOW_MULTIPLIER)
        return mix(h ^ (self.n_words.astype(U64) + U64(0x5851F42D4C957F2D)))


def chunk_key(seen: int) -> int:
    """A key that no other chunk of the stage has: the partition of the task and the number of its chunk, the same on a retry."""
    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 32) | seen


def key_bucket(key: int, n_buckets: int) -> int:
    """Where the table of a chunk travels: spread, as keys of one partition follow each other."""
    return int(mix(np.array([key], dtype=U64))[0] % U64(n_buckets))


def chunk_of(rows: np.ndarray, texts: list[bytes]) -> Chunk:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return Chunk(rows, raw, starts, ends, np.searchsorted(starts, bounds))


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole documents; a null text has no words."""
    texts = column.cast(pa.large_binary()).to_pylist()
    begin, size = 0, 0
    for k, t in enumerate(texts):
        texts[k] = t = t or b""
        if size and size + len(t) > CHUNK_BYTES:
            yield chunk_of(np.arange(begin, k), texts[begin:k])
            begin, size = k, 0
        size += len(t) + 1
    if begin < len(texts):
        yield chunk_of(np.arange(begin, len(texts)), texts[begin:])
