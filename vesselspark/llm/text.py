"""Words of whole Arrow columns as numpy arrays: spans, 64-bit hashes and rolling window hashes, all on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word: space and the five ASCII control spaces.
SPACES = np.ones(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words when only ASCII letters, digits and what lies above ASCII count.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Maps A-Z to a-z, other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@lru_cache(None)
def mix_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, seed: int) -> np.ndarray:
    have = _POWERS.get(seed)
    if have is None or len(have) < n:
        base = np.full(max(n, 64), np.uint64(0x9E3779B97F4A7C15 + 2 * seed), np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if len(have) > 1 << 20:  # rare: not kept
            return have
        _POWERS[seed] = have
    return have


def finish(h: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column has about `most` bytes in each; a row is never cut."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        total, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of several texts: byte spans [start, end), document, and position in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACES):
        self.data, self.offsets = data, offsets
        self.inside = inside[data]
        first, last = self.inside.copy(), self.inside.copy()
        first[1:] &= ~self.inside[:-1]
        last[:-1] &= ~self.inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = self.inside[cuts]
        last[cuts - 1] = self.inside[cuts - 1]
        self.first = first
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.n = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.base = np.cumsum(self.n) - self.n
        self.pos = np.arange(len(self.start)) - self.base[self.doc]

    def hashes(self, seed: int = 1, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (after fold)."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at = np.arange(len(self.data)) - self.start[np.maximum(np.cumsum(self.first) - 1, 0)]
        at[~self.inside] = 0
        part = mix_table(seed)[self.data if fold is None else fold[self.data]] * powers(int((self.end - self.start).max()), seed)[at]
        part[~self.inside] = 0
        return finish(np.add.reduceat(part, self.start) + (self.end - self.start).astype(np.uint64))

    def windows(self, hashes: np.ndarray, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each window of `size` words of one document."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        where = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        total, power = np.zeros(n, np.uint64), powers(size, seed + 100)
        for k in range(size):
            total += hashes[k : k + n] * power[k]
        return where, finish(total[where])


def pack(values: np.ndarray) -> bytes:
    """An integer array as zstd bytes, split by byte plane so that small numbers cost little."""
    values = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T) if len(values) else np.zeros(0, np.uint8)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel() if n else np.zeros(0, kind)
