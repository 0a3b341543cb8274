"""Vectorised word splitting and hashing of Arrow text columns.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D); A-Z are lower-cased.
Multi-byte characters never contain those bytes, so bytes and code points agree. Words are known by a
64-bit hash: a polynomial over random byte values modulo 2^64, mixed with the length. Two different words
of one corpus share a hash with a probability of about (distinct words)^2 / 2^65.

Nulls count as empty texts. Work goes in slices of about ``SLICE`` bytes (one longer text is a slice of its
own), so temporary arrays stay small whatever the size of the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1_000_000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: differences of its powers keep as few factors 2 as can be
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all (splitmix64's last step)."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of a number modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) <= n:
            step = U64(pow(self.base, len(self.values), 1 << 64))
            with np.errstate(over="ignore"):
                self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n + 1]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def release() -> None:
    """Gives back what Arrow's allocator has kept: a worker keeps it while it waits for its next task, in other stages too."""
    pa.default_memory_pool().release_unused()


def tidy(run: Callable) -> Callable:
    """``run``, a function of batches, with unused memory given back after each batch and at the end."""
    def tidied(batches):
        for out in run(batches):
            yield out
            del out
            release()
        release()
    return tidied


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of consecutive texts: byte ranges, hashes and, for each text, where its words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def texts(self, chosen: np.ndarray) -> list[str]:
        """The chosen words as strings."""
        if not len(chosen):
            return []
        starts, sizes = self.starts[chosen], self.ends[chosen] - self.starts[chosen] + 1
        stops = np.cumsum(sizes)
        at = np.arange(stops[-1]) + np.repeat(starts - stops + sizes, sizes)
        out = self.data[np.minimum(at, len(self.data) - 1)]
        out[stops - 1] = 0x20
        return out[:-1].tobytes().decode().split(" ")


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word goes over the end of its text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    space = SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[inner] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[inner - 1] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte range."""
    if not len(starts):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTES[data] * _UP.upto(len(data))[:-1], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _DOWN.upto(len(data))[starts]
        return mix(raw + mix((ends - starts).astype(U64)))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    if lower:
        data = LOWER[data]
    return hashed(data, offsets, *spans(data, offsets))


def hashed(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
    return Words(data, starts, ends, range_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def batches_of_words(column: pa.Array, lower: bool = True, limit: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    """``(first text, end, words)`` for slices of a text column."""
    data, offsets = buffers(column)
    for i, j in slices(offsets, limit):
        yield i, j, words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lower)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` consecutive values; of the whole sequence if it is shorter, none if empty."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - n + 1, U64(n))
        for k in range(n):
            out = mix(out * U64(0x2545F4914F6CDD1D) + hashes[k:len(hashes) - n + 1 + k])
    return out
