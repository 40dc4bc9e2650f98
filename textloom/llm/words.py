"""Vectorised word tables over Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  These are single bytes in
UTF-8, so words are found on the raw bytes of a batch without decoding.  Words and shingles are
named by 64-bit hashes: polynomial prefix sums modulo 2**64 over randomised byte values,
followed by a full avalanche step.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C17 | 3
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out, step = np.ones(n, np.uint64), 1
    out[1:2] = base & (2**64 - 1)
    while step < n:
        take = min(step, n - step)
        out[step : step + take] = out[:take] * np.uint64(pow(base, step, 2**64))
        step += take
    return out


_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = _powers(_BASE, _CHUNK)
_INV = _powers(pow(_BASE, -1, 2**64), _CHUNK)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a batch of texts.

    ``data``: the bytes; ``starts``, ``ends``: each word's bytes; ``first``: for each text the
    index of its first word, with the number of words at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = True) -> None:
        bounds, data = raw(texts)
        self.offsets = bounds
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        before = np.empty(len(data), bool)
        before[1:] = inside[:-1]
        before[:1] = False
        cuts = bounds[1:-1]
        cuts = cuts[cuts < len(data)]
        before[cuts] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), bool)
        after[:-1] = inside[1:]
        after[-1:] = False
        after[cuts[cuts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Each word's text, by its place in the batch."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return range_hashes(self.data, self.starts, self.ends)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; ranges are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK - 1, "right")))
        n = int(ends[to - 1] - base)
        power, inverse = (_POW, _INV) if n < _CHUNK else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2**64), n + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data[base : base + n]] * power[:n], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and bytes of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, at, data = texts.buffers()
    bounds = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return bounds - bounds[0], np.zeros(0, np.uint8)
    return bounds - bounds[0], np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles, sorted.

    A text of 1 to n-1 words has one shingle, its whole sequence; one without words has none.
    """
    if len(hashes) >= n:
        rolled = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            rolled = rolled * _SHINGLE + hashes[k : len(hashes) - n + 1 + k]
        rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = whole * _SHINGLE + hashes[k : k + 1]
            yield mix(whole)
        else:
            yield np.zeros(0, np.uint64)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of text; a longer text stands alone.

    Unless ``keep`` says that the task needs them, what modules keep in the worker is dropped first.
    """
    if not keep:
        for drop in CACHES:
            drop()
        give_back()
    for batch in batches:
        bounds, _ = raw(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


#: What drops a module's tables kept in the worker process; workers go on to other stages.
CACHES: list[Callable[[], object]] = []
_LIBC = ctypes.CDLL(ctypes.util.find_library("c"))


def give_back() -> None:
    """Returns freed memory to the system; a worker outlives its task and would hold it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)
