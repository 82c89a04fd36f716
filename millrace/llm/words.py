"""Words, shingles and their hashes for operators that work on word sequences in Python."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: bytes.split() cuts at exactly these: space and \t \n \v \f \r.
SPACES = r"\x20\x09-\x0D"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that a worker holds few documents' results at a time. At
    the end of a task freed memory goes back to the system: workers live on, and what one stage's
    hold counts beside the next's."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    bound = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Spans:
    """Hashes of any span of a sequence, by a polynomial over its word hashes: equal spans
    have equal hashes wherever they stand."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up = np.full(n, MULTIPLIER)
        down = np.full(n + 1, _INVERSE)
        if n:
            up[0] = 1
        down[0] = 1
        self._down = np.multiply.accumulate(down)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(hashes * np.multiply.accumulate(up))))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


def sliding_minimum(h: np.ndarray, window: int) -> np.ndarray:
    """Place of the leftmost minimum of each ``window`` consecutive values, by doubling."""
    at, value, span = np.arange(len(h)), h, 1
    while span < window:
        step = min(span, window - span)
        right, place = value[step:], at[step:]
        left = value[: len(right)]
        take = right < left
        value = np.where(take, right, left)
        at = np.where(take, place, at[: len(right)])
        span += step
    return at
