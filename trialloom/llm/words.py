"""Words of Arrow string columns as numpy arrays: where they start and end, and a 64-bit hash of each.

Works on the UTF-8 bytes of a whole slice at once, without a Python object per word. Both word rules of the
operators are byte rules: every byte from 0x80 up belongs to a word, so no character is ever split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)

_all = np.arange(256)
FOLD = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)
_folded_values = _BYTE_VALUES[FOLD]

#: a-z, A-Z, 0-9 and everything outside ASCII
ALNUM = ((_all >= 48) & (_all <= 57)) | ((FOLD >= 97) & (FOLD <= 122)) | (_all >= 128)
#: everything but blank, tab, line feed, vertical tab, form feed and carriage return
VISIBLE = (_all != 32) & ~((_all >= 9) & (_all <= 13))
LETTERS = ((FOLD >= 97) & (FOLD <= 122)) | (_all >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number, modulo 2^64; short tables are kept."""
    global _powers
    if len(_powers) >= n:
        return _powers[:n]
    table = np.full(max(n, 256), _BASE, np.uint64)
    table[0] = 1
    table = np.cumprod(table, dtype=np.uint64)
    if n <= 1 << 16:
        _powers = table
    return table[:n]


@dataclass
class Words:
    """``bounds[i]:bounds[i + 1]`` are the words of row ``i``; ``start`` and ``end`` are places in ``data``."""

    data: np.ndarray
    text_bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A hash of every word; with ``fold``, A-Z count as a-z."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        firsts = np.cumsum(lengths) - lengths
        where = np.arange(int(lengths.sum()), dtype=np.int64)
        place = where - np.repeat(firsts, lengths)
        value = (_folded_values if fold else _BYTE_VALUES)[self.data[where + np.repeat(self.start - firsts, lengths)]]
        value *= _power_table(int(lengths.max()))[place]
        return mix(np.add.reduceat(value, firsts) + lengths.astype(np.uint64) * _BASE)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 bounds between them; a null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def find_words(column: pa.Array, members: np.ndarray) -> Words:
    """The runs of member bytes of each text."""
    data, text_bounds = text_bytes(column)
    inside = members[data]
    n = len(data)
    edges = text_bounds[(text_bounds > 0) & (text_bounds < n)]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, text_bounds, start, end, np.searchsorted(start, text_bounds))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` consecutive words (runs over a text's end included; callers cut them off)."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    size = len(hashes) - k + 1
    total = np.zeros(size, np.uint64)
    for j in range(k):
        total += hashes[j:j + size] * _GRAM_FACTORS[j % 64] + np.uint64(j // 64)
    return mix(total)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a slice have about ``most`` bytes; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - 1).clip(0) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)
