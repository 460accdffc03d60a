"""Numbered random draws as integer arithmetic, equal in numpy (inside tasks) and in SQL text (in checks).

A draw depends on (seed, scheme, attempt, j) only. Two rounds of a 32-bit finaliser give 52 bits, taken modulo the number of
values: any task can make the draws of any attempts without being sent them.
"""

from __future__ import annotations

import zlib

import numpy as np

# The multipliers and shifts of the 32-bit finaliser of MurmurHash3, and the 32-bit golden ratio.
MULTIPLIERS = (0x85EBCA6B, 0xC2B2AE35)
SHIFTS = (16, 13, 16)
STEP = 0x9E3779B1
_SECOND = 0xA5A5A5A5
_LOW = 0xFFFFFFFF


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(SHIFTS[0]))
    h *= np.uint32(MULTIPLIERS[0])
    h ^= h >> np.uint32(SHIFTS[1])
    h *= np.uint32(MULTIPLIERS[1])
    return h ^ (h >> np.uint32(SHIFTS[2]))


def scheme_key(seed: int, scheme: str) -> int:
    return zlib.crc32(f"{seed}|{scheme}".encode())


def drawn(seed: int, scheme: str, attempt: int, count: int, begin: int = 0, of: int | None = None) -> np.ndarray:
    """Draws ``begin`` to ``begin + count`` of an attempt, each a number below ``of`` (default: below ``count``)."""
    first = _mixed(np.array([scheme_key(seed, scheme) ^ (attempt * STEP & _LOW)], np.uint32))
    x = _mixed(first + np.arange(begin, begin + count, dtype=np.uint32) * np.uint32(STEP))
    y = _mixed(x ^ _mixed(first ^ np.uint32(_SECOND)))
    return ((x.astype(np.uint64) << np.uint64(20)) + (y >> np.uint32(12))) % np.uint64(of or count)


def weights(seed: int, scheme: str, attempts: range, clusters: int, low: int, high: int, piece: int = 1 << 20) -> np.ndarray:
    """(high - low, attempts): how often each cluster from ``low`` to ``high`` is among an attempt's ``clusters`` draws."""
    out = np.zeros((high - low, len(attempts)), np.float32)
    for column, attempt in enumerate(attempts):
        for begin in range(0, clusters, piece):
            found = drawn(seed, scheme, attempt, min(piece, clusters - begin), begin, clusters)
            inside = found[(found >= low) & (found < high)].astype(np.int64) - low
            out[:, column] += np.bincount(inside, minlength=high - low)
    return out


def _sql_mixed(table: str, column: str) -> str:
    """``table`` with ``column`` finalised, one step a level so that the text stays short."""
    shifted = f"xor({column}, {column} >> {{}})"
    for shift, factor in zip(SHIFTS, (*MULTIPLIERS, None)):
        value = shifted.format(shift) if factor is None else f"({shifted.format(shift)} * {factor}) & {_LOW}"
        table = f"(SELECT * REPLACE ({value} AS {column}) FROM {table})"
    return table


def sql_drawn(seed: int, scheme: str, table: str, of: str) -> str:
    """``table`` (attempt, j and others) as a subquery with ``idx``, the draw j of the attempt, below the column ``of``."""
    key = scheme_key(seed, scheme)
    table = f"(SELECT *, xor({key}::UBIGINT, (attempt::UBIGINT * {STEP}) & {_LOW}) AS _a FROM {table})"
    table = f"(SELECT *, (_a + j::UBIGINT * {STEP}) & {_LOW} AS _x, xor(_a, {_SECOND}::UBIGINT) AS _b FROM {_sql_mixed(table, '_a')})"
    table = f"(SELECT *, xor(_x, _b) AS _y FROM {_sql_mixed(_sql_mixed(table, '_x'), '_b')})"
    return f"(SELECT * EXCLUDE (_a, _b, _x, _y), ((_x * 1048576 + (_y >> 12)) % {of})::BIGINT AS idx FROM {_sql_mixed(table, '_y')})"
