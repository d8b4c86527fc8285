"""Words and word shingles as 64-bit hashes, computed on byte buffers with numpy.

A word is a longest run of bytes 0-9, a-z (after lower-casing A-Z) or 0x80 and
above; as every byte of a non-ASCII code point is at least 0x80, this is the
code-point class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            tables.append(np.cumprod(x, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def _words_of_piece(data: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = _LOWER[data]
    inside = _IS_WORD[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = row_at[(row_at > 0) & (row_at < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * inverse[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash and row of every word of the rows ``data[offsets[i]:offsets[i + 1]]``.

    Long inputs are worked through in pieces that end between words.
    """
    offsets = offsets - offsets[0]
    n = len(data)
    parts = []
    at = 0
    while at < n:
        to = min(at + PIECE, n)
        if to < n:
            rows = offsets[np.searchsorted(offsets, to, side="right") - 1]
            if rows > at:
                to = int(rows)
            else:
                while True:
                    gaps = np.flatnonzero(~_IS_WORD[_LOWER[data[at:to]]])
                    if len(gaps):
                        to = at + int(gaps[-1]) + 1
                        break
                    if to == n:
                        break
                    to = min(at + 2 * (to - at), n)
        start, end, key = _words_of_piece(data[at:to], offsets - at)
        parts.append((start + at, end + at, key))
        at = to
    start, end, key = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return start, end, key, np.searchsorted(offsets, start, side="right") - 1


def shingles(key: np.ndarray, n: int) -> np.ndarray:
    """The hash of ``key[i:i + n]`` at each i; rows must be told apart by the caller."""
    m = len(key) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out *= np.uint64(0xD1342543DE82EF95)
        out += key[j : j + m]
        out ^= out >> np.uint64(29)
    return mix(out)


def row_shingles(key: np.ndarray, row: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, row) of all shingles within rows; a row of fewer words, but not none, has one shingle of all its words."""
    all_of = shingles(key, n)
    ok = row[: len(all_of)] == row[n - 1 :] if len(all_of) else np.zeros(0, bool)
    out, of = all_of[ok], row[: len(all_of)][ok]
    counts = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    short_key, short_row = [], []
    for k in range(1, n):
        rows = np.flatnonzero(counts == k)
        if len(rows):
            acc = np.full(len(rows), k, np.uint64)
            for j in range(k):
                acc *= np.uint64(0xD1342543DE82EF95)
                acc += key[first[rows] + j]
                acc ^= acc >> np.uint64(29)
            short_key.append(mix(acc))
            short_row.append(rows)
    if short_key:
        out, of = np.concatenate([out, *short_key]), np.concatenate([of, *short_row])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of
