"""Numpy kernels over the bytes of many texts at once: words, hashes of spans, mixing."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
_R = U64(0x9E3779B97F4A7C15 | 1)
_RINV = U64(pow(int(_R), -1, 1 << 64))


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word `[^\\x20\\x09-\\x0D]+`; words never cross from one row to the next."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    first = at[:-1]
    before[first[first < n]] = True
    last = at[1:]
    after[last[last > 0] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        out = []
        for base in (_R, _RINV):
            p = np.full(m, base, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _powers = (out[0], out[1])
    return _powers


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for many spans: differences of one running polynomial, then mixed."""
    up, down = _power(len(data) + 1)
    run = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(U64))


def shingle_hashes(word_hash: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words; a row with 1 to k-1 words has one shingle, all its words."""
    n = len(word_hash)
    if not n:
        return word_hash, row
    count = np.bincount(row, minlength=rows)
    first = np.zeros(rows, np.int64)
    np.cumsum(count[:-1], out=first[1:])
    left = first[row] + count[row] - np.arange(n)  # words from here to the row's end
    short = count[row] < k
    take = (left >= k) | (short & (left == count[row]))
    h = np.zeros(n, U64)
    for j in range(k):
        ok = left > j
        step = np.zeros(n, U64)
        step[: max(n - j, 0)] = word_hash[j:]
        h = np.where(ok, (h * U64(0xD6E8FEB86659FD93)) ^ (step + U64(j + 1)), h)
        h = np.where(ok, h ^ (h >> U64(29)), h)
    return mix(h[take]), row[take]
