"""Hashes of the word shingles of many texts at once, in NumPy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_table = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
#: Bytes between two places whose powers are kept, and bytes that are summed at once.
_STEP, _SEGMENT = 1 << 14, 1 << 20
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_ODD, pow(_ODD, -1, 2**64)):
            x = np.full(max(n, 1 << 20), base, _U)
            x[0] = 1
            out.append(np.cumprod(x, dtype=_U))
        _powers = tuple(out)
    return _powers


def _table_of(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, _U)
    x[0] = 1
    return np.cumprod(x, dtype=_U)


_UP, _DOWN = _table_of(_ODD, _STEP), _table_of(pow(_ODD, -1, 2**64), _STEP)


def run_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes [start, end) of a; starts and ends ascend. Sums are held for one segment of a at a time."""
    low, high = np.zeros(len(start), _U), np.zeros(len(end), _U)
    carry = _U(0)
    for lo in range(0, len(a) + 1, _SEGMENT):
        seg = a[lo : lo + _SEGMENT]
        up = (_table_of(pow(_ODD, _STEP, 2**64), -(-len(seg) // _STEP) + 1)[:, None] * _UP).ravel()[: len(seg)] * _U(pow(_ODD, lo, 2**64))
        total = np.concatenate([[carry], carry + np.cumsum(_table[seg] * up, dtype=_U)])
        for at, out in ((start, low), (end, high)):
            i, j = np.searchsorted(at, [lo, lo + _SEGMENT])
            out[i:j] = total[at[i:j] - lo]
        carry = total[-1]
    far = _table_of(pow(_ODD, -_STEP, 2**64), len(a) // _STEP + 1)
    return mix((high - low) * _DOWN[start % _STEP] * far[start // _STEP])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of data, which is in lower case already."""
    a = np.frombuffer(data, np.uint8)
    gap = _space[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    return run_hashes(a, start, end), start


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer words are one shingle as a whole; no word, none."""
    data = b" ".join(texts).lower()
    hashes, start = word_hashes(data)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cut = np.searchsorted(start, first)
    factors = [_U(pow(_ODD, 3 + 2 * j, 2**64)) for j in range(words)]
    n = len(hashes)
    all_ = np.zeros(max(0, n - words + 1), _U)
    for j, f in enumerate(factors):
        all_ += hashes[j : j + len(all_)] * f
    all_ = mix(all_ + _U(words))
    out = []
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(all_[lo : hi - words + 1]))
        elif hi > lo:
            s = sum(((hashes[lo + j : lo + j + 1] * f) for j, f in zip(range(hi - lo), factors, strict=False)), np.zeros(1, _U))
            out.append(mix(s + _U(hi - lo)))
        else:
            out.append(np.zeros(0, _U))
    return out
