"""Vectorised byte and hash kernels over many texts at once."""

from __future__ import annotations

import numpy as np

from .common import SPACE_BYTES

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when a longer text comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else min(2 * len(have), 1 << 22))
        t = np.full(size, base, U64)
        t[0] = 1
        _powers[base] = have = np.multiply.accumulate(t)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Rolling:
    """Prefix sums of a polynomial hash: the hash of any byte range in constant time. Each seed has a base of its own."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        base = (_BASE + 2 * seed * 0xD1342543DE82EF95) % (1 << 64)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * _power_table(base, n + 1)[:n], out=self.sums[1:])
        self.inv = _power_table(pow(base, -1, 1 << 64), n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(h ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


#: All but ASCII letters and digits and bytes of longer characters.
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without bytes of ``gap`` (white space), and the first word's number for each text (and the total)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = np.zeros(n + 1, bool)
    np.logical_not(gap[data], out=ink[:n])
    begins = np.zeros(n + 1, bool)
    begins[off] = True
    start, end = ink[:n].copy(), ink[:n].copy()
    start[1:] &= ~ink[: n - 1] | begins[1:n]
    end &= ~ink[1:] | begins[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles, sorted by text and value, and the text of each.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    s, e, first = words(data, off)
    h = Rolling(data).hash(s, e) if len(s) else np.zeros(0, U64)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(h)) - first[:-1][doc]
    size = np.minimum(count, k)[doc]
    acc = np.full(len(h), U64(k), U64)
    for i in range(k):
        there = size > i
        nxt = np.zeros(len(h), U64)
        nxt[: max(0, len(h) - i)] = h[i:]
        acc = np.where(there, mix(acc * U64(0xA24BAED4963EE407) + nxt), acc)
    keep = place <= count[doc] - size
    acc, doc = acc[keep], doc[keep]
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    return acc[new], doc[new]


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros stand after the end."""
    out = np.zeros(len(data) + 8, U64)
    wide = np.concatenate([data, np.zeros(16, np.uint8)]).astype(U64)
    for i in range(8):
        out = out << U64(8) | wide[i : i + len(out)]
    return out


def text_sum(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum modulo 2**64 of the values of each text; doc is sorted."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=sums[1:])
    cut = np.searchsorted(doc, np.arange(n + 1))
    return sums[cut[1:]] - sums[cut[:-1]]
