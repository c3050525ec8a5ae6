"""Words, word hashes and shingle hashes of whole batches of texts in numpy.

Words are runs of bytes of a class; since every byte of a multi-byte UTF-8 character is above 0x7F, classes that take
all characters beyond ASCII can be told by the byte. Words never cross texts.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_SLAB, _LONG = 1 << 20, 4096
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _class(member) -> np.ndarray:
    return np.array([member(b) for b in range(256)], bool)


#: [^\x20\x09-\x0D]+
SPACED = _class(lambda b: b != 0x20 and not 9 <= b <= 13)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
ALNUM = _class(lambda b: b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _SLAB + 2 * _LONG)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate(([U(1)], np.full(n - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in `data`, and for each text the place of its first word (n + 1 places)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = w.copy()
    starts[1:] &= ~w[:-1] | edge[1:n]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z in lower case."""
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, base + _SLAB, "right")))
        s, e = starts[a:b] - base, ends[a:b] - base
        if b == a + 1 and e[0] > _SLAB:
            out[a] = U(xxhash.xxh64_intdigest(LOWER[data[base : base + int(e[0])]].tobytes(), 7))
            a = b
            continue
        value = _VALUES[LOWER[data[base : base + int(e[-1])]]]
        up, down = _power(len(value) + 1)
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * up[: len(value)], out=total[1:])
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
        a = b
    return out


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, for each word that has n - 1 words after it in `h`; texts may be crossed."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = mix(h[:m] + U(n))
    for j in range(1, n):
        out *= U(0x9FB21C651E98DF25)
        out += h[j : j + m]
        out ^= out >> U(29)
    return mix(out)


def doc_shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and, for each text, the place of its first (n + 1 places). A text with fewer than n
    words, but not none, has one shingle: the whole sequence."""
    count = np.diff(first)
    full = np.maximum(count - n + 1, 0)
    short = (count > 0) & (count < n)
    at = np.concatenate(([0], np.cumsum(full + short)))
    out = np.zeros(int(at[-1]), np.uint64)
    if full.any():
        every = shingles(h, n)
        keep = np.repeat(first[:-1] - at[:-1], full + short) + np.arange(len(out))
        ok = np.repeat(~short, full + short)
        out[ok] = every[keep[ok]]
    for i in np.flatnonzero(short):
        out[at[i]] = shingles(h[first[i] : first[i + 1]], int(count[i]))[0]
    return out, at
