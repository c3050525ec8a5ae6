"""SetSketch: mergeable, locality-sensitive registers of sets (Ertl, 2021).

Each element gives each register one exponentially spaced value: its j-th smallest lies in the j-th of m intervals of
equal probability and goes to the j-th register of the element's own order. A register keeps the least, truncated to a
power of BASE. Elements are taken in rounds over j, and a set is done when no later value could lower a register, so a
large set costs little more than one value for each element. Registers of a union are the maxima of the registers.
"""

from __future__ import annotations

import numpy as np

from .tokens import mix

M, BASE = 127, 1.02
BANDS, ROWS = 25, 5
_U = np.uint64


def registers(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """int16 registers of the sets h[at[i]:at[i + 1]]; an empty set has zeros."""
    n = len(at) - 1
    least = np.full((n, M), np.inf)
    of = np.repeat(np.arange(n), np.diff(at))
    seed = mix(h)
    first, step = (seed >> _U(33)).astype(np.int64) % M, 1 + (mix(seed) >> _U(33)).astype(np.int64) % (M - 1)
    flat = least.ravel()
    for j in range(1, M + 1):
        if not len(of):
            break
        u = (mix(seed + _U(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> _U(11)).astype(np.float64) * 2.0**-53
        x = np.log(M / (M - j + 1)) - np.log1p(-u / (M - j + 1))
        np.minimum.at(flat, of * M + (first + j * step) % M, x)
        if j < M:
            going = least.max(1) > np.log(M / (M - j))
            if not going.all():
                keep = going[of]
                of, seed, first, step = of[keep], seed[keep], first[keep], step[keep]
    with np.errstate(divide="ignore"):
        out = np.floor(1 - np.log(least) / np.log(BASE))
    out[~np.isfinite(out)] = -(1 << 15)
    return np.clip(out, -(1 << 15), (1 << 15) - 1).astype(np.int16)


def bands(k: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each band of ROWS registers, different from band to band."""
    out = np.empty((len(k), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(k), (b + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            x = mix(x + k[:, r].astype(np.int64).view(np.uint64))
        out[:, b] = x
    return out.view(np.int64)


_GRID = np.linspace(0, 1, 101)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates of the Jaccard similarity of pairs with known sizes, on a grid of hundredths."""
    if not len(a):
        return np.zeros(0)
    return _GRID[_scores(a, b, na, nb, _GRID).argmax(1)]


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """jaccard(a, b, na, nb) >= least, from two points of the grid: p and q are convex and their logarithms concave in the
    similarity, so that the likelihood is concave, and its first maximum lies at a point or behind if that is above the one before."""
    at = int(np.searchsorted(_GRID, least))
    if not 0 < at < len(_GRID) or not len(a):
        return np.full(len(a), at == 0)
    before, here = _scores(a, b, na, nb, _GRID[at - 1 : at + 1]).T
    return here > before


def _scores(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Log-likelihoods of the similarities of the grid, a row a pair."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    p, q = _p(u - v * grid), _p(v - u * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = _log(up, p) + _log(down, q) + _log(M - up - down, 1 - p - q)
    score[grid > np.minimum(u / v, v / u) + 0.005] = -np.inf
    return score


def _log(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.where(n[:, None] == 0, 0.0, n[:, None] * np.log(np.maximum(p, 1e-9)))
