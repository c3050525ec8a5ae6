"""Densities told by counts of cells, where counts tell enough.

A cell of a subspace is a third of eps wide (less beyond nine columns), so that all of it, and of some cells around it, is within eps
of each of its positions. Where those hold as many points as the largest bound of density that is asked for, the position reaches
all bounds, and is not compared. What is left, if it is not much, meets the points where they lie: a task counts its points near the
positions that are left, which lie in coarser cells, and no point is dealt out.

For coordinates in [0, 1]. Cells are narrower than their share by more than quotients round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import line
from .blocks import HELD, largest_square
from .line import NARROWER

#: Positions that are left to compare, at most, for points to meet them where they lie (k + 2 numbers each).
LEFT = 400_000
#: Pairs of points that there may be, from which on a plan counts cells: the two passes over them have their own costs.
MANY = 10**12
#: Pairs of positions that a task compares in one step.
PAIRS = 1 << 21


class Grid:
    """Cells of k columns, each with a number that holds its place in every column."""

    def __init__(self, k: int, eps: float) -> None:
        self.k, self.eps, self.parts = k, eps, max(3, math.isqrt(k - 1) + 1)
        self.width = eps / self.parts * NARROWER
        self.base = math.floor(1 / self.width) + 2 * self.parts + 3
        #: Whether numbers have room in a bigint, and all cells around one are few.
        self.fits = 1e-8 < eps < 1 and k <= 5 and self.base**k < 1 << 62

    @lru_cache  # noqa: B019
    def within(self) -> list[int]:
        """Differences of number of the cells that are everywhere within eps of all of a cell, itself included."""
        reach = range(1 - self.parts, self.parts)
        return [self._number(o) for o in product(reach, repeat=self.k) if sum((abs(i) + 1) ** 2 for i in o) <= self.parts**2]

    def around(self) -> np.ndarray:
        """Differences of number of the coarse cells that may have positions within eps of a coarse cell's, itself included."""
        return np.array([self._number(o) for o in product((-1, 0, 1), repeat=self.k)])

    def _number(self, places: tuple[int, ...]) -> int:
        return sum(c * self.base**i for i, c in enumerate(places))

    def number(self, at) -> Column:
        """The cell of a row with coordinates at(i)."""
        return reduce(lambda a, b: a + b, ((F.floor(at(i) / F.lit(self.width)) + self.parts) * F.lit(self.base**i) for i in range(self.k)))

    def coarse(self, x: np.ndarray) -> np.ndarray:
        """Coarse cells, parts + 1 cells wide, of positions x (a row a column): within eps are only positions of adjacent ones."""
        return sum((np.floor(c / self.width).astype(np.int64) // (self.parts + 1) + 1) * self.base**i for i, c in enumerate(x))


def counts(points: DataFrame, spaces: DataFrame, grid: Grid) -> DataFrame:
    """mask, cell, n: points(xs) in each cell of each of spaces(mask, dims)."""
    at = lambda i: F.get("xs", F.get("dims", F.lit(i)))
    rows = points.select("xs").crossJoin(F.broadcast(spaces.select("mask", "dims"))).select("mask", grid.number(at).alias("cell"))
    return rows.filter("cell IS NOT NULL").groupBy("mask", "cell").agg(F.count(F.lit(1)).alias("n"))


def few_cells(held: DataFrame, asked: DataFrame, grid: Grid, most: Column) -> DataFrame:
    """mask, cell of those of asked(mask, cell) of which the cells of held(mask, cell, n) that are wholly within eps do not hold so
    many points (`most`, by the mask) besides one."""
    alone = held.filter(F.col("n") - 1 < most)
    there = alone if asked is held else alone.join(asked, ["mask", "cell"], "left_semi")
    near = there.select("mask", F.col("cell").alias("own"), F.explode(F.array(*(F.lit(i) for i in grid.within()))).alias("by"))
    near = near.withColumn("cell", F.col("own") + F.col("by")).join(held, ["mask", "cell"])
    found = near.groupBy("mask", "own").agg(F.sum("n").alias("n")).filter(F.col("n") - 1 < most)
    return found.select("mask", F.col("own").alias("cell"))


def _ranges(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending keys, where each new one begins, and its number."""
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return start, np.diff(np.append(start, len(keys)))


class Left:
    """Positions x (a row a column) of one subspace that points are counted near."""

    def __init__(self, x: np.ndarray, dims: list[int], eps: float) -> None:
        self.dims, self.eps, self.top, self.grid = dims, eps, largest_square(eps), Grid(len(dims), eps)
        keys = self.grid.coarse(x)
        self.order = np.argsort(keys, kind="stable") if len(dims) > 1 else np.argsort(x[0], kind="stable")
        self.x, keys = x[:, self.order], keys[self.order]
        self.start, self.size = _ranges(keys)
        self.keys = keys[self.start]

    def count(self, x: np.ndarray) -> np.ndarray:
        """How many of the positions x are within eps of each own one."""
        found = np.zeros(self.x.shape[1], np.int64)
        if len(self.dims) == 1:
            own, x = self.x[0], np.sort(x[0])
            sorted_ = line._reach(own, x, self.eps) + line._reach(-own[::-1], -x[::-1], self.eps)[::-1] - len(x)
            found[self.order] = sorted_
            return found
        keys = self.grid.coarse(x)
        order = np.argsort(keys, kind="stable")
        x, keys = x[:, order], keys[order]
        start, size = _ranges(keys)
        keys = keys[start]
        for by in self.grid.around():
            to = np.minimum(np.searchsorted(self.keys, keys + by), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[to] == keys + by)
            self._meet(x, start[hit], size[hit], self.start[to[hit]], self.size[to[hit]], found)
        out = np.zeros_like(found)
        out[self.order] = found
        return out

    def _meet(self, x: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, found: np.ndarray) -> None:
        """Adds the positions of x from a on, na of them, that are within eps of own ones from b on, nb of them."""
        part = np.maximum(1, PAIRS // nb)  # runs of x that make few pairs
        times = -(-na // part)
        each = np.repeat(np.arange(len(a)), times)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        a, na, b, nb = a[each] + nth * part[each], np.minimum(part[each], na[each] - nth * part[each]), b[each], nb[each]
        pairs = np.cumsum(na * nb)
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + PAIRS, "right")))
            size = na[lo:hi] * nb[lo:hi]
            run = np.repeat(np.arange(lo, hi), size)
            at = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
            i, j = a[run] + at // nb[run], b[run] + at % nb[run]
            d2 = np.zeros(len(run))
            for mine, other in zip(self.x, x, strict=True):
                d = mine[j] - other[i]
                d2 += d * d
            found += np.bincount(j[d2 <= self.top], minlength=len(found))
            lo = hi


def near_counts(points: DataFrame, left: DataFrame, eps: float) -> DataFrame:
    """mask, p, n: of each of left(mask, dims, p, v), which are at most LEFT rows of one number of columns, the points(xs) within eps
    of it, itself included; no row where there is none."""
    rows = left.select("mask", "dims", "p", "v").toArrow().combine_chunks()
    masks, p = rows["mask"].to_numpy(), rows["p"].to_numpy()
    k = len(rows["dims"][0])
    x = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, k).T
    parts = {}
    for mask in np.unique(masks).tolist():
        own = np.flatnonzero(masks == mask)
        parts[mask] = rows["dims"][int(own[0])].as_py(), p[own], np.ascontiguousarray(x[:, own])
    sent = points.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = {mask: Left(at, dims, eps) for mask, (dims, _, at) in sent.value.items()}
        total = {mask: np.zeros(len(ids), np.int64) for mask, (_, ids, _) in sent.value.items()}

        def add(held: list[np.ndarray]) -> None:
            every = np.concatenate(held).T
            for mask, one in near.items():
                mine = every[one.dims]
                mine = mine[:, ~np.isnan(mine).any(axis=0)]
                if mine.shape[1]:
                    total[mask] += one.count(mine)

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                size += batch.num_rows
            if size >= HELD:
                add(held)
                held, size = [], 0
        if held:
            add(held)
        for mask, n in total.items():
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), mask)), pa.array(sent.value[mask][1][some]), pa.array(n[some])], ["mask", "p", "n"])

    found = points.select("xs").mapInArrow(run, "mask bigint, p bigint, n bigint")
    return found.groupBy("mask", "p").agg(F.sum("n").alias("n"))
