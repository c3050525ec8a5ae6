"""Blocks of near positions, and what two blocks give to each other.

A block holds a bounded number of positions, packed into one row, in the order of a kd-tree whose leaves are LEAF positions each.
Of two leaves, all pairs are within eps, none are, or eps cuts them: only the last are compared position by position. The rules
for bounds are those of operators/boxes.py: differences, squares and sums round monotonically, so that leaves are told exactly as
comparing each pair of points would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from .forest import roots

#: Positions of a leaf, pairs of leaves that are compared in one step, and positions that a task orders at a time.
LEAF, STEP, HELD = 32, 32, 1 << 17
#: Pairs of points in one batch of results.
BATCH = 1 << 19
#: Positions of other blocks that wait until it is known what whole leaves give.
WAIT = 1 << 20


def largest_square(eps: float) -> float:
    """The largest number whose square root is at most eps."""
    t = eps * eps
    while math.sqrt(t) > eps:
        t = math.nextafter(t, 0.0)
    while math.sqrt(up := math.nextafter(t, math.inf)) <= eps:
        t = up
    return t


def kd_order(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the positions x (a row a column) in which each run of `size`, and of LEAF within it, lies together."""
    order = np.arange(x.shape[1])
    todo = [(0, x.shape[1])]
    while todo:
        lo, hi = todo.pop()
        least = size if hi - lo > size else LEAF
        if hi - lo <= least or hi - lo <= LEAF:
            continue
        part = order[lo:hi]
        v = x[:, part]
        i = int(np.argmax(v.max(axis=1) - v.min(axis=1)))
        mid = min(-(-(hi - lo) // (2 * least)) * least, hi - lo - 1)
        order[lo:hi] = part[np.argpartition(v[i], mid)]
        todo += [(lo, lo + mid), (lo + mid, hi)]
    return order


@dataclass
class Block:
    """Positions x (a row a column) with integers: points and whether asked for, or a label, or a point id."""

    x: np.ndarray
    ints: np.ndarray

    def pack(self) -> bytes:
        return self.x.tobytes() + self.ints.tobytes()

    @staticmethod
    def unpack(data: bytes, most: int, ints: int) -> Block:
        m = len(data) // (8 * (most + ints))
        return Block(np.frombuffer(data, np.float64, most * m).reshape(most, m), np.frombuffer(data, np.int64, ints * m, 8 * most * m).reshape(ints, m))

    def some(self, use: np.ndarray) -> Block:
        return self if use.all() else Block(self.x[:, use], self.ints[:, use])

    @property
    def m(self) -> int:
        return self.x.shape[1]

    @cached_property
    def starts(self) -> np.ndarray:
        return np.arange(0, self.m, LEAF)

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum.reduceat(self.x, self.starts, axis=1), np.maximum.reduceat(self.x, self.starts, axis=1)

    def leaves(self, v: np.ndarray, fill) -> np.ndarray:
        """v in rows of leaves, the last one filled up."""
        return np.append(v, np.full(-len(v) % LEAF, fill, v.dtype)).reshape(-1, LEAF)

    @cached_property
    def padded(self) -> list[np.ndarray]:
        return [self.leaves(c, np.nan) for c in self.x]

    def sums(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.starts)


def met(a: Block, b: Block, top: float) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf of a and each of b: the square of their least distance, and whether they are everywhere within eps."""
    (alo, ahi), (blo, bhi) = a.bounds, b.bounds
    near = np.zeros((len(a.starts), len(b.starts)))
    far = np.zeros_like(near)
    for i in range(len(alo)):
        up, down = blo[i] - ahi[i][:, None], alo[i][:, None] - bhi[i]
        gap = np.maximum(np.maximum(up, down), 0.0)
        near += gap * gap
        gap = np.maximum(bhi[i] - alo[i][:, None], ahi[i][:, None] - blo[i])
        far += gap * gap
    return near, far <= top


def squares(a: Block, b: Block, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Squares of the distances of the positions of so many pairs of leaves, column by column; NaN where a leaf has none."""
    d2 = None
    for xa, xb in zip(a.padded, b.padded, strict=True):
        d = xa[ia][:, :, None] - xb[ib][:, None, :]
        d *= d
        d2 = d if d2 is None else np.add(d2, d, out=d2)
    return d2


class Near:
    """Points, and Epanechnikov weights, near the asked positions of one block; blocks are given one by one.

    least: bounds of density that are asked for. Then leaves that eps cuts wait for what whole leaves give, and are not compared
    where each bound is reached without them, or not even with all their points: of such positions the density is less than the
    whole one, and reaches the same bounds.
    """

    def __init__(self, block: Block, eps: float, rectangular: bool, least: list[float] | None = None) -> None:
        self.a = block.some(block.ints[1] > 0)
        self.eps, self.top, self.rectangular, self.least = eps, largest_square(eps), rectangular, least
        self.mid = (self.a.x.min(axis=1) + self.a.x.max(axis=1)) / 2
        self.n, self.density = np.zeros(self.a.m), np.zeros(self.a.m)
        self.waiting: list[tuple[Block, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def whole(self, n: np.ndarray | float, s: list, ss: np.ndarray | float) -> None:
        """Points that are all within eps: their number, and sums of their offsets from `mid` and of the squares."""
        self.n += n
        if not self.rectangular:
            off = self.a.x - self.mid[:, None]
            d2 = ss + sum(n * o * o - 2 * o * t for o, t in zip(off, s, strict=True))
            self.density += n - d2 / (self.eps * self.eps)

    def add(self, b: Block) -> None:
        near, whole = met(self.a, b, self.top)
        n = b.ints[0].astype(float)
        if whole.any():
            w, each = whole.astype(float), lambda v: np.repeat(v, LEAF)[: self.a.m]
            s, ss = [], 0.0
            if not self.rectangular:
                off = b.x - self.mid[:, None]
                s = [each(w @ b.sums(n * o)) for o in off]
                ss = each(w @ b.sums(n * (off * off).sum(axis=0)))
            self.whole(each(w @ b.sums(n)), s, ss)
        ia, ib = np.nonzero((near <= self.top) & ~whole)
        if self.least is None:
            self.compare(b, ia, ib)
        elif len(ia):
            self.waiting.append((b, ia, ib, near[ia, ib]))
            self.held += b.m
            if self.held > WAIT:
                self.settle(False)

    def settle(self, last: bool = True) -> None:
        """Compares the leaves that wait, where that tells more, the nearest of each leaf first; last: no block is to come."""
        per = len(self.a.starts)
        given = lambda b, ia, ib: np.bincount(ia, b.sums(b.ints[0].astype(float))[ib], per)
        rest = sum((given(b, ia, ib) for b, ia, ib, _ in self.waiting), np.zeros(per)) if last else np.full(per, np.inf)
        for b, ia, ib, gap in self.waiting:
            order = np.lexsort((gap, ia))
            ia, ib = ia[order], ib[order]
            rank, lo, hi = np.arange(len(ia)) - np.searchsorted(ia, ia), 0, 4
            while lo <= rank.max():
                now = (rank >= lo) & (rank < hi)
                i, j = ia[now], ib[now]
                open_ = self.open(rest)[i]
                self.compare(b, i[open_], j[open_])
                rest = rest - given(b, i, j)
                lo, hi = hi, 4 * hi
        self.waiting, self.held = [], 0

    def open(self, rest: np.ndarray) -> np.ndarray:
        """Leaves with a position of which a bound may be reached with so many more points, and is not without them."""
        found = np.zeros(len(self.a.starts), bool)
        low = (self.n if self.rectangular else self.density) - 1.0
        high = low + np.repeat(rest, LEAF)[: self.a.m]
        for t in self.least:
            some = 0.0 if self.rectangular else 1e-9 * max(1.0, t)  # sums of weights round
            found |= np.logical_or.reduceat((low < t + some) & (high >= t - some), self.a.starts)
        return found

    def compare(self, b: Block, ia: np.ndarray, ib: np.ndarray) -> None:
        """What so many pairs of leaves, in the order of the first, give to each other position by position."""
        n = b.ints[0].astype(float)
        weight = b.leaves(n, 0.0)
        alone = bool((n == 1).all())
        counts, values = np.zeros((len(self.a.starts), LEAF)), np.zeros((len(self.a.starts), LEAF))
        for lo in range(0, len(ia), STEP):
            i, j = ia[lo : lo + STEP], ib[lo : lo + STEP]
            d2 = squares(self.a, b, i, j)
            hit = d2 <= self.top
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            each = (lambda v: (v.reshape(-1, LEAF) @ np.ones(LEAF)).reshape(-1, LEAF)) if alone else (lambda v: np.matmul(v, weight[j][:, :, None])[:, :, 0])  # noqa: B023, E731
            counts[i[first]] += np.add.reduceat(each(hit.astype(float)), first, axis=0)
            if not self.rectangular:
                values[i[first]] += np.add.reduceat(each(np.where(hit, 1 - d2 / (self.eps * self.eps), 0.0)), first, axis=0)
        self.n += counts.reshape(-1)[: self.a.m]
        self.density += values.reshape(-1)[: self.a.m]


def linked(a: Block, b: Block, label: np.ndarray, eps: float) -> np.ndarray:
    """label of the positions of a and, behind them, of b (none, if they are the same block), a vertex each, once those within
    eps are joined: the least vertex of each component. Leaves of one component are not compared."""
    top, same = largest_square(eps), b is a
    near, whole = met(a, b, top)
    at = 0 if same else a.m
    if same:
        near = np.where(np.tri(*near.shape, -1, dtype=bool), np.inf, near)
        whole &= np.isfinite(near)
    n = a.m if same else a.m + b.m

    def join(p: np.ndarray, q: np.ndarray) -> None:
        nonlocal label
        label = roots(label[p], label[q], n)[label]

    ia, ib = np.nonzero(whole)
    inner = lambda x, use, at: (np.flatnonzero(np.repeat(use, LEAF)[: x.m]) + at, np.repeat(x.starts[use], LEAF)[: int(np.repeat(use, LEAF)[: x.m].sum())] + at)
    ends = [inner(a, whole.any(axis=1), 0), inner(b, whole.any(axis=0), at), (a.starts[ia], b.starts[ib] + at)]
    join(*(np.concatenate(x) for x in zip(*ends, strict=True)))
    ia, ib = np.nonzero((near <= top) & ~whole)
    order = np.argsort(near[ia, ib], kind="stable")
    ia, ib, step = ia[order], ib[order], 4 * STEP
    while len(ia):
        la, lb = label[: a.m], label[at:]
        least = lambda x, v: (np.minimum.reduceat(v, x.starts), np.maximum.reduceat(v, x.starts))
        (a0, a1), (b0, b1) = least(a, la), least(b, lb)
        open_ = (np.minimum(a0[ia], b0[ib]) != np.maximum(a1[ia], b1[ib]))
        ia, ib = ia[open_], ib[open_]
        ends = [(np.zeros(0, int), np.zeros(0, int))]
        for lo in range(0, min(step, len(ia)), STEP):
            i, j = ia[lo : min(lo + STEP, step)], ib[lo : min(lo + STEP, step)]
            k, p, q = np.nonzero(squares(a, b, i, j) <= top)
            ends.append((a.starts[i][k] + p, b.starts[j][k] + q + at))
        join(*(np.concatenate(x) for x in zip(*ends, strict=True)))
        ia, ib, step = ia[step:], ib[step:], 2 * step
    return label


def within(a: Block, b: Block, eps: float, with_d2: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Point ids p of a and q of b that are within eps and differ, and the squares of their distances, if wanted."""
    top = largest_square(eps)
    near, whole = met(a, b, top)
    p, q = a.leaves(a.ints[0], 0), b.leaves(b.ints[0], 0)
    full = np.ones(len(a.starts), bool), np.ones(len(b.starts), bool)
    full[0][a.m // LEAF :], full[1][b.m // LEAF :] = False, False
    plain = whole & full[0][:, None] & full[1] if not with_d2 else np.zeros_like(whole)
    if a.ints[0, 0] == b.ints[0, 0]:  # the same block: a point is not its own neighbour
        np.fill_diagonal(plain, False)
    ia, ib = np.nonzero(plain)
    step = BATCH // (LEAF * LEAF)
    for lo in range(0, len(ia), step):
        i, j = ia[lo : lo + step], ib[lo : lo + step]
        shape = len(i), LEAF, LEAF
        yield np.broadcast_to(p[i][:, :, None], shape).reshape(-1), np.broadcast_to(q[j][:, None, :], shape).reshape(-1)
    ia, ib = np.nonzero((near <= top) & ~plain)
    for lo in range(0, len(ia), STEP):
        i, j = ia[lo : lo + STEP], ib[lo : lo + STEP]
        d2 = squares(a, b, i, j)
        k, r, s = np.nonzero(d2 <= top)
        own, other = p[i[k], r], q[j[k], s]
        keep = own != other
        yield (own[keep], other[keep]) + ((d2[k, r, s][keep],) if with_d2 else ())


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Values of the first `keys` columns and the other columns of at most HELD rows that have them, from rows sorted by them."""
    held: list[list[np.ndarray]] = []
    name, size = None, 0

    def out() -> tuple[list, list[np.ndarray]]:
        return list(name), [np.concatenate(x) for x in zip(*held, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            mine = tuple(int(c[lo]) for c in cols[:keys])
            if held and (mine != name or size + hi - lo > HELD):
                yield out()
                held, size = [], 0
            name, size = mine, size + hi - lo
            held.append([c[lo:hi] for c in cols[keys:]])
    if held:
        yield out()


def cut(keys: tuple[str, ...], most: int, size: int, eps: float | None = None):
    """Rows (keys, coordinates, integers), sorted by the keys, to rows of blocks of at most `size`. With eps, the one integer, an id
    of each position, becomes the least of its component within the block."""
    schema = pa.schema([*((k, pa.int64()) for k in keys), ("block", pa.int64()), ("m", pa.int64()), ("n", pa.int64()), ("asked", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("lo", "hi", "s")), ("ss", pa.float64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for name, cols in runs(batches, len(keys)):
            x, ints = np.stack([c.astype(np.float64) for c in cols[:most]]), np.stack([c.astype(np.int64) for c in cols[most:]])
            order = kd_order(x, size)
            for lo in range(0, len(order), size):
                b = Block(np.ascontiguousarray(x[:, order[lo : lo + size]]), np.ascontiguousarray(ints[:, order[lo : lo + size]]))
                low, high = b.x.min(axis=1), b.x.max(axis=1)
                if eps is not None:
                    top = linked(b, b, np.arange(b.m), eps)
                    least = np.full(b.m, np.iinfo(np.int64).max)
                    np.minimum.at(least, top, b.ints[0])
                    b = Block(b.x, least[top][None])
                n, asked = (b.ints[0], int(b.ints[1].sum())) if len(b.ints) == 2 else (np.ones(b.m, np.int64), b.m)
                off = b.x - ((low + high) / 2)[:, None]
                rows = [*name, number, b.m, int(n.sum()), asked, low.tolist(), high.tolist(), (off * n).sum(axis=1).tolist(), float((off * off * n).sum()), b.pack()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(rows, schema, strict=True)], schema=schema)
                number += 1

    return run


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: of each block first its own, then those that it meets."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def near_part(b: Block, lo: list[float], hi: list[float], top: float) -> np.ndarray:
    """Which positions may be within eps of a box: all of each leaf that may be, unless less than half of them would be left."""
    gap = lambda low, high: sum(np.maximum(np.maximum(c - h, d - l), 0.0) ** 2 for c, h, d, l in zip(lo, high, low, hi, strict=True)) <= top  # noqa: E731, E741
    leaves, own = np.repeat(gap(*b.bounds), LEAF)[: b.m], gap(b.x, b.x)
    return own if 2 * own.sum() < leaves.sum() else leaves & bool(own.any())


def sent(most: int, ints: int, eps: float):
    """Rows of blocks, with the blocks (at, lo, hi) that they meet, to rows (at, other, data) of what each of those may have within
    eps."""
    top = largest_square(eps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in streamed(batches):
            b = Block.unpack(row["data"], most, ints)
            for to in row["to"]:
                if (use := near_part(b, to["lo"], to["hi"], top)).any():
                    data = row["data"] if use.all() else b.some(use).pack()
                    yield pa.RecordBatch.from_arrays([pa.array([to["at"]]), pa.array([row["other"]]), pa.array([data], pa.binary())], ["at", "other", "data"])

    return run


def near_counts(keys: tuple[str, ...], most: int, eps: float, rectangular: bool):
    """Streamed blocks to keys, v, n_near, density of the asked positions; of a block with bounds (`least`), what tells whether
    they are reached."""

    def out(name: list, near: Near) -> pa.RecordBatch:
        near.settle()
        m = near.a.m
        v = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * most), pa.array(np.ascontiguousarray(near.a.x.T).reshape(-1)))
        density = near.n if rectangular else near.density
        return pa.RecordBatch.from_arrays([*(pa.array(np.full(m, k)) for k in name), v, pa.array(near.n.astype(np.int64) - 1), pa.array(density - 1.0)], [*keys, "v", "n_near", "density"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, name = None, None
        for row in streamed(batches):
            block = Block.unpack(row["data"], most, 2)
            if row["other"] is None:
                if near is not None:
                    yield out(name, near)
                near, name = Near(block, eps, rectangular, row["least"]), [row[k] for k in keys]
                if row["wn"]:  # sums about the block's middle, moved to that of its asked positions
                    by = [c - m for c, m in zip(row["mid"], near.mid.tolist(), strict=True)]
                    ss = row["wss"] + sum(2 * d * s + row["wn"] * d * d for d, s in zip(by, row["ws"], strict=True))
                    near.whole(float(row["wn"]), [s + row["wn"] * d for d, s in zip(by, row["ws"], strict=True)], ss)
            else:
                near.add(block)
        if near is not None:
            yield out(name, near)

    return run


def links(most: int, eps: float, key: str):
    """Streamed blocks to edges (key, p, q) of labels that blocks of two join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, name = None, None
        for row in streamed(batches):
            block = Block.unpack(row["data"], most, 1)
            if row["other"] is None:
                a, name = block, row[key]
                continue
            ids, first, vertex = np.unique(np.concatenate((a.ints[0], block.ints[0])), return_index=True, return_inverse=True)
            if len(ids) > 1:
                top = linked(a, block, first[vertex], eps)[first]
                to = ids[vertex[top]]
                far = to != ids
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(far.sum()), name)), pa.array(to[far]), pa.array(ids[far])], [key, "p", "q"])

    return run


def unpacked(keys: tuple[str, ...], most: int):
    """Rows of blocks to keys, v, top: the label of each position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in streamed(batches):
            b = Block.unpack(row["data"], most, 1)
            v = pa.ListArray.from_arrays(pa.array(np.arange(b.m + 1, dtype=np.int32) * most), pa.array(np.ascontiguousarray(b.x.T).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(b.m, row[k])) for k in keys), v, pa.array(b.ints[0])], [*keys, "v", "top"])

    return run


def pairs(most: int, eps: float, with_d2: bool):
    """Streamed blocks to p, q (and d2) of the points within eps."""
    names = ["p", "q", "d2"][: 2 + with_d2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = None
        for row in streamed(batches):
            block = Block.unpack(row["data"], most, 1)
            if row["other"] is None:
                a = block
                continue
            held, size = [], 0
            for found in within(a, block, eps, with_d2):
                held.append(found)
                size += len(found[0])
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)
                    held, size = [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)

    return run
