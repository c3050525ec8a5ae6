"""Spanning forests of edge lists, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Edges that are held before they are contracted.
HELD = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least vertex of each component of the vertices 0 to n - 1 with edges (a, b)."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up


def stars(key: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, least vertex of the component, other vertex): a forest of the graphs of all keys."""
    k, v = np.concatenate((key, key)), np.concatenate((p, q))
    order = np.lexsort((v, k))
    k, v = k[order], v[order]
    new = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])) if len(k) else np.zeros(0, bool)
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    k, v = k[new], v[new]
    top = roots(number[: len(p)], number[len(p) :], len(v))
    other = np.flatnonzero(top != np.arange(len(v)))
    return k[other], v[top[other]], v[other]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (key, p, q) to a forest of the same components: fewer rows than the task has met vertices."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        size += batch.num_rows
        if size >= HELD:
            held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = len(held[0][0])
            if size >= HELD // 2:  # many vertices: what is held must not be contracted again for each batch
                yield _batch(held[0], batch.schema)
                held, size = [], 0
        schema = batch.schema
    if held:
        yield _batch(stars(*(np.concatenate(x) for x in zip(*held, strict=True))), schema)


def _batch(columns: tuple[np.ndarray, ...], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema.names)
