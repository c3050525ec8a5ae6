"""Product codes against plain Python, ties included."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import codes


def test_nearest_of_equals():
    """The tree finds the lowest index of all entries at the least distance."""
    r = np.random.default_rng(2)
    for width, spread, n in ((1, 3, 40), (2, 2, 200), (3, 4, 256), (16, 1, 256), (5, 1000, 100)):
        book = r.integers(-spread, spread + 1, (n, width))
        points = r.integers(-spread - 1, spread + 2, (300, width))
        d = ((points[:, None, :] - book[None]) ** 2).sum(2)
        for leaf in (1, 8):
            index, best = codes.nearest(codes.kd_tree(book, leaf), book, points)
            assert (index == d.argmin(1)).all()
            assert (best == d.min(1)).all()


def plain(rows: list[tuple], parts: int, entries: int, rounds: int):
    """(rows with codes and errors, codebooks) of (id, vector, label) rows."""
    kept = []
    for ident, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((ident, [max(-codes.LARGEST, min(codes.LARGEST, math.floor(x * 1024))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) if kept else 0
    kept = [r for r in kept if len(r[1]) == width]
    edges = codes._edges(width, parts)
    cut = lambda v: [v[lo:hi] for lo, hi in zip(edges, edges[1:])]  # noqa: E731, B905
    books = [[cut(v)[k] for _, v, _ in kept[:entries]] for k in range(parts)]

    def best(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(best(k, cut(v)[k])[1], []).append(cut(v)[k])
            books[k] = [[sum(c) // len(c) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[k])]
    out = []
    for ident, v, label in kept:
        found = [best(k, x) for k, x in enumerate(cut(v))]
        out.append((ident, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize(("width", "parts", "entries", "rounds"), [(8, 4, 16, 3), (7, 4, 5, 2), (4, 2, 256, 1), (2, 4, 3, 2)])
def test_compress(spark, width, parts, entries, rounds):
    r = random.Random(width)
    rows = [(i, [r.choice([0.0, 0.25, -0.4, 0.001, r.uniform(-1, 1)]) for _ in range(width)], r.choice([1, 2, None])) for i in range(120)]
    rows += [(200, None, 1), (201, [None] * width, 1), (202, [float("nan")] * width, 2), (203, [float("inf")] * width, 2), (204, [-1e30, *[1e30] * (width - 1)], 3)]
    rows += [(205, [0.5] * (width + 1), 1), (7, [0.1] * width, 1), (7, [0.1] * width, 1), (None, [0.2] * width, None), (3, [-0.3] * width, 2), (206, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("x")).repartition(5)
    coded, books = codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    found = codes.with_label_error(coded).withColumn("hex", codes.hex_code(F.col("__codes"))).collect()
    want, plain_books = plain(rows, parts, entries, rounds)
    assert Counter((x["vec_id"], x["label"], x["hex"], x["__error"]) for x in found) == Counter(want)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert all(x["__label_error"] == sums[x["label"]] and x["code"] == "x" for x in found)
    flat = ",".join(str(c) for b in plain_books for e in b for c in e)
    assert codes.digest(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    for empty in (df, df.limit(0)):
        coded, books = codes.compress(empty)
        assert codes.with_label_error(coded).count() == 0
        assert codes.digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        codes.compress(df, entries=257)
