"""Densities and components from boxes against plain pairs of points."""

from __future__ import annotations

import math
import random

import pytest

from lodestrata.operators import boxes


def clouds(seed: int) -> list[tuple[int, int, list[float]]]:
    """(mask, p, v) rows of subspaces of one to four columns: copies, dense spots, noise, pairs at eps exactly."""
    r = random.Random(seed)
    rows = []
    for mask, k in ((1, 1), (3, 2), (5, 2), (7, 3), (15, 4)):
        spots = [[r.uniform(-1, 1) for _ in range(k)] for _ in range(3)]
        p = 0
        for n, spread in ((70, 0.02), (40, 0.15), (25, 0.0)):
            for _ in range(n):
                rows.append((mask, p, [x + r.gauss(0, spread) for x in spots[p % 3 if spread else 0]]))
                p += 1
        rows += [(mask, p + i, [r.uniform(-1, 1) for _ in range(k)]) for i in range(40)]
        rows += [(mask, p + 40 + i, [0.3 + 0.1 * i] + [0.0] * (k - 1)) for i in range(3)]
    return rows


def distance(a: list[float], b: list[float]) -> float:
    return math.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))


@pytest.mark.parametrize(("rectangular", "room", "eps"), [(True, 40, (0.3 + 0.1) - 0.3), (False, 1, 0.1)])
def test_density(spark, rectangular, room, eps):
    rows = clouds(1)
    right = spark.createDataFrame(rows, "mask long, p long, v array<double>").repartition(3)
    left = right.filter("p % 3 = 0")
    got, want = {}, {}
    for k in (1, 2, 3, 4):
        of = lambda rows: rows.filter(f"bit_count(mask) = {k}")  # noqa: B023, E731
        got |= {(x["mask"], tuple(x["v"])): (x["density"], x["n_near"]) for x in boxes.density(of(left), of(right), k, eps, rectangular, room=room).collect()}
    for mask, p, v in rows:
        if p % 3 == 0:
            near = [distance(v, w) for m, q, w in rows if m == mask and q != p]
            near = [d for d in near if d <= eps]
            want[mask, tuple(v)] = (len(near) if rectangular else sum(1 - (d / eps) ** 2 for d in near), len(near))
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], abs_tol=1e-8) for k in want)


@pytest.mark.parametrize(("room", "eps"), [(1, 0.2), (30, (0.3 + 0.1) - 0.3)])
def test_components(spark, room, eps):
    rows = [(mask, p % 2, p, v) for mask, p, v in clouds(2)]
    core = spark.createDataFrame(rows, "mask long, region long, p long, v array<double>").repartition(3)
    got = {(x["mask"], x["region"], x["p"]): x["label"] for x in boxes.components(core, 4, eps, room=room).collect()}
    label = {(m, g, p): p for m, g, p, _ in rows}
    pairs = [((m, g, p), (m, g, q)) for m, g, p, v in rows for n, h, q, w in rows if (m, g) == (n, h) and p < q and distance(v, w) <= eps]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label


def test_empty(spark):
    none = spark.createDataFrame([], "mask long, region long, p long, v array<double>")
    assert boxes.density(none, none, 2, 0.1, True).count() == 0
    assert boxes.components(none, 2, 0.1).count() == 0


def test_rows_of_one_position(spark):
    """Any number of copies is one row of one pair of boxes."""
    copies = spark.range(3000).selectExpr("3L AS mask", "id AS p", "array(0.5D, 0.25D) AS v")
    found = boxes.density(copies, copies, 2, 0.1, False).collect()
    assert [(x["density"], x["v"]) for x in found] == [(2999.0, [0.5, 0.25])]
