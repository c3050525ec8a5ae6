"""Blocks against plain pairs of positions, and that work stays in blocks."""

from __future__ import annotations

import numpy as np
import pytest

from lodestrata.operators import blocks, boxes, density, neighbors, scaling
from lodestrata.operators.forest import roots
from lodestrata.plans.clustering import Clustering


@pytest.mark.parametrize("seed", range(12))
def test_linked_and_within(seed):
    r = np.random.default_rng(seed)
    k, m, eps = int(r.integers(1, 4)), int(r.integers(2, 300)), float(r.choice([0.02, 0.1, 0.3]))
    x = np.round(r.random((k, m)), 1 if seed % 3 == 0 else 9)
    order = blocks.kd_order(x, int(r.choice([1, 40, 64, 1024])))
    assert sorted(order) == list(range(m))
    x, h = np.ascontiguousarray(x[:, order]), m // 2
    close = np.sqrt(sum((c[:, None] - c) ** 2 for c in x)) <= eps
    want = roots(*np.nonzero(close), m)
    a, b = blocks.Block(x[:, :h], np.arange(h)[None]), blocks.Block(x[:, h:], np.arange(h, m)[None])
    own = [blocks.linked(y, y, np.arange(y.m), eps) for y in (a, b)]
    assert (blocks.linked(a, b, np.concatenate((own[0], own[1] + h)), eps) == want).all()
    got = [(int(p), int(q)) for p, q in ((p, q) for found in blocks.within(a, b, eps, False) for p, q in zip(*found, strict=True))]
    assert sorted(got) == [(i, j + h) for i, j in zip(*map(list, np.nonzero(close[:h, h:])), strict=True)]


def test_largest_square():
    for eps in (0.1, 0.02, (0.3 + 0.1) - 0.3, 1e-9, 3.0):
        top = blocks.largest_square(eps)
        assert np.sqrt(top) <= eps < np.sqrt(np.nextafter(top, np.inf))


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_pairs(spark, dims):
    """Pairs of one task's blocks, copies among them."""
    r = np.random.default_rng(dims)
    x = np.round(r.normal(0, 0.3, (400, dims)), 2)
    points = spark.createDataFrame([(p, [float(c) for c in v]) for p, v in enumerate(x)], "p long, v array<double>")
    d2 = sum((c[:, None] - c) ** 2 for c in x.T)
    want = {(p, q): d2[p, q] for p, q in zip(*map(list, np.nonzero(np.sqrt(d2) <= 0.1)), strict=True) if p != q}
    rows = boxes.pairs(points, dims, 0.1, room=64).collect()
    assert len(rows) == len(want) and {(x["p"], x["q"]): x["d2"] for x in rows} == want
    rows = boxes.pairs(points, dims, 0.1, with_d2=False, room=64).collect()
    assert len(rows) == len(want) and {(x["p"], x["q"]) for x in rows} == set(want)


def test_a_dense_spot_is_dealt_to_many_tasks(spark):
    """Points that are all within eps are no pairs of rows, nor in one task."""
    rows = spark.range(6000).selectExpr("1L AS mask", "id AS p", "array(id * 1e-6D, (id % 77) * 1e-4D) AS v")
    found, count = boxes._blocks(boxes._flat(rows, ("mask",), 2, "p"), ("mask",), 2, 0.1, 1024)
    assert count >= 6 and found.filter("m > 1024").isEmpty() and found.agg({"m": "sum"}).first()[0] == 6000
    got = density.with_density(rows, rows, 2, 0.1, True).agg({"n_near": "min", "density": "max", "p": "count"}).first()
    assert sorted(got) == [5999, 5999.0, 6000]
    assert density.components(rows.selectExpr("mask", "0L AS region", "p", "v"), 2, 0.1).filter("label <> 0").isEmpty()


def test_pairs_are_not_kept_where_they_may_be_many(spark, monkeypatch):
    r = np.random.default_rng(4)
    coords = spark.createDataFrame([(p, d, float(x)) for p, v in enumerate(r.normal(0, 1, (300, 3))) for d, x in enumerate(v)], "p long, dim int, x double")
    run = lambda **options: sorted(map(str, Clustering(coords, 3, 0.1, 1.0, 4, 10, **options).run().collect()))
    want = run()

    def never(*_, **__):
        raise AssertionError("pairs of points as rows")

    monkeypatch.setattr(neighbors, "pairs", never)
    assert run(strategy="incremental", few_pairs=0) == want


def test_bounds_are_not_joined_by_a_shuffle_of_the_points(spark):
    """A column is not one task's."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coords = spark.range(100).selectExpr("id AS p", "CAST(id % 4 AS int) AS dim", "CAST(id AS double) AS x")
        plan = scaling.normalize(coords)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("rectangular", [True, False])
def test_bounds_of_density_are_told_without_comparing_all(monkeypatch, seed, rectangular):
    """F6 F10 F11 F12 F13 F14 F15 F16: the same positions reach each bound, and few pairs of leaves are compared for it."""
    r = np.random.default_rng(seed)
    k, eps, m = 1 + seed % 3, 0.1, 3000
    x = np.round(r.normal(0.5, 0.15, (k, m)), 2 if seed % 2 else 9)
    parts = [np.sort(p) for p in np.array_split(r.permutation(m), 3)]
    made = [x[:, p[blocks.kd_order(x[:, p], 1024)]] for p in parts]
    given = [blocks.Block(np.ascontiguousarray(v), np.stack((r.integers(1, 3, v.shape[1]), np.ones(v.shape[1], np.int64)))) for v in made]
    pairs = [0]
    plain = blocks.squares
    monkeypatch.setattr(blocks, "squares", lambda a, b, ia, ib: (pairs.__setitem__(0, pairs[0] + len(ia)), plain(a, b, ia, ib))[1])

    def of(least, wait=1 << 20):
        monkeypatch.setattr(blocks, "WAIT", wait)
        pairs[0] = 0
        near = blocks.Near(given[0], eps, rectangular, least)
        for b in given:
            near.add(b)
        near.settle() if least else None
        return (near.n if rectangular else near.density) - 1.0, pairs[0]

    want, every = of(None)
    least = [float(np.quantile(want, 0.02)), float(np.quantile(want, 0.1))]
    for wait in (1 << 20, 1500):
        got, some = of(least, wait)
        assert all(((got >= t) == (want >= t)).all() or not rectangular and (np.abs(want - t)[(got >= t) != (want >= t)] < 1e-6).all() for t in least)
        assert some < every if k > 1 else some <= every
    got, some = of([float(want.max()) + m, -1.0])
    assert some < every and (got >= -1.0).all()


def test_blocks_send_what_is_near_only():
    """F6 F10 F11 F12 F13 F14: no position within eps of the other's box is left out, few others are sent."""
    r = np.random.default_rng(1)
    x = r.random((3, 16384))
    b = blocks.Block(np.ascontiguousarray(x[:, blocks.kd_order(x, 16384)]), np.arange(16384)[None])
    for lo, hi in (([1.0, 0.0, 0.0], [2.0, 1.0, 1.0]), ([1.0, 1.0, 0.0], [2.0, 2.0, 1.0]), ([0.2] * 3, [0.9] * 3), ([3.0] * 3, [4.0] * 3)):
        use = blocks.near_part(b, lo, hi, blocks.largest_square(0.02))
        gap = sum(np.maximum(np.maximum(low - c, c - high), 0) ** 2 for c, low, high in zip(b.x, lo, hi, strict=True))
        must = np.sqrt(gap) <= 0.02
        assert not (must & ~use).any() and use.sum() <= 2 * must.sum()
