"""Densities told by counts of cells against densities in boxes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import cells
from lodestrata.plans.clustering import Clustering
from lodestrata.sources import generators

SETTINGS = {"eps": 0.04, "factor": 0.1, "num_obj": 4, "min_size": 40, "cells": 4, "rectangular": True, "few_pairs": 0, "at_once": 0}


@pytest.fixture(autouse=True)
def _always(monkeypatch):
    monkeypatch.setattr(cells, "MANY", 0)


@pytest.fixture(scope="module")
def coords(spark):
    found = generators.generate_gaussian(spark, 4, 1500, 2, 1.5, 3, noise=0.1, seed=7).select("p", "dim", "x")
    return found.filter("NOT (p % 50 = 3 AND dim = 1)").localCheckpoint()


@pytest.fixture(scope="module")
def by_boxes(coords):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Clustering, "_by_cells", lambda *_: None)
        run = Clustering(coords, 4, **SETTINGS)
        run.forward()
        return set(_result(run)), _levels(run)


def _result(run):
    return [(tuple(r["dims"]), r["p"], r["label"], r["size"]) for r in run.backward().join(run.spaces, "mask").select("dims", "p", "label", "size").collect()]


def _levels(run):
    """Members of all levels, and which of them are dense."""
    return [{(r["mask"], r["p"], r["region"], r["dense"]) for r in x.withColumn("dense", F.col("density") >= run.least(k + 1)).collect()} for k, x in enumerate(run.levels)]


@pytest.mark.parametrize("left", [cells.LEFT, 0])
def test_cells_tell_what_boxes_tell(coords, by_boxes, left, monkeypatch):
    monkeypatch.setattr(cells, "LEFT", left)
    run = Clustering(coords, 4, **SETTINGS)
    run.forward()
    assert _levels(run) == by_boxes[1] and len(run.levels) == 4
    assert set(_result(run)) == by_boxes[0] and by_boxes[0]


def test_most_members_are_not_compared(coords, monkeypatch):
    """Only positions that cells do not tell are left for points to meet: before, all positions were packed and compared."""
    met = []
    plain = cells.near_counts
    monkeypatch.setattr(cells, "near_counts", lambda points, left, eps: met.append(left.count()) or plain(points, left, eps))
    run = Clustering(coords, 4, **SETTINGS)
    run.forward()
    assert len(met) == 4 and sum(met) < sum(run.sizes) / 2


@pytest.mark.parametrize("k", [1, 2, 5])
def test_cells_within_and_around(k):
    """No two positions of cells that are told to be within eps are further apart; none within eps are in cells further around."""
    import numpy as np

    grid = cells.Grid(k, 0.1)
    x = np.random.default_rng(k).random((k, 400)) * 0.4
    x[:, :50] = np.floor(x[:, :50] / grid.width) * grid.width  # on edges of cells
    number = sum((np.floor(c / grid.width).astype(np.int64) + grid.parts) * grid.base**i for i, c in enumerate(x))
    d = np.sqrt(sum((c[:, None] - c) ** 2 for c in x))
    by = number[None] - number[:, None]
    assert (d[np.isin(by, grid.within())] <= 0.1).all()
    coarse = grid.coarse(x)
    assert np.isin((coarse[None] - coarse[:, None])[d <= 0.1], grid.around()).all()
