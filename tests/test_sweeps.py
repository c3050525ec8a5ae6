"""Series of settings and comparisons, on tiny tables."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import clustering, sweeps
from lodestrata.sources import points


def test_settings():
    assert [s.n for s in sweeps.settings("inc_n_large", rounds=1)] == [8000 * 2**k for k in range(8)]
    assert {(s.d, s.dims) for s in sweeps.settings("inc_d_large_v2")} == {(d, int(0.8 * d)) for d in range(5, 55, 5)}
    assert [s.std for s in sweeps.settings("inc_cl_std", rounds=1)] == [16, 8, 4, 2, 1, 0.5] and len(list(sweeps.settings("diff_dist"))) == 6


def test_runs_are_kept(spark, tmp_path):
    small = replace(sweeps.Setting(), n=150, d=2, eps=0.05, min_size=20, clusters=2, dims=2, std=0.5)
    one, found = sweeps.run(spark, small, f"file://{tmp_path}")
    two, again = sweeps.run(spark, small, f"file://{tmp_path}")
    assert one == two > 0 and found.count() > 0 and found.exceptAll(again).isEmpty()
    assert sweeps.points(spark, replace(small, generator="uniform")).count() == 300


def test_cached_run_and_strategies(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert clustering.cached_run(spark, f"{tmp_path}/c", compute).count() == 3
    assert len(calls) == 1
    coords = points.from_columns(spark.range(60).selectExpr("id", "id % 7 / 7D AS a", "id % 5 / 5D AS b"), F.col("id"), ["a", "b"])
    took = sweeps.compare_strategies(coords, 2, rounds=1, eps=0.2, factor=0.1, num_obj=2, min_size=5, cells=4, rectangular=True)
    assert set(took) == set(clustering.STRATEGIES)


def test_broken_run_goes_on(spark, tmp_path, monkeypatch):
    """A run that breaks off in its second level keeps the first, and ends as one that was never broken; other settings are told."""
    rows = [(p, i, ((p * (i + 3)) % 11) / 40 + (p % 2) / 2) for p in range(80) for i in range(3)]
    coords = spark.createDataFrame(rows, "p long, dim int, x double")
    options = {"eps": 0.1, "factor": 0.0, "num_obj": 2, "min_size": 8, "cells": 4, "rectangular": True}
    want = clustering.subspace_clusters(coords, 3, **options)
    folder = f"file://{tmp_path}/run"
    whole = clustering.density.with_density

    def breaks(*args, **kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(clustering.density, "with_density", breaks)
    with pytest.raises(RuntimeError):
        clustering.subspace_clusters(coords, 3, folder=folder, **options)
    assert (tmp_path / "run/dense-1-0/_SUCCESS").exists() and not (tmp_path / "run/dense-2-0").exists()
    first = (tmp_path / "run/dense-1-0/_SUCCESS").stat().st_mtime_ns
    monkeypatch.setattr(clustering.density, "with_density", whole)
    got = clustering.subspace_clusters(coords, 3, folder=folder, **options)
    assert want.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert (tmp_path / "run/dense-1-0/_SUCCESS").stat().st_mtime_ns == first
    monkeypatch.setattr(clustering.density, "with_density", breaks)
    assert clustering.subspace_clusters(coords, 3, folder=folder, **options).count() == want.count()
    with pytest.raises(ValueError):
        clustering.subspace_clusters(coords, 3, folder=folder, **options | {"min_size": 9})
    with pytest.raises(ValueError):
        clustering.subspace_clusters(coords, 3, folder=folder, strategy="incremental", **options)
