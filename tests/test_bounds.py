"""Densities of which only so much is taken as tells which bounds they reach, in whole runs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import density
from lodestrata.plans.clustering import Clustering


@pytest.mark.parametrize("rectangular", [True, False])
def test_raw_runs_by_boxes_and_by_pairs(spark, rectangular):
    """F10 F15 F16: bounds follow each subspace's volume."""
    r = np.random.default_rng(7)
    spots = np.concatenate((r.normal(0.3, 0.05, (250, 3)), r.random((150, 3)))) * [1.0, 2.0, 0.5]
    coords = spark.createDataFrame([(p, d, float(x)) for p, v in enumerate(spots) for d, x in enumerate(v)], "p long, dim int, x double")
    run = lambda few: sorted(map(str, Clustering(coords, 3, 0.1, 1.5, 3, 10, raw=True, rectangular=rectangular, few_pairs=few).run().collect()))
    want = run(density.FEW_PAIRS)
    assert want and run(0) == want


@pytest.mark.parametrize("rectangular", [True, False])
def test_bounds_are_reached_by_the_same_points(spark, rectangular):
    """F6 F10 F11 F12 F13 F14: and no more is compared than tells it, so that a density may be less than the whole one."""
    points = spark.range(5000).selectExpr("1L AS mask", "id AS p", "array(rand(3), rand(4)) AS v").localCheckpoint()
    whole = density.with_density(points, points, 2, 0.1, rectangular).select("p", F.col("density").alias("whole"))
    at = 30.0 if rectangular else 15.0
    told = density.with_density(points, points, 2, 0.1, rectangular, least=F.array(F.lit(at), F.lit(2 * at))).select("p", "density")
    both = told.join(whole, "p")
    off = F.abs(F.col("density") - F.col("whole")) > 1e-6
    seen = both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("density") >= at) != (F.col("whole") >= at)).alias("one"),
        F.count_if((F.col("density") >= 2 * at) != (F.col("whole") >= 2 * at)).alias("two"), F.count_if(off).alias("less"), F.count_if(F.col("density") > F.col("whole") + 1e-6).alias("more"),
    ).first()
    assert (seen["n"], seen["one"], seen["two"], seen["more"]) == (5000, 0, 0, 0) and seen["less"] > 1000
