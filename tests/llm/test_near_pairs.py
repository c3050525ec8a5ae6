"""What near duplicates cost: two points of the likelihood, few files of ids."""

from __future__ import annotations

import numpy as np

from lodestrata.llm import neardup, sketch


def test_two_points_of_the_likelihood_tell_what_the_grid_does():
    r = np.random.default_rng(5)
    n = 4000
    na = r.integers(1, 3000, n)
    nb = np.maximum(1, (na * r.uniform(0.7, 1.4, n)).astype(np.int64))
    apart, side = r.uniform(0, 1, n)[:, None], r.uniform(0, 1, n)[:, None]
    w = r.random((n, sketch.M))
    a, b = np.zeros((n, sketch.M), np.int16), np.where(w < apart * side, -1, np.where(w < apart, 1, 0)).astype(np.int16)
    told = sketch.jaccard(a, b, na, nb)
    for least in (0.0, 0.05, 0.85 - neardup.SLACK, 0.8 - neardup.SLACK, 0.9, 1.0, 1.2):
        assert np.array_equal(sketch.likely(a, b, na, nb, least), told >= least)


def test_ids_are_not_a_file_a_partition(spark):
    """Labels of a chain, whatever the number of partitions, lie in a few files."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 97)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = neardup.components(spark.range(400).selectExpr("id AS __a", "id + 1 AS __b"))
        assert len(found.inputFiles()) <= neardup.TASKS
        assert {(r["__id"], r["__comp"]) for r in found.collect()} == {(i, 0) for i in range(401)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
