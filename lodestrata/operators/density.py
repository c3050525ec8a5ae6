"""Densities of points, and dense points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cutting import stage
from . import boxes, neighbors
from .components import connected_components

#: Pairs of points (rows of one side times rows of the other) up to which pairs are joined; beyond, boxes are. The results are equal.
FEW_PAIRS = 50_000_000


def density(edges: DataFrame, eps: float, rectangular: bool, keys: tuple[str, ...] = ("mask", "p")) -> DataFrame:
    """Neighbours of each point, or the sum of their Epanechnikov weights."""
    value = F.count(F.lit(1)).cast("double") if rectangular else F.sum(1 - F.pow(F.sqrt("d2") / eps, F.lit(2.0)))
    return edges.groupBy(*keys).agg(value.alias("density"))


def dense(members: DataFrame, edges: DataFrame, eps: float, rectangular: bool, least: Column, keys: tuple[str, ...] = ("mask", "p")) -> DataFrame:
    """Members whose density is at least `least`; one without a neighbour has density 0."""
    found = members.join(density(edges, eps, rectangular, keys), list(keys), "left")
    return found.filter(F.coalesce("density", F.lit(0.0)) >= least).select(*members.columns)


def with_density(
    members: DataFrame, right: DataFrame, most: int, eps: float, rectangular: bool, keys: tuple[str, ...] = ("mask",), pairs: int | None = None, few: int = FEW_PAIRS,
    least: Column | None = None,
) -> DataFrame:
    """members(keys, p, v) with n_near and density among right(keys, p, v), which has them too. pairs: how many there may be.
    least: as in boxes.density, which may leave out what does not tell whether such densities are reached."""
    slim = members.select(*keys, "p", "v")
    if pairs is None or pairs > few:
        right = slim if right is members else right
        found = stage(boxes.density(slim, right, most, eps, rectangular, keys, boxes.room_for(pairs), least), "density")
        return members.join(found, [*keys, "v"])
    weight = F.lit(1.0) if rectangular else 1 - F.pow(F.sqrt("d2") / eps, F.lit(2.0))
    found = neighbors.pairs(slim, right, most, eps, keys).groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n_near"), F.sum(weight).alias("density"))
    return members.join(found, [*keys, "p"], "left").withColumns({"n_near": F.coalesce("n_near", F.lit(0)), "density": F.coalesce("density", F.lit(0.0))})


def components(core: DataFrame, most: int, eps: float, keys: tuple[str, ...] = ("mask", "region"), pairs: int | None = None, few: int = FEW_PAIRS) -> DataFrame:
    """keys, p, label of core(keys, p, v): the least p of the points that steps of at most eps join. A point has one row for each
    value of the first key. pairs: how many there may be."""
    if pairs is None or pairs > few:
        return boxes.components(core, most, eps, keys, keys[0], boxes.room_for(pairs))
    near = neighbors.pairs(core.select(*keys, "p", "v"), core.select(*keys, "p", "v"), most, eps, keys, ordered=True)
    return core.select(*keys, "p").join(connected_components(core, near, keys[0]), [keys[0], "p"]).select(*keys, "p", "label")
