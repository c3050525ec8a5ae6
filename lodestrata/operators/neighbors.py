"""Pairs of points within eps, as equi-joins on grid buckets.

edges(mask, p, q, d2): q is within eps of p in the mask's columns, p and q different; both directions are present.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets are this much wider than eps, so that rounding never puts a pair two buckets apart.
WIDER = 1 + 1e-6
#: Columns that take part in the bucket key; each triples the probes and divides the bucket.
INDEXED = 3


def close(d2: Column, eps: float) -> Column:
    return F.sqrt(d2) <= eps


def wide(coords: DataFrame, dims: list[int]) -> DataFrame:
    """p and x_<dim> columns, of points that have all of them; pivoting is one aggregation by p."""
    some = coords.filter(F.col("dim").isin(dims))
    out = some.groupBy("p").agg(*(F.max(F.when(F.col("dim") == i, F.col("x"))).alias(f"x_{i}") for i in dims))
    return out.dropna()


def eps_join(left: DataFrame, right: DataFrame, dims: list[int], eps: float) -> DataFrame:
    """Edges from points of left to points of right (both wide), by bucket of the first INDEXED columns."""
    keys = dims[:INDEXED]
    width = eps * WIDER
    bucket = lambda i: F.floor(F.col(f"x_{i}") / width)
    probes = left
    for i in keys:
        probes = probes.withColumn(f"b_{i}", F.explode(F.array(*(bucket(i) + s for s in (-1, 0, 1)))))
    probes = probes.select("p", *(f"b_{i}" for i in keys), *(F.col(f"x_{i}").alias(f"l_{i}") for i in dims))
    built = right.select(F.col("p").alias("q"), *(bucket(i).alias(f"b_{i}") for i in keys), *(f"x_{i}" for i in dims))
    both = probes.join(built, [f"b_{i}" for i in keys]).filter(F.col("p") != F.col("q"))
    d2 = reduce(lambda a, b: a + b, ((F.col(f"l_{i}") - F.col(f"x_{i}")) * (F.col(f"l_{i}") - F.col(f"x_{i}")) for i in dims))
    return both.withColumn("d2", d2).filter(close(F.col("d2"), eps)).select("p", "q", "d2")


def pairs(left: DataFrame, right: DataFrame, k: int, eps: float, keys: tuple[str, ...] = ("mask",), ordered: bool = False) -> DataFrame:
    """The keys, p, q, d2 of pairs of left(*keys, p, v) and right(*keys, p, v), v of at most k columns (0 in those that it lacks),
    that are within eps: an equi-join on the keys and the bucket of the first INDEXED columns, for all subspaces at once.
    ordered: only pairs p < q."""
    width = eps * WIDER
    used = range(min(k, INDEXED))
    at = lambda v, i: F.coalesce(F.get(v, F.lit(i)), F.lit(0.0))
    bucket = lambda i: F.floor(at("v", i) / width)
    probes = left.select(*keys, "p", F.col("v").alias("__l"), *(bucket(i).alias(f"__b{i}") for i in used))
    for i in used:
        probes = probes.withColumn(f"__b{i}", F.explode(F.array(*(F.col(f"__b{i}") + s for s in (-1, 0, 1)))))
    built = right.select(*keys, F.col("p").alias("q"), F.col("v").alias("__r"), *(bucket(i).alias(f"__b{i}") for i in used))
    both = probes.join(built, [*keys, *(f"__b{i}" for i in used)]).filter(F.col("p") < F.col("q") if ordered else F.col("p") != F.col("q"))
    gap = lambda i: at("__l", i) - at("__r", i)
    d2 = reduce(lambda a, b: a + b, (gap(i) * gap(i) for i in range(k)))
    return both.withColumn("d2", d2).filter(close(F.col("d2"), eps)).select(*keys, "p", "q", "d2")


def refine(edges: DataFrame, members: DataFrame, coords: DataFrame, eps: float) -> DataFrame:
    """Edges of children (mask, parent, p, dim, x) from their parents': neighbours in more columns are among those in fewer."""
    kids = members.select(F.col("mask").alias("child"), F.col("parent").alias("mask"), "p", "dim", F.col("x").alias("xp"))
    q = coords.select(F.col("p").alias("q"), "dim", F.col("x").alias("xq"))
    d = F.col("xp") - F.col("xq")
    return (
        edges.join(kids, ["mask", "p"]).join(q, ["q", "dim"]).withColumn("d2", F.col("d2") + d * d)
        .filter(close(F.col("d2"), eps)).select(F.col("child").alias("mask"), "p", "q", "d2")
    )
