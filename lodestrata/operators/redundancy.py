"""Sizes of clusters, and what larger subspaces make redundant.

result(mask, p, label, size): the clusters kept so far; size is the cluster's number of points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.subspaces import containments, dims_of, mask_of
from ..plans.cutting import stage


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("mask", "label").agg(F.count(F.lit(1)).alias("size"))


def min_size_filter(labels: DataFrame, min_size: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """labels (with the columns `keep`) with size, of clusters with at least min_size points. Sizes, a row a cluster, are staged, so
    that labels are neither dealt out nor sorted to meet them where Spark knows that they are few."""
    sizes = stage(cluster_sizes(labels).filter(F.col("size") >= min_size), "sizes")
    return labels.join(sizes, ["mask", "label"]).select("mask", *keep, "p", "label", "size")


def mask_pairs(points: DataFrame, result: DataFrame) -> DataFrame:
    """mask, other_mask: the result's subspaces that hold those of points, by masks of at most 63 columns and an inverted index."""
    dims = lambda x: x.select(dims_of(F.col("mask"), 63).alias("dims")).distinct()
    both = containments(dims(points), dims(result)).filter(F.col("dims") != F.col("sup_dims"))
    return both.select(mask_of(F.col("dims")).alias("mask"), mask_of(F.col("sup_dims")).alias("other_mask"))


def _overlap(points: DataFrame, result: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """points with the clusters of supersets (other_mask, other_size) that hold the same p. The result's rows are named by the
    subspaces within theirs, so that only rows of one subspace and point meet."""
    pairs = mask_pairs(points, result) if pairs is None else pairs
    other = result.select("p", F.col("mask").alias("other_mask"), F.col("size").alias("other_size")).join(pairs, "other_mask")
    return points.join(other, ["mask", "p"])


def region_redundancy(members: DataFrame, result: DataFrame, r: float, pairs: DataFrame | None = None) -> DataFrame:
    """Regions (region, mask) worth clustering: none of their points is in a cluster of a superset, or their own size times
    r exceeds, of each superset's smallest cluster that they touch, the largest. pairs(mask, other_mask): proper supersets."""
    sizes = members.groupBy("region", "mask").agg(F.count(F.lit(1)).alias("n"))
    touched = _overlap(members.select("region", "mask", "p"), result, pairs).groupBy("region", "mask", "other_mask").agg(F.min("other_size").alias("least"))
    most = touched.groupBy("region", "mask").agg(F.max("least").alias("most"))
    return sizes.join(most, ["region", "mask"], "left").filter(F.coalesce("most", F.lit(0)).eqNullSafe(0) | (F.col("n") * r > F.col("most"))).select("region", "mask")


def cluster_redundancy(labels: DataFrame, result: DataFrame, r: float, pairs: DataFrame | None = None) -> DataFrame:
    """labels(mask, p, label, size) without clusters of which a point is in a superset's cluster of over size * r points."""
    gone = _overlap(labels, result, pairs).filter(F.col("size") * r < F.col("other_size")).select("mask", "label").distinct()
    return labels.join(gone, ["mask", "label"], "left_anti").select("mask", "p", "label", "size")


def merge_result(result: DataFrame | None, labels: DataFrame) -> DataFrame:
    """The result with new clusters; regions of one subspace have no point in common."""
    return labels if result is None else result.unionByName(labels)
