"""Subspaces as ascending arrays of column numbers and, up to 63 columns, as bit masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_of(dims: Column) -> Column:
    return F.aggregate(dims, F.lit(0).cast("long"), lambda m, d: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), d.cast("int"))))


def dims_of(mask: Column, d: int) -> Column:
    """The ascending column numbers of a mask over d columns."""
    return F.filter(F.array(*(F.lit(i) for i in range(d))), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)


def within(sub: Column, sup: Column) -> Column:
    """Whether the first mask's columns are among the second's; a mask is within itself."""
    return sub.bitwiseAND(sup) == sub


def dims_within(sub: Column, sup: Column) -> Column:
    """The same of arrays, for any number of columns."""
    return F.size(F.array_except(sub, sup)) == 0


def containments(subs: DataFrame, sups: DataFrame) -> DataFrame:
    """subs.dims, sups.sup_dims of each subspace (a distinct array dims) within another, itself included: an inverted index of
    the larger ones by column, met only in the rarest column of the smaller."""
    index = sups.select(F.col("dims").alias("sup_dims"), F.explode("dims").alias("__column"))
    often = index.groupBy("__column").agg(F.count(F.lit(1)).alias("__often"))
    rare = subs.select("dims", F.explode("dims").alias("__column")).join(often, "__column").groupBy("dims").agg(F.min(F.struct("__often", "__column")).alias("__least"))
    met = rare.select("dims", F.col("__least.__column").alias("__column")).join(index, "__column")
    return met.filter(dims_within(F.col("dims"), F.col("sup_dims"))).select("dims", "sup_dims")


def result_order(dims: Column) -> Column:
    """Sort key of subspaces: lexicographic from the last column, shorter first."""
    return F.reverse(dims)
