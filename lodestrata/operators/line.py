"""Densities and components in one column, without pairs of points.

Copies of a value are one row with a count. Values lie in buckets of a `split`-th of eps: of the buckets that are wholly
within eps, only number, sum and sum of squares are used; of the four that eps cuts, the values. So each row is sent to
five buckets, and a bucket's task holds about five times BUCKET rows (copies of one value are one).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cutting import stage

#: Values that a bucket of evenly spread values has.
BUCKET = 20_000
#: Buckets are this much narrower than their share of eps, so that rounding never takes a whole bucket for near that is not.
NARROWER = 1 - 1e-6


def by_group(batches: Iterator[pa.RecordBatch], keys: int, fn: Callable) -> Iterator[pa.RecordBatch]:
    """fn(rows, as one record batch) of each run of equal values in the first `keys` columns; yields what is not None."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
            if (out := fn(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
                yield out
            held = []
        at = 0
        for stop in edge.tolist():
            held.append(batch.slice(at, stop - at))
            at = stop
            if (out := fn(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
                yield out
            held = []
        held.append(batch.slice(at))
    if held and (out := fn(pa.Table.from_batches(held).combine_chunks().to_batches()[0])) is not None:
        yield out


def _reach(own: np.ndarray, x: np.ndarray, eps: float) -> np.ndarray:
    """How many of the ascending x, none under own, are within eps of each own value, exactly as the difference rounds."""
    n = np.searchsorted(x, own + eps, "right")
    while len(x):
        over = (n > 0) & (x[np.maximum(n - 1, 0)] - own > eps)
        under = (n < len(x)) & (x[np.minimum(n, len(x) - 1)] - own <= eps)
        if not (over.any() or under.any()):
            break
        n = n - over + (under & ~over)
    return n


def _side(own: np.ndarray, x: np.ndarray, n: np.ndarray, eps: float, rectangular: bool) -> np.ndarray:
    """Density that the values x (ascending, n times each, none under own) give to own."""
    reach = _reach(own, x, eps)
    before = lambda v: np.concatenate(([0.0], np.cumsum(v)))[reach]
    if rectangular or not len(x):
        return before(n)
    mid = x[0]
    d, o = x - mid, own - mid
    return before(n) - (before(n * d * d) - 2 * o * before(n * d) + o * o * before(n)) / (eps * eps)


def _densities(eps: float, rectangular: bool, split: int) -> Callable:
    def one(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        off, x, n, s1, s2 = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(2, 7))
        mine = off == 0
        own = x[mine]
        if not len(own):
            return None
        total = np.zeros(len(own))
        order = np.argsort(x, kind="stable")
        for sign in (1, -1):
            use = order[(off[order] * sign >= split) & (off[order] != _SELF)]
            use = use if sign > 0 else use[::-1]
            total += _side(sign * own, sign * x[use], n[use].astype(float), eps, rectangular)
        whole = np.flatnonzero((np.abs(off) < split) & ~mine | (off == _SELF))
        for i in whole.tolist():
            if rectangular:
                total += n[i]
            else:
                d = x[i] - own
                total += n[i] - (s2[i] + 2 * s1[i] * d + n[i] * d * d) / (eps * eps)
        return pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(mine)), pa.array(own), pa.array(total - 1.0)], ["dim", "__x", "density"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_group(batches, 2, one)

    return run


_SELF = -(1 << 30)


def line_density(coords: DataFrame, eps: float, rectangular: bool, n: int, split: int | None = None) -> DataFrame:
    """dim, x, density: of each value of each column, the points within eps (or their Epanechnikov weights) but for itself.

    n: about how many points there are; it chooses the buckets' width, not the result.
    """
    split = split or max(1, min(1024, math.ceil(n * eps / BUCKET)))
    width = eps * NARROWER / split
    values = coords.groupBy("dim", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.floor(F.col("x").cast("double") / width))
    mid = (F.col("b") + 0.5) * width
    d = F.col("x").cast("double") - mid
    sums = values.groupBy("dim", "b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * d).alias("s1"), F.sum(F.col("n") * d * d).alias("s2"))
    to = lambda ends: F.explode(F.array(*(F.lit(j) for j in ends))).alias("off")
    zero = F.lit(0.0)
    single = values.select("dim", "b", to([0, split, split + 1, -split, -split - 1]), F.col("x").cast("double").alias("x"), "n", zero.alias("s1"), zero.alias("s2"))
    whole = sums.select("dim", "b", to([_SELF, *range(1, split), *range(-split + 1, 0)]), mid.alias("x"), "n", "s1", "s2")
    sent = single.unionByName(whole).withColumn("t", F.when(F.col("off") == _SELF, F.col("b")).otherwise(F.col("b") - F.col("off")))
    dealt = sent.select("dim", "t", "off", "x", "n", "s1", "s2").repartition("dim", "t").sortWithinPartitions("dim", "t")
    return dealt.mapInArrow(_densities(eps, rectangular, split), "dim int, __x double, density double")


def with_line_density(members: DataFrame, coords: DataFrame, eps: float, rectangular: bool, n: int, split: int | None = None) -> DataFrame:
    """members(dim, x, ...) with density."""
    found = stage(line_density(coords, eps, rectangular, n, split), "line").withColumnRenamed("dim", "__dim")
    same = (members["dim"] == found["__dim"]) & (members["x"].cast("double") == found["__x"])
    return members.join(found, same).drop("__dim", "__x")


def line_components(members: DataFrame, eps: float, keys: list[str]) -> DataFrame:
    """members(*keys, p, x) with label: the least p of the points that gaps of at most eps join, for each of the keys.

    Points of one bucket, narrower than eps, belong together, so that a window has a row for each bucket of a column.
    """
    rows = members.withColumn("__b", F.floor(F.col("x").cast("double") / (eps * NARROWER)))
    buckets = rows.groupBy(*keys, "__b").agg(F.min(F.col("x").cast("double")).alias("__lo"), F.max(F.col("x").cast("double")).alias("__hi"), F.min("p").alias("__p"))
    w = Window.partitionBy(*keys).orderBy("__b")
    begun = buckets.withColumn("__new", F.when(F.coalesce(F.col("__lo") - F.lag("__hi").over(w) <= eps, F.lit(False)), None).otherwise(F.col("__b")))
    named = begun.withColumn("__island", F.max("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    least = named.groupBy(*keys, "__island").agg(F.min("__p").alias("label"))
    labels = named.join(least, [*keys, "__island"]).select(*keys, "__b", "label")
    return rows.join(labels, [*keys, "__b"]).select(*members.columns, "label")
