"""Synthetic point tables with planted clusters, drawn on the executors from a seed.

A blob is (points, columns, centre, std): its points lie around the centre in those columns; all other coordinates are
uniform in (-100, 100). Each returns coords(p, dim, x, cluster), cluster 0 for noise. Every draw is a hash of seed, point and
column, so that a seed gives the same table however it is partitioned.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOW, HIGH = -100.0, 100.0
#: Points that a task draws.
DRAWN = 25_000


@dataclass(frozen=True)
class Blob:
    """start: its first point; by default, behind the blobs before it. width: uniform within it instead of normal."""

    points: int
    dims: tuple[int, ...]
    centre: tuple[float, ...]
    std: float
    width: float | None = None
    start: int | None = None


def uniform(seed: int, stream: str):
    """A uniform draw in (0, 1) for each p and dim: 52 bits of the md5 of seed, stream, p and dim."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stream), F.col("p").cast("string"), F.col("dim").cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def planted(spark: SparkSession, n: int, d: int, blobs: list[Blob], seed: int, ids: DataFrame | None = None) -> DataFrame:
    """Points 0 to n - 1 (or those of ids(p), of such numbers), with the blobs that have no start one after the other; the rest
    is noise. Of blobs that meet in a coordinate, the last holds it."""
    rows = spans(blobs, n)
    ids = spark.range(n).select(F.col("id").alias("p")) if ids is None else ids.select("p")
    if n > DRAWN:  # draws cost more than ids, of which a file of few megabytes has many
        ids = ids.repartition(-(-n // DRAWN), "p")
    cells = ids.select("p", F.explode(F.array(*(F.lit(i) for i in range(d)))).alias("dim"))
    normal = F.sqrt(-2 * F.log(uniform(seed, "r"))) * F.cos(2 * math.pi * uniform(seed, "a"))
    x, cluster = uniform(seed, "u") * (HIGH - LOW) + LOW, F.lit(0)
    for lo, hi, k, dim, centre, std, width in rows:
        here = (F.col("dim") == dim) & (F.col("p") >= lo) & (F.col("p") < hi)
        near = centre + normal * std if width is None else centre + (uniform(seed, "w") - 0.5) * width
        x, cluster = F.when(here, near).otherwise(x), F.when(here, F.lit(k)).otherwise(cluster)
    return cells.select("p", "dim", x.alias("x"), cluster.alias("cluster"))


def spans(blobs: list[Blob], n: int) -> list[tuple]:
    """(first point, end, cluster, dim, centre, std, width) of each column of each blob."""
    out, at = [], 0
    for k, b in enumerate(blobs):
        lo = at if b.start is None else b.start
        at = lo + b.points if b.start is None else at
        out += [(lo, min(n, lo + b.points), k + 1, dim, c, b.std, b.width) for dim, c in zip(b.dims, b.centre, strict=True)]
    return out


def gaussian_blobs(d: int, n: int, clusters: int, std: float, dims: int, noise: float, seed: int) -> list[Blob]:
    """Equal blobs, each in columns of its own choice."""
    draw = random.Random(seed)
    size = int((1 - noise) * n / clusters)
    return [Blob(size, tuple(sorted(draw.sample(range(d), dims))), tuple(draw.uniform(LOW, HIGH) for _ in range(dims)), std) for _ in range(clusters)]


def generate_gaussian(spark: SparkSession, d: int, n: int, clusters: int, std: float, dims: int, noise: float = 0.01, seed: int = 0, ids: DataFrame | None = None) -> DataFrame:
    return planted(spark, n, d, gaussian_blobs(d, n, clusters, std, dims, noise, seed), seed, ids)


def leading_blobs(n: int, d: int, sizes: list[tuple[int, int, float]], seed: int, overlay: bool = False) -> list[Blob]:
    """Blobs of (points, dims, std) in the leading columns, one behind the other. A blob of more points than are left has no
    place, unless overlay: then it lies over the first points, in the first columns that no blob has there, if enough points
    have room in so many columns."""
    draw = random.Random(seed)
    out: list[Blob] = []
    taken: list[tuple[int, int]] = []  # points and columns of the blobs that lie behind each other
    for points, k, std in sizes:
        left = n - sum(m for m, _ in taken)
        centre = tuple(draw.uniform(LOW, HIGH) for _ in range(k))
        if k > d:
            continue
        if points <= left:
            out.append(Blob(points, tuple(range(k)), centre, std, start=n - left))
            taken.append((points, k))
        elif overlay:
            room = [(m, columns) for m, columns in taken if d - columns >= k]
            if sum(m for m, _ in room) + left >= points:
                first = max((columns for _, columns in room), default=0)
                out.append(Blob(points, tuple(range(first, first + k)), centre, std, start=0))
    return out


def random_shapes(d: int, clusters: int, seed: int) -> list[tuple[float, tuple[int, ...], tuple[float, ...], float]]:
    """A share of the largest size, columns, centre and spread of each of the blobs."""
    draw = random.Random(seed)
    out = []
    for _ in range(clusters):
        k = draw.randint(1, d)
        out.append((draw.random(), tuple(sorted(draw.sample(range(d), k))), tuple(draw.uniform(LOW, HIGH) for _ in range(k)), draw.uniform(0.1, 5)))
    return out


def random_blobs(n: int, d: int, clusters: int, seed: int) -> list[Blob]:
    """Blobs of random sizes, columns and spreads."""
    return [Blob(1 + int(share * max(0, n // clusters - 1)), dims, centre, std) for share, dims, centre, std in random_shapes(d, clusters, seed)]


def generate_uniform(
    spark: SparkSession, d: int, n: int, clusters: int, dims: int, share: float = 0.99, width: float = 2.0, seed: int = 0, ids: DataFrame | None = None
) -> DataFrame:
    """Box clusters: uniform within `width` in their columns."""
    return planted(spark, n, d, box_blobs(d, n, clusters, dims, share, width, seed), seed, ids)


def box_blobs(d: int, n: int, clusters: int, dims: int, share: float, width: float, seed: int) -> list[Blob]:
    return [replace(b, width=width) for b in gaussian_blobs(d, n, clusters, 0.0, dims, 1 - share, seed)]
