"""Expected densities of balls: numbers that the driver computes once for each subspace size, and columns by row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The value of pi that published results were computed with.
PI = 3.14


def half_gamma(n: int, pi: float = PI) -> float:
    """Gamma(n / 2)."""
    return math.prod((k / 2 - 1 for k in range(n, 2, -2)), start=1.0 if n % 2 == 0 else math.sqrt(pi))


def unit_ball(k: int, pi: float = PI) -> float:
    """Volume of the unit ball in k dimensions."""
    return pi ** (k / 2) / half_gamma(k + 2, pi)


def expected_density(k: int, eps: float, n: int, volume: float = 1.0, pi: float = PI) -> float:
    """Points of n, uniform in a cube of the given volume, that fall in a ball of radius eps."""
    return n * unit_ball(k, pi) * eps**k / volume**k


def kernel_share(k: int) -> float:
    """Mean Epanechnikov weight of a point in the ball."""
    return 2 / (k + 2)


def expected_kernel_density(k: int, eps: float, n: int, volume: float = 1.0, pi: float = PI) -> float:
    return expected_density(k, eps, n, volume, pi) * kernel_share(k)


def threshold(k: int, eps: float, n: int, factor: float, num_obj: float, rectangular: bool, volume: float = 1.0, pi: float = PI) -> float:
    """Least density of a dense point in k dimensions."""
    if rectangular:
        return max(factor * expected_density(k, eps, n, volume, pi), float(num_obj))
    return max(factor * expected_kernel_density(k, eps, n, volume, pi), num_obj * kernel_share(k))


def threshold_of(k: int, eps: float, n: int, factor: float, num_obj: float, rectangular: bool, volume: Column, pi: float = PI) -> Column:
    """The same by row, from a column of volumes; nothing is dense where the volume is 0."""
    share = 1.0 if rectangular else kernel_share(k)
    expected = F.try_divide(F.lit(factor * expected_density(k, eps, n, 1.0, pi) * share), F.pow(volume, F.lit(float(k))))
    return F.greatest(F.coalesce(expected, F.lit(float("inf"))), F.lit(num_obj * share))


def volume_of(dims: Column, ranges: Column) -> Column:
    """Product of the ranges (an array by column) of the columns of a subspace."""
    return F.aggregate(dims, F.lit(1.0), lambda v, i: v * F.get(ranges, i))
