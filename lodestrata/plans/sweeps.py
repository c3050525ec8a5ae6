"""Timed runs over series of settings: one parameter varies, the data are drawn for each setting, and results are kept.

A run's result is a table under `folder`, so that a sweep that ended goes on where it stopped; its time is kept beside it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..sources import generators
from .clustering import STRATEGIES, cached_run, subspace_clusters
from .cutting import stage


@dataclass(frozen=True)
class Setting:
    """Standard parameters of the series; dims: columns of each cluster."""

    n: int = 64_000
    d: int = 15
    cells: int = 4
    eps: float = 0.0003
    factor: float = 0.1
    r: float = 1.0
    num_obj: int = 1
    min_size: int = 500
    clusters: int = 16
    std: float = 0.3
    dims: int = 3
    generator: str = "gaussian"
    strategy: str = "recompute"
    round: int = 0


_DOUBLED = [2, 4, 8, 16, 32, 64]
_COLUMNS = list(range(5, 55, 5))
#: Of each series, what differs from the standard setting.
SERIES: dict[str, list[dict]] = {
    "inc_n_large": [{"n": 8000 << k, "clusters": (8000 << k) // 4000} for k in range(8)],
    "inc_d_large": [{"d": d} for d in _COLUMNS],
    "inc_d_large_v2": [{"d": d, "dims": int(0.8 * d)} for d in _COLUMNS],
    "inc_cl": [{"clusters": c} for c in _DOUBLED],
    "inc_cl_std": [{"clusters": c, "std": 32 / c} for c in _DOUBLED],
    "inc_std": [{"std": 2.0**k} for k in range(-3, 4)],
    "inc_cl_d": [{"dims": k} for k in range(2, 14, 2)],
    "diff_dist": [{"generator": g} for g in ("gaussian", "uniform")],
}


def settings(series: str, base: Setting = Setting(), rounds: int = 3) -> Iterator[Setting]:  # noqa: B008
    for change in SERIES[series]:
        for k in range(rounds):
            yield replace(base, **change, round=k)


def points(spark: SparkSession, s: Setting) -> DataFrame:
    if s.generator == "uniform":
        return generators.generate_uniform(spark, s.d, s.n, s.clusters, s.dims, seed=s.round).select("p", "dim", "x")
    return generators.generate_gaussian(spark, s.d, s.n, s.clusters, s.std, s.dims, seed=s.round).select("p", "dim", "x")


def run(spark: SparkSession, s: Setting, folder: str) -> tuple[float, DataFrame]:
    """Seconds that the run took when it was made, and its result (dims, p, label, size)."""
    path = f"{folder}/" + "-".join(f"{k}={v}" for k, v in asdict(s).items())

    def compute() -> DataFrame:
        found = subspace_clusters(
            points(spark, s), s.d, s.eps, s.factor, s.num_obj, s.min_size, r=s.r, cells=s.cells, rectangular=True, strategy=s.strategy,
        )
        took = time.perf_counter() - began
        spark.createDataFrame([(took, json.dumps(asdict(s)))], "seconds double, setting string").write.mode("overwrite").parquet(f"{path}/time")
        return found

    began = time.perf_counter()
    found = cached_run(spark, f"{path}/result", compute)
    return spark.read.parquet(f"{path}/time").first()["seconds"], found


def means(spark: SparkSession, series: str, folder: str, base: Setting = Setting(), rounds: int = 3) -> list[tuple[dict, float]]:  # noqa: B008
    """What differs and the mean seconds over the rounds, for each setting of the series."""
    took = [run(spark, s, folder)[0] for s in settings(series, base, rounds)]
    return [(change, sum(took[k * rounds : (k + 1) * rounds]) / rounds) for k, change in enumerate(SERIES[series])]


def compare_strategies(coords: DataFrame, d: int, rounds: int = 3, **options) -> dict[str, float]:
    """Mean seconds of each strategy over the rounds, after a run that does not count; all find the same clusters."""
    out, first = {}, None
    for strategy in STRATEGIES:
        times = []
        for _ in range(rounds + 1):
            began = time.perf_counter()
            found = stage(subspace_clusters(coords, d, strategy=strategy, **options), "strategy")
            times.append(time.perf_counter() - began)
        out[strategy] = sum(times[1:]) / rounds
        first = found if first is None else first
        if not (found.exceptAll(first).isEmpty() and first.exceptAll(found).isEmpty()):
            raise ValueError("strategies differ")
    return out
