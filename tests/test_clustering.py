"""Operators on hand-computed fixtures, and the level-wise plan against a depth-first brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrata import queries
from lodestrata.functions import subspaces, volumes
from lodestrata.operators import grid, line, neighbors, redundancy, scaling
from lodestrata.operators.components import connected_components
from lodestrata.plans import cutting
from lodestrata.plans.clustering import Clustering, subspace_clusters, to_lists, to_table
from lodestrata.sources import generators, points


def table(spark, rows):
    return spark.createDataFrame([(p, i, float(x)) for p, row in enumerate(rows) for i, x in enumerate(row)], "p long, dim int, x double")


def test_normalize(spark):
    got = {(r["p"], r["dim"]): r["x"] for r in scaling.normalize(table(spark, [(0, 10, 7), (5, 20, 7), (10, 30, 7)])).collect()}
    assert [got[p, i] for p in range(3) for i in range(3)] == [0, 0, 0, 0.5, 0.5, 0, 1, 1, 0]


def test_cells_and_borders(spark):
    xs = [0, 0.2499, 0.25, 0.5, 0.99, 1.0, 0.239, 0.245, 0.995]
    got = {r["p"]: (r["cell"], r["is_border"]) for r in grid.cells(table(spark, [(x,) for x in xs]), 4, 0.01).collect()}
    assert [got[p][0] for p in range(6)] == [0, 0, 1, 2, 3, 3] and [got[p][1] for p in range(6, 9)] == [False, True, True]


@pytest.mark.parametrize(("flags", "want"), [("TFTF", [0, 0, 2, 2]), ("TTFF", [0, 0, 0, 3]), ("FFFT", [0, 1, 2, 3]), ("T-TF", [0, None, 2, 2])])
def test_runs(spark, flags, want):
    rows = [(0, k, f == "T") for k, f in enumerate(flags) if f != "-"]
    got = {r["cell"]: r["run"] for r in grid.runs(spark.createDataFrame(rows, "dim int, cell int, flag boolean"), ["dim"]).collect()}
    assert [got.get(k) for k in range(4)] == want


def test_subspaces(spark):
    df = spark.createDataFrame([([0, 2], [0, 1, 2]), ([1], [0, 2]), ([1], [1])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    got = df.select(subspaces.within(subspaces.mask_of(a), subspaces.mask_of(b)).alias("m"), subspaces.dims_within(a, b).alias("d"), subspaces.dims_of(subspaces.mask_of(a), 3).alias("back"), "a").collect()
    assert [r["m"] for r in got] == [r["d"] for r in got] == [True, False, True] and all(r["back"] == r["a"] for r in got)
    every = spark.range(1, 8).select(subspaces.dims_of(F.col("id"), 3).alias("d")).orderBy(subspaces.result_order(F.col("d"))).collect()
    assert [r["d"] for r in every] == [[0], [1], [0, 1], [2], [0, 2], [1, 2], [0, 1, 2]]


def test_thresholds():
    assert [round(volumes.expected_density(k, 0.1, 500), 4) for k in (1, 2, 3)] == [100, 15.7, 2.0933]
    assert [round(volumes.expected_kernel_density(k, 0.1, 500), 3) for k in (1, 2, 3)] == [66.667, 7.85, 0.837]
    assert math.isclose(volumes.unit_ball(5, math.pi), math.pi**2.5 / math.gamma(3.5))


def test_neighbours(spark):
    wide = neighbors.wide(table(spark, [(0,), (0.0625,), (0.125,), (0.5,)]), [0])
    got = sorted((r["p"], r["q"]) for r in neighbors.eps_join(wide, wide, [0], 0.1).collect())
    assert got == [(0, 1), (1, 0), (1, 2), (2, 1)]
    edge = neighbors.wide(table(spark, [(0.3,), (0.3 + 0.1,)]), [0])
    assert neighbors.eps_join(edge, edge, [0], abs((0.3 + 0.1) - 0.3)).count() == 2


@pytest.mark.parametrize(("rectangular", "split"), [(True, 1), (True, 3), (False, 1), (False, 4)])
def test_densities_in_one_column(spark, rectangular, split):
    r = random.Random(5)
    xs = [[round(r.random(), 2), r.gauss(0, 30)] for _ in range(150)] + [[0.5, 0.0]] * 40 + [[0.3, -0.1], [0.3 + 0.1, 0.0]]
    coords = table(spark, xs)
    for eps in (0.1, abs((0.3 + 0.1) - 0.3)):
        want = {}
        for p, row in enumerate(xs):
            for i, x in enumerate(row):
                near = [abs(other[i] - x) for q, other in enumerate(xs) if q != p and abs(other[i] - x) <= eps]
                want[p, i] = len(near) if rectangular else sum(1 - (g / eps) ** 2 for g in near)
        got = {(g["p"], g["dim"]): g["density"] for g in line.with_line_density(coords, coords, eps, rectangular, 0, split).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_components_in_one_column(spark):
    r = random.Random(6)
    rows = [(g, p, x) for p in range(200) for g, x in [(p % 2, r.uniform(-1, 1) ** 3)]]
    got = {(x["g"], x["p"]): x["label"] for x in line.line_components(spark.createDataFrame(rows, "g long, p long, x double"), 0.01, ["g"]).collect()}
    for g in (0, 1):
        mine, label, last = sorted((x, p) for h, p, x in rows if h == g), {}, None
        groups: list[list[int]] = []
        for x, p in mine:
            if last is None or x - last > 0.01:
                groups.append([])
            groups[-1].append(p)
            last = x
        label = {p: min(group) for group in groups for p in group}
        assert {p: got[g, p] for p in label} == label and len(groups) > 3


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_random_graphs(spark, few):
    r = random.Random(few)
    pairs = [(r.choice((3, 4)), r.randrange(120), r.randrange(120)) for _ in range(110)]
    vertices = spark.range(120).selectExpr("explode(array(3L, 4L)) AS mask", "id AS p")
    got = {(x["mask"], x["p"]): x["label"] for x in connected_components(vertices, spark.createDataFrame(pairs, "mask long, p long, q long"), few=few).collect()}
    label = {(m, p): p for m in (3, 4) for p in range(120)}
    for _ in range(120):
        for m, a, b in pairs:
            label[m, a] = label[m, b] = min(label[m, a], label[m, b])
    assert got == label


def test_scaled_and_calls(spark):
    with pytest.raises(ValueError):
        Clustering(table(spark, [(0.0,), (2.0,)]), 1, 0.1, 1, 1, 1, scaled=True)
    run = Clustering(table(spark, [(x / 100, 0.5) for x in range(40)] + [(1.0, 0.0)]), 2, 0.05, 0.0, 1, 5, cells=4)
    found = run.run()
    assert run.calls == 1 + 3 and {tuple(r["dims"]) for r in found.collect()} == {(0, 1)}


def test_components(spark):
    vertices = spark.createDataFrame([(m, p) for m in (1, 2) for p in (0, 1, 2, 5, 6, 9)], "mask long, p long")
    pairs = [(1, 0, 1), (1, 1, 2), (1, 5, 6), (2, 6, 9), (2, 9, 0)]
    edges = spark.createDataFrame(pairs + [(m, b, a) for m, a, b in pairs], "mask long, p long, q long")
    got = {(r["mask"], r["p"]): r["label"] for r in connected_components(vertices, edges).collect()}
    assert [got[1, p] for p in (0, 1, 2, 5, 6, 9)] == [0, 0, 0, 5, 5, 9] and [got[2, p] for p in (0, 1, 2, 5, 6, 9)] == [0, 1, 2, 5, 0, 0]
    chain = [(1, i, i + 1) for i in range(40)]
    line = connected_components(spark.range(41).select(F.lit(1).cast("long").alias("mask"), F.col("id").alias("p")), spark.createDataFrame(chain + [(m, b, a) for m, a, b in chain], "mask long, p long, q long"))
    assert line.filter("label <> 0").count() == 0


def test_redundancy(spark):
    result = redundancy.min_size_filter(spark.createDataFrame([(3, 2, 2), (3, 3, 2), (3, 4, 2)], "mask long, p long, label long"), 1)
    mine = redundancy.min_size_filter(spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 7, 7), (2, 8, 7)], "mask long, p long, label long"), 2)
    assert {r["mask"] for r in redundancy.cluster_redundancy(mine, result, 1.0).collect()} == {2}
    tie = redundancy.min_size_filter(spark.createDataFrame([(3, 1, 1), (3, 2, 1)], "mask long, p long, label long"), 1)
    assert redundancy.cluster_redundancy(mine, tie, 1.0).count() == 4
    regions = mine.select(F.col("label").alias("region"), "mask", "p")
    assert {r["mask"] for r in redundancy.region_redundancy(regions, tie, 1.0).collect()} == {2}


def test_prefix_sum(spark):
    df = spark.createDataFrame([(i * 7 - 50, i) for i in range(40)], "k long, v long")
    got = {r["k"]: r["prefix_sum"] for r in grid.prefix_sum(df, "k", "v", 4).collect()}
    assert got == {i * 7 - 50: i * (i + 1) // 2 for i in range(40)}


def brute(rows, eps, factor, num_obj, min_size, r, c, rectangular, ghosts):
    """Depth first, one region at a time; markers are kept as sets of (point, column)."""
    n, d = len(rows), len(rows[0])
    cell = [[min(int(x * c), c - 1) for x in row] for row in rows]
    border = [[x >= (k + 1) / c - eps for x, k in zip(row, ks, strict=True)] for row, ks in zip(rows, cell, strict=True)]
    least = {k: volumes.threshold(k, eps, n, factor, num_obj, rectangular) for k in range(1, d + 1)}

    def near(p, dims):
        out = []
        for q in range(n):
            d2 = sum((rows[p][i] - rows[q][i]) ** 2 for i in dims)
            if q != p and math.sqrt(d2) <= eps:
                out.append((q, d2))
        return out

    def strong(p, dims, k):
        found = near(p, dims)
        return (len(found) if rectangular else sum(1 - (math.sqrt(x) / eps) ** 2 for _, x in found)) >= least[k]

    result: dict[tuple, dict[int, tuple[int, int]]] = {}

    def visit(dims, alive, marks):
        for j in range((dims[-1] + 1) if dims else 0, d):
            groups: dict[int, list[int]] = {}
            for p in alive:
                groups.setdefault(cell[p][j], []).append(p)
            flag = {k: any(border[p][j] for p in ps) or any(cell[g][j] == k and i == j for g, i in marks) for k, ps in groups.items()}
            sub, pending, k = (*dims, j), {}, 0
            while k < c:
                if k not in groups:
                    k += 1
                    continue
                run = [k]
                while flag[run[-1]] and run[-1] + 1 in groups:
                    run.append(run[-1] + 1)
                k = run[-1] + 1
                mine = [p for x in run for p in groups[x]]
                if len(mine) < min_size:
                    continue
                kept = [p for p in mine if strong(p, sub, d)]
                if len(kept) < min_size:
                    continue
                free = lambda i: [t for t in range(i + 1) if t not in sub]  # noqa: B023, E731
                there = {(i, tuple(cell[p][t] for t in free(i))) for p in kept for i in range(d)}
                left = {(g, i) for g, i in marks if i > j and cell[g][j] in run and (i, tuple(cell[g][t] for t in free(i))) in there} if ghosts else set()
                if not ghosts:
                    left = set()
                visit(sub, kept, left)
                most = 0
                for other, labels in result.items():
                    if set(sub) < set(other):
                        sizes = [labels[p][1] for p in kept if p in labels]
                        most = max(most, min(sizes, default=0))
                if most and not len(kept) * r > most:
                    continue
                core = {p for p in kept if strong(p, sub, len(sub))}
                seen: set[int] = set()
                for p in sorted(core):
                    if p in seen:
                        continue
                    stack, group = [p], {p}
                    while stack:
                        for q, _ in near(stack.pop(), sub):
                            if q in core and q not in group:
                                group.add(q)
                                stack.append(q)
                    seen |= group
                    gone = any(set(sub) < set(o) and any(q in labels and len(group) * r < labels[q][1] for q in group) for o, labels in result.items())
                    if len(group) >= min_size and not gone:
                        pending |= {q: (p, len(group)) for q in group}
            if pending:
                result.setdefault(sub, {}).update(pending)

    marks = {(p, j) for p in range(n) for j in range(d) if border[p][j]} if ghosts else set()
    visit((), list(range(n)), marks)
    return {(s, p, *x) for s, labels in result.items() for p, x in labels.items()}


def blobs(seed, n, d):
    r = random.Random(seed)
    centres = [[r.random() for _ in range(d)] for _ in range(3)]
    rows = [[min(1.0, max(0.0, r.gauss(m, 0.04))) if r.random() < 0.8 else r.random() for m in r.choice(centres)] for _ in range(n)]
    for i in range(d):
        rows[0][i], rows[1][i] = 0.0, 1.0
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {"rectangular": True}), (2, {"rectangular": False, "strategy": "recompute"}), (3, {"rectangular": True, "strategy": "batched", "ghost_markers": False, "r": 0.5})])
def test_against_depth_first(spark, seed, options):
    rows = blobs(seed, 90, 3)
    own = {"r": 1.0, "ghost_markers": True} | options
    want = brute(rows, 0.08, 0.5, 3, 8, own["r"], 6, own["rectangular"], own["ghost_markers"])
    got = subspace_clusters(table(spark, rows), 3, 0.08, 0.5, 3, 8, cells=6, **options)
    assert {(tuple(x["dims"]), x["p"], x["label"], x["size"]) for x in got.collect()} == want and want


def test_lists_and_limits(spark):
    found = spark.createDataFrame([([1], 0, 0, 2), ([1], 2, 0, 2), ([0], 1, 1, 1)], "dims array<int>, p long, label long, size long")
    assert to_lists(found, 3) == ([[0], [1]], [[-1, 1, -1], [0, -1, 0]])
    long = to_table(found, spark.range(3).withColumnRenamed("id", "p"))
    assert sorted((r["place"], r["dims"], r["p"], r["label"]) for r in long.collect()) == [(1, "0", 0, -1), (1, "0", 1, 1), (1, "0", 2, -1), (2, "1", 0, 0), (2, "1", 1, -1), (2, "1", 2, 0)]
    assert to_table(found.limit(0), spark.range(3).withColumnRenamed("id", "p")).count() == 0
    with pytest.raises(ValueError):
        Clustering(table(spark, [(0.0,)]), 0, 0.1, 1, 1, 1)
    with pytest.warns(UserWarning):
        Clustering(table(spark, [(0.0,), (1.0,)]), 1, 0.5, 1, 1, 1, cells=4)


def test_sources(spark, tmp_path):
    (tmp_path / "g.csv").write_text("1,0.5, 2,9\n2,1.5, 4,9\n")
    got = points.read_numbers(spark, str(tmp_path / "g.csv"), 4, drop=(0, 3))
    assert sorted((r["p"], r["dim"], r["x"]) for r in got.collect()) == [(0, 0, 0.5), (0, 1, 2.0), (1, 0, 1.5), (1, 1, 4.0)]
    made = generators.generate_gaussian(spark, 4, 200, 2, 0.5, 2, seed=1)
    assert made.count() == 800 and made.filter("cluster = 1").groupBy("dim").count().count() == 2
    assert made.filter("cluster > 0").groupBy("cluster", "dim").agg(F.stddev("x").alias("s")).filter("s > 1").count() == 0
    again = generators.generate_gaussian(spark, 4, 200, 2, 0.5, 2, seed=1).repartition(7)
    assert made.exceptAll(again).isEmpty() and not made.exceptAll(generators.generate_gaussian(spark, 4, 200, 2, 0.5, 2, seed=2)).isEmpty()
    assert generators.generate_uniform(spark, 3, 50, 2, 2).count() == 150
    laid = generators.leading_blobs(100, 5, [(60, 2, 1.0), (40, 3, 1.0), (50, 2, 1.0), (200, 1, 1.0), (10, 6, 1.0)], 1, overlay=True)
    assert [(b.start, b.dims) for b in laid] == [(0, (0, 1)), (60, (0, 1, 2)), (0, (3, 4))]
    assert len(generators.leading_blobs(100, 5, [(60, 2, 1.0), (50, 3, 1.0)], 1)) == 1


def test_planted_clusters_are_found(spark):
    blobs = generators.gaussian_blobs(n=1200, **queries.PLANTED)
    coords = generators.generate_gaussian(spark, n=1200, **queries.PLANTED).select("p", "dim", "x")
    result = subspace_clusters(coords, queries.PLANTED["d"], rectangular=True, **queries.RECOVERY)
    found = {tuple(r["dims"]): r["n"] for r in result.groupBy("dims", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(found.get(b.dims, 0) > 0.9 * b.points for b in blobs)


def test_blobs_in_given_points(spark):
    """Coordinates depend on seed, point and column, so that given ids have those of the points of the same numbers."""
    ids = spark.range(0, 200, 3).withColumnRenamed("id", "p")
    some = generators.generate_gaussian(spark, 4, 200, 2, 0.5, 2, seed=1, ids=ids)
    every = generators.generate_gaussian(spark, 4, 200, 2, 0.5, 2, seed=1)
    assert some.exceptAll(every).isEmpty() and some.count() == 4 * ids.count()


def test_file_order(spark, tmp_path):
    """Lines are numbered by file and place, however many files and blocks there are and whichever is the largest."""
    want, at = [], 0
    for name, lines in (("a", 5), ("b", 300), ("c", 0), ("d", 40)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{at + i},7\n" for i in range(lines)))
        want += range(at, at + lines)
        at += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", 128)
    try:
        rows = points.read_numbers(spark, str(tmp_path), 2).filter("dim = 0").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["p"], int(r["x"])) for r in rows) == [(k, k) for k in want]


def test_repeated_points_and_missing_coordinates(spark):
    """Of rows with one point and column the largest counts; a point without a coordinate is in no region of that column."""
    rows = [(p, i, 0.5 + 0.01 * (p % 3)) for p in range(30) for i in range(2)]
    df = spark.createDataFrame([*rows, (0, 0, 0.4), (0, 1, 0.4), *rows[:6], (50, 0, 0.5), (60, 1, 0.0), (61, 1, 1.0)], "p long, dim int, x double")
    got = Clustering(df, 2, 0.05, 0.0, 1, 5, cells=4, scaled=True, rectangular=True, r=1e9).run()
    found = {(tuple(r["dims"]), r["p"]) for r in got.collect()}
    assert {p for s, p in found if s == (0,)} == {*range(30), 50} and {p for s, p in found if s == (0, 1)} == set(range(30))


def test_containments(spark):
    """All pairs of subspaces of which one is within the other, beyond 63 columns too."""
    r = random.Random(9)
    sets = list({tuple(sorted(r.sample(range(70), r.randint(1, 6)))) for _ in range(80)} | {tuple(sorted(r.sample(range(6), r.randint(1, 4)))) for _ in range(30)})
    df = spark.createDataFrame([(list(x),) for x in sets], "dims array<int>")
    got = {(tuple(x["dims"]), tuple(x["sup_dims"])) for x in subspaces.containments(df, df).collect()}
    assert got == {(a, b) for a in sets for b in sets if set(a) <= set(b)}


def test_volumes_by_row(spark):
    """Thresholds of rows are those of their volumes; nothing is dense where there is none."""
    df = spark.createDataFrame([(v,) for v in (1.0, 0.5, 30.0, 0.0)], "volume double")
    for rectangular in (True, False):
        got = [r[0] for r in df.select(volumes.threshold_of(3, 0.1, 500, 2.0, 4, rectangular, F.col("volume"))).collect()]
        want = [volumes.threshold(3, 0.1, 500, 2.0, 4, rectangular, volume=v) for v in (1.0, 0.5, 30.0)] + [math.inf]
        assert all(math.isclose(a, b) for a, b in zip(got, want, strict=True))


def test_more_columns_than_a_mask_has(spark):
    """A cluster in three of 70 columns, in all others of which points lie too far apart, is found as it is in the three alone."""
    own = (2, 66, 69)
    at = lambda p, i: 0.5 + 0.0004 * ((p * (own.index(i) + 2)) % 15) if i in own and p < 15 else ((p * 37 + i * 11) % 50) / 49
    wide = [tuple(at(p, i) for i in range(70)) for p in range(50)]
    rows = [tuple(row[i] for i in own) for row in wide]
    options = {"eps": 0.012, "factor": 0.0, "num_obj": 2, "min_size": 4, "cells": 4, "scaled": True, "rectangular": True}
    want = {(tuple(own[i] for i in r["dims"]), r["p"], r["label"], r["size"]) for r in subspace_clusters(table(spark, rows), 3, **options).collect()}
    got = {(tuple(r["dims"]), r["p"], r["label"], r["size"]) for r in subspace_clusters(table(spark, wide), 70, **options).collect()}
    assert got == want and own in {s for s, *_ in got}


def test_raw_coordinates(spark):
    """Raw columns of range 1 give what scaled ones give, wherever they begin; other ranges, volumes."""
    rows = blobs(4, 60, 2)
    moved = [(x + 5, y - 3) for x, y in rows]
    options = {"cells": 4, "rectangular": False}
    want = subspace_clusters(table(spark, rows), 2, 0.08, 0.5, 3, 8, scaled=True, **options)
    got = subspace_clusters(table(spark, moved), 2, 0.08, 0.5, 3, 8, raw=True, **options)
    key = lambda df: sorted((r["dims"], r["p"], r["label"], r["size"]) for r in df.collect())
    assert key(got) == key(want) and key(want)
    run = Clustering(table(spark, [(2 * x, 3 * y) for x, y in rows]), 2, 0.08, 0.5, 3, 8, raw=True, **options)
    run.forward()
    volumes_ = {r["mask"]: r["volume"] for level in run.levels for r in level.select("mask", "volume").distinct().collect()}
    assert all(math.isclose(v, {1: 2.0, 2: 3.0, 3: 6.0}[m]) for m, v in volumes_.items()) and volumes_


def test_shared_folder_is_required(monkeypatch):
    class Away:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Away(), {}

    with pytest.raises(ValueError):
        cutting.shared_dir(Session())
