"""Subspace clustering level by level.

Forward, from one column to more: each region (a subspace and a run of cells in each of its columns) is restricted by every
later column, connected cells merge into runs, and points that are not weakly dense go; regions under min_size end.
Backward, from many columns to one: regions that clusters of supersets do not make redundant are clustered, small and
redundant clusters go, the rest joins the result. A level is one set of joins for all its regions. A point is in at most
one region of a subspace, so that (mask, p) is the key of all tables. Densities are kept with the members, so that
clustering meets dense points only; of a density no more is taken than tells that it is weak, dense or neither.

A subspace is an ascending array of columns, of any number of them; its mask (beyond 63 columns a hash) is its key. Which
subspaces lie within which is found once, by an inverted index (functions/subspaces.py), so that redundancy is equi-joins.

In large tables of scaled coordinates most densities are told by counts of cells (operators/cells.py), and pairs are met only where those do not tell.

Points of a region with one path of cells (and border flags) are told apart by nothing that restricts them: flags, runs and
markers come from a table of paths with counts, one row a path, and members only follow their path to its children.

One column needs no pairs: densities come from sorted buckets, components from gaps. In more columns densities and components
come from pairs of boxes (operators/boxes.py); pairs of points are met where eps cuts boxes of few points, where all pairs that
there can be are few, and by the strategy that refines pairs.

Strategies: `recompute` takes each level's densities anew; `incremental` keeps the pairs of two columns and refines them level
by level, where all pairs that a level can have are few (else they are not kept, and the level is taken anew); `batched` is
recompute with dim_step columns at a time in each expansion. All give the same result.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.subspaces import containments, mask_of, result_order
from ..functions.volumes import PI, threshold_of
from ..operators import cells as counted_cells
from ..operators import density, grid, line, neighbors, redundancy
from ..operators.scaling import column_bounds, normalize
from .cutting import counted, stage

STRATEGIES = ("recompute", "incremental", "batched")
#: Members of all levels up to which all levels' components are found at once, before redundancy tells which regions count.
AT_ONCE = 1_000_000


def bit(dim):
    return F.call_function("shiftleft", F.lit(1).cast("long"), dim)


class Clustering:
    """One run over coords(p, dim, x) with d columns numbered from 0. Of rows with one p and dim the largest x counts; a point
    without x in a column is in no region of that column.

    Coordinates are scaled to [0, 1], unless scaled (they are, which is checked) or raw: then cells divide each column's own
    range, and expected densities are those of the region's volume, the product of the ranges of its columns, carried by each
    region; weighted densities are weak by the volume of all columns. volume: of the scaled space.

    folder: where each finished level is kept, so that a run with the same table and settings that was broken off goes on behind
    the last of them; a folder of other settings is an error. Not with the strategy that refines pairs.
    """

    def __init__(
        self, coords: DataFrame, d: int, eps: float, factor: float, num_obj: float, min_size: int, r: float = 1.0, cells: int = 3,
        rectangular: bool = False, strategy: str = "recompute", dim_step: int = 2, ghost_markers: bool = True, scaled: bool = False,
        raw: bool = False, volume: float = 1.0, pi: float = PI, at_once: int = AT_ONCE, few_pairs: int = density.FEW_PAIRS,
        folder: str | None = None,
    ) -> None:
        if strategy not in STRATEGIES:
            raise ValueError(strategy)
        if d < 1:
            raise ValueError("at least one column")
        self.d, self.eps, self.rectangular, self.min_size, self.r = d, eps, rectangular, min_size, r
        self.factor, self.num_obj, self.raw, self.volume, self.pi = factor, num_obj, raw, volume, pi
        self.strategy, self.dim_step, self.ghosts, self.at_once, self.few_pairs = strategy, dim_step, ghost_markers, at_once, few_pairs
        if folder and strategy == "incremental":
            raise ValueError("pairs are not kept from run to run")
        self.folder = folder
        if folder:
            told = repr(sorted((k, v) for k, v in locals().items() if k not in ("self", "coords", "folder")))
            spark = coords.sparkSession
            kept = cached_run(spark, f"{folder}/settings", lambda: spark.createDataFrame([(told,)], "settings string"))
            if kept.first()["settings"] != told:
                raise ValueError(f"{folder} has levels of other settings")
        self.lows, self.ranges = [0.0] * d, [1.0] * d
        if raw:
            for row in column_bounds(coords.filter(F.col("dim") < d)).collect():  # a row a column
                self.lows[row["dim"]], self.ranges[row["dim"]] = float(row["mn"]), float(row["mx"]) - float(row["mn"])
        if eps > min((x for x in self.ranges if x > 0), default=1.0) / cells:
            warnings.warn("eps exceeds a cell: regions may split clusters", stacklevel=2)
        used = coords if scaled or raw else normalize(coords)
        x = lambda i: F.max(F.when(F.col("dim") == i, F.col("x").cast("double")))
        wide = used.groupBy("p").agg(F.array(*(x(i) for i in range(d))).alias("xs"))
        columns = enumerate(zip(self.lows, self.ranges, strict=True))
        path, border = zip(*(grid.cell_of(F.get("xs", F.lit(i)), cells, eps, low, range_) for i, (low, range_) in columns), strict=True)
        out = (F.array_min("xs") < 0) | (F.array_max("xs") > 1)
        self.points, seen = counted(wide.select("p", "xs", F.array(*path).alias("path"), F.array(*border).alias("border")), "points", out=out)
        if scaled and seen["out"]:
            raise ValueError("scaled coordinates lie in [0, 1]")
        self.n = seen["rows"]
        inner = F.arrays_zip("xs", "path", "border")
        each = self.points.select("p", F.posexplode(inner).alias("dim", "c")).filter("c.xs IS NOT NULL")
        self.cells = each.select("p", "dim", F.col("c.xs").alias("x"), F.col("c.path").alias("cell"), F.col("c.border").alias("is_border"))
        self.levels: list[DataFrame] = []
        self.sizes: list[int] = []

    def key_of(self, dims: Column) -> Column:
        """The mask of a subspace; beyond 63 columns, which a mask does not hold, a hash of its columns."""
        return mask_of(dims) if self.d <= 63 else F.xxhash64(dims)

    @property
    def calls(self) -> int:
        """Regions that the run visits, the whole table included."""
        return 1 + sum(x.select("mask", "region").distinct().count() for x in self.levels)

    def least(self, k: int, weak: bool = False, volume_of_row: Column | None = None) -> Column:
        """Least density of rows with a volume in k columns; weak: of weakly dense ones, k being all columns."""
        if not self.raw:
            volume = F.lit(self.volume)
        elif weak and not self.rectangular:
            volume = F.lit(math.prod(self.ranges))
        else:
            volume = F.col("volume") if volume_of_row is None else volume_of_row
        return threshold_of(k, self.eps, self.n, self.factor, self.num_obj, self.rectangular, volume, self.pi)

    def bounds(self, k: int) -> Column | None:
        """Densities in k columns that tell what is weakly dense and what is dense, by the mask; none where a mask is a hash."""
        if self.raw and self.d > 63:
            return None
        has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
        volume = reduce(lambda v, i: v * F.when(has(i), F.lit(self.ranges[i])).otherwise(1.0), range(self.d), F.lit(1.0)) if self.raw else None
        return F.array(self.least(self.d, True, volume), self.least(k, volume_of_row=volume))

    def forward(self) -> None:
        base = self.points.filter(F.exists("xs", lambda x: x.isNotNull()))
        zero = lambda name: F.lit(0).cast("long").alias(name)
        whole = [zero("mask"), F.array().cast("array<int>").alias("dims"), zero("region"), F.lit(-1).alias("last"), F.lit(1.0).alias("volume")]
        members = base.select(*whole, "p", "xs", "path", "border")
        edges, markers = None, None
        if self.ghosts:
            held = members.select("mask", "region", "last", "path", F.posexplode("border").alias("j", "is_border"))
            markers = held.filter("is_border").select("region", "path", "j").distinct()
        for k in range(1, self.d + 1):
            steps = range(0, self.d, self.dim_step) if self.strategy == "batched" else [0]
            width = self.dim_step if self.strategy == "batched" else self.d
            found = [x for s in steps if (x := self._expand(k, members, edges, markers, s, s + width)) is not None]
            if not found:
                return
            members = reduce(DataFrame.unionByName, [f[0] for f in found])
            edges = found[0][1]
            markers = reduce(DataFrame.unionByName, [f[2] for f in found]) if self.ghosts and k < self.d else None
            self.levels.append(members)
            self.sizes.append(sum(f[3] for f in found))

    def _kept(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The table, staged or in the run's folder, and its number of rows."""
        if not self.folder:
            found, seen = counted(df, name)
            return found, seen["rows"]
        found = cached_run(df.sparkSession, f"{self.folder}/{name}", lambda: df)
        return found, found.count()

    def _expand(self, k: int, members: DataFrame, edges: DataFrame | None, markers: DataFrame | None, lo: int, hi: int):
        """Members (with density), pairs and markers of the regions that columns from lo to hi - 1 restrict; number of members."""
        columns = ["mask", "dims", "region", "p", "last", "volume", "xs", "path", "border", "v", "density"]
        names = f"dense-{k}-{lo}", f"markers-{k}-{lo}"
        marking = markers is not None and k < self.d
        v = F.array(*(F.get("xs", F.get("dims", F.lit(i))) for i in range(k)))  # not written: xs and dims are
        spark = members.sparkSession
        if self.folder and all(written(spark, f"{self.folder}/{x}") for x in names[: 1 + marking]):
            alive = spark.read.parquet(f"{self.folder}/{names[0]}")
            rows = alive.count()
            left = spark.read.parquet(f"{self.folder}/{names[1]}") if marking else None
            return (alive.withColumn("v", v).select(*columns), None, left, rows) if rows else None
        paths = members.groupBy("region", "last", "path", "border").agg(F.count(F.lit(1)).alias("n"))
        cells = F.posexplode(F.arrays_zip("path", "border")).alias("dim", "c")
        later = (F.col("dim") > F.col("last")) & (F.col("dim") >= lo) & (F.col("dim") < hi)
        spread = paths.select("region", "last", "path", "border", "n", cells).filter(later & F.col("c.path").isNotNull())
        spread = spread.select("region", "path", "border", "n", "dim", F.col("c.path").alias("cell"), F.col("c.border").alias("is_border"))
        flags = spread.groupBy("region", "dim", "cell").agg(F.sum("n").alias("n_points"), F.max("is_border").alias("flag"))
        if markers is not None:
            marked = markers.select("region", F.col("j").alias("dim"), F.get("path", F.col("j")).alias("cell"))
            marked = marked.filter((F.col("dim") >= lo) & (F.col("dim") < hi)).distinct()
            flags = flags.join(marked.withColumn("marked", F.lit(True)), ["region", "dim", "cell"], "left")
            flags = flags.withColumn("flag", F.col("flag") | F.coalesce("marked", F.lit(False))).drop("marked")
        named = grid.large_runs(grid.runs(flags, ["region", "dim"]), ["region", "dim"], self.min_size).select("region", "dim", "cell", "run")
        ways = spread.join(named, ["region", "dim", "cell"]).groupBy("region", "path", "border")
        # at most d; a row a path, so that Spark knows how few they are and leaves the members where they lie
        ways = stage(ways.agg(F.collect_list(F.struct("dim", "run")).alias("ways")), "ways")
        down = members.drop("density").join(ways, ["region", "path", "border"]).withColumn("way", F.explode("ways"))
        ranges = F.array(*(F.lit(x) for x in self.ranges))
        dims = F.concat("dims", F.array("way.dim"))
        kids = down.select(
            self.key_of(dims).alias("mask"), dims.alias("dims"), F.xxhash64("region", "way.dim", "way.run").alias("region"), "p",
            F.col("way.dim").alias("last"), (F.col("volume") * F.get(ranges, F.col("way.dim"))).alias("volume"), "xs", "path", "border",
            F.col("region").alias("above"), F.col("mask").alias("parent"), F.col("way.run").alias("run"),
        )
        kids, seen = counted(kids, "members")
        if not seen["rows"]:
            return None
        kids, near = kids.withColumn("v", v), None
        pairs = seen["rows"] * self.n
        held = None if self.strategy == "incremental" or pairs <= max(self.few_pairs, counted_cells.MANY) else self._by_cells(kids, k)
        if held is not None:
            pass  # told by cells
        elif k == 1:
            x = kids.withColumns({"dim": F.col("last"), "x": F.get("v", F.lit(0))})
            held = line.with_line_density(x, self.cells, self.eps, self.rectangular, self.n).drop("dim", "x")
        elif self.strategy == "incremental" and pairs <= self.few_pairs:
            if edges is not None:
                new = kids.select("mask", "parent", "p", F.col("last").alias("dim"), F.get("xs", F.col("last")).alias("x"))
                near = neighbors.refine(edges, new, self.cells, self.eps)
            else:
                near = neighbors.pairs(kids, self._around(kids), k, self.eps)
            near = stage(near, "pairs")
            held = kids.join(density.density(near, self.eps, self.rectangular), ["mask", "p"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
        else:
            held = density.with_density(kids, self._around(kids), k, self.eps, self.rectangular, pairs=pairs, few=self.few_pairs, least=self.bounds(k)).drop("n_near")
        alive, rows = self._sizable(stage(held.filter(F.col("density") >= self.least(self.d, True)).drop("v"), "dense"), names[0])
        if not rows:
            return None
        left = self._markers(markers, named, alive, names[1]) if marking else None
        return alive.withColumn("v", v).select(*columns), near, left, rows

    def _by_cells(self, kids: DataFrame, k: int) -> DataFrame | None:
        """kids with density, most of them told by counts of cells (operators/cells.py); None where those have no room, or
        where what is weighed, or scaled by the row's region, has no such counts."""
        cells = counted_cells.Grid(k, self.eps)
        if self.raw or not self.rectangular or not cells.fits:
            return None
        most = F.greatest(self.least(self.d, True), self.least(k))
        spaces = stage(kids.select("mask", "dims").distinct(), "spaces")
        every = stage(counted_cells.counts(self.points, spaces, cells), "cells")
        few, seen = counted(counted_cells.few_cells(every, every, cells, most), "few")
        named = kids.withColumn("cell", cells.number(lambda i: F.get("v", F.lit(i)))).filter("cell IS NOT NULL")
        few = F.broadcast(few) if seen["rows"] <= counted_cells.LEFT else few
        told = named.join(few, ["mask", "cell"], "left_anti").drop("cell").withColumn("density", most.cast("double"))
        left, seen = counted(named.join(few, ["mask", "cell"], "left_semi").drop("cell"), "left")
        if not seen["rows"]:
            return told
        if seen["rows"] <= counted_cells.LEFT:
            near = counted_cells.near_counts(self.points, left, self.eps).withColumn("density", F.col("n") - F.lit(1.0)).drop("n")
            return told.unionByName(left.join(near, ["mask", "p"], "left").withColumn("density", F.coalesce("density", F.lit(0.0))))
        if k == 1:
            x = left.withColumns({"dim": F.col("last"), "x": F.get("v", F.lit(0))})
            return told.unionByName(line.with_line_density(x, self.cells, self.eps, self.rectangular, self.n).drop("dim", "x"))
        held = density.with_density(left, self._around(left), k, self.eps, True, pairs=seen["rows"] * self.n, few=self.few_pairs, least=self.bounds(k))
        return told.unionByName(held.drop("n_near"))

    def _markers(self, markers: DataFrame, named: DataFrame, alive: DataFrame, name: str) -> DataFrame:
        """The markers that lie in a child region and go on to connect its cells: a point that is alive has, up to the marker's
        column, the marker's cells in all columns that do not restrict the region."""
        regions = alive.select("above", F.col("last").alias("dim"), "run", "dims", F.col("region").alias("r")).distinct()
        inside = markers.select(F.col("region").alias("above"), "path", "j", F.posexplode("path").alias("dim", "cell")).filter("j > dim")
        inside = inside.join(named.withColumnRenamed("region", "above"), ["above", "dim", "cell"]).join(regions, ["above", "dim", "run"])
        inside = inside.select(F.col("r").alias("region"), "dims", "path", "j")
        free = lambda c, i: F.when(F.array_contains("dims", i), F.lit(-1)).otherwise(F.coalesce(c, F.lit(-2)))
        key = F.xxhash64(F.transform(F.slice("path", F.lit(1), F.col("j") + 1), free))
        there = alive.select("dims", "region", "path").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(self.d - 1))))
        there = there.select("region", "j", key.alias("key")).distinct()
        left = inside.withColumn("key", key).join(there, ["region", "j", "key"], "left_semi")
        return self._kept(left.select("region", "path", "j").distinct(), name)[0]

    def _sizable(self, members: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Members, which are staged, of regions of at least min_size, and their number; as they lie, if all are."""
        sizes = stage(members.groupBy("region").agg(F.count(F.lit(1)).alias("__n")), "sizes")
        enough = F.col("__n") >= self.min_size
        seen = sizes.agg(F.count_if(~enough).alias("small"), F.sum("__n").alias("rows")).first()
        if not seen["small"] and not self.folder:
            return members, seen["rows"] or 0
        return self._kept(members.join(sizes.filter(enough), "region", "left_semi"), name)

    def _around(self, kids: DataFrame) -> DataFrame:
        """mask, p, v of the points that members of the mask may have within eps: those of the buckets that members probe in the
        last of its columns."""
        bucket = lambda x: F.floor(x / (self.eps * neighbors.WIDER))
        probes = kids.select("mask", "dims", F.col("last").alias("dim"), bucket(F.get("xs", F.col("last"))).alias("b")).distinct()
        probes = probes.select("mask", "dims", "dim", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b")).distinct()
        rows = self.points.select("p", "xs", F.posexplode("xs").alias("dim", "x")).withColumn("b", bucket(F.col("x")))
        v = F.transform("dims", lambda i: F.get("xs", i))
        return rows.join(probes, ["dim", "b"]).select("mask", "p", v.alias("v")).filter(~F.exists("v", lambda x: x.isNull()))

    def _labels(self, members: DataFrame, columns: range) -> DataFrame:
        """mask, region, p, label, size of the clusters of the members' dense points, of subspaces of so many columns."""
        core = lambda k: members.filter((F.size("v") == k) & (F.col("density") >= self.least(k)))
        parts = []
        if many := [k for k in columns if k > 1]:
            found = reduce(DataFrame.unionByName, [core(k) for k in many]).select("mask", "region", "p", "v")
            parts.append(density.components(found, max(many), self.eps, pairs=self.n * sum(self.sizes[k - 1] for k in many), few=self.few_pairs))
        if 1 in columns:
            x = core(1).select("mask", "region", "p", F.get("v", F.lit(0)).alias("x"))
            parts.append(line.line_components(x, self.eps, ["mask", "region"]).select("mask", "region", "p", "label"))
        return redundancy.min_size_filter(stage(reduce(DataFrame.unionByName, parts), "clustered"), self.min_size, ("region",))

    def backward(self) -> DataFrame:
        result, top = None, len(self.levels)
        columns = ["mask", "region", "p", "volume", "v", "density"]
        once = sum(self.sizes) <= self.at_once and top
        self.spaces = spaces = self._spaces()
        labels = None
        if once:
            every = self._labels(reduce(DataFrame.unionByName, [x.select(*columns) for x in self.levels]), range(1, top + 1))
            labels = self._kept(every.join(spaces.select("mask", F.size("dims").alias("columns")), "mask"), "labels")[0]
        pairs = containments(spaces.select("dims"), spaces.select("dims")).filter(F.col("dims") != F.col("sup_dims"))
        keyed = F.size("dims").alias("columns"), self.key_of(F.col("dims")).alias("mask"), self.key_of(F.col("sup_dims")).alias("other_mask")
        every_pair = stage(pairs.select(*keyed), "pairs") if top > 1 else None
        for k in range(top, 0, -1):
            members = self.levels[k - 1].select(*columns)
            # the result's rows meet this level's subspaces only
            pairs = None if every_pair is None else every_pair.filter(F.col("columns") == k).select("mask", "other_mask")
            regions = None if result is None else redundancy.region_redundancy(members, result, self.r, pairs)
            if labels is not None:
                found = labels.filter(F.col("columns") == k)
                found = found if regions is None else found.join(regions, ["region", "mask"], "left_semi")
            else:
                found = stage(self._labels(members if regions is None else members.join(regions, ["region", "mask"], "left_semi"), range(k, k + 1)), "labels")
            found = found.select("mask", "p", "label", "size")
            if result is not None:
                found = redundancy.cluster_redundancy(found, result, self.r, pairs)
            result = redundancy.merge_result(result, stage(found, "result") if 1 < k < top else found)
        return result if result is not None else self.points.sparkSession.createDataFrame([], "mask long, p long, label long, size long")

    def _spaces(self) -> DataFrame:
        """mask and dims of each subspace that has members."""
        if not self.levels:
            return self.points.sparkSession.createDataFrame([], "mask long, dims array<int>")
        return stage(reduce(DataFrame.unionByName, [x.select("mask", "dims") for x in self.levels]).distinct(), "spaces")

    def run(self) -> DataFrame:
        """dims, p, label, size: a row for each point of each cluster."""
        self.forward()
        return self.backward().join(self.spaces, "mask").select("dims", "p", "label", "size")


def subspace_clusters(coords: DataFrame, d: int, eps: float, factor: float, num_obj: float, min_size: int, **options) -> DataFrame:
    return Clustering(coords, d, eps, factor, num_obj, min_size, **options).run()


def to_table(result: DataFrame, points: DataFrame) -> DataFrame:
    """place, dims, p, label: a row for each subspace of the result and each of points(p), label -1 for none. place: the
    subspace's number, from 1, in result order. Only the list of subspaces is gathered."""
    found = stage(result.select("dims", "p", "label"), "result")
    spaces = found.select("dims").distinct().orderBy(result_order(F.col("dims"))).collect()
    every = F.array(*(F.struct(F.lit(k + 1).alias("place"), F.array(*map(F.lit, r["dims"])).alias("dims")) for k, r in enumerate(spaces)))
    if not spaces:
        return found.select(F.lit(0).alias("place"), F.array_join("dims", ",").alias("dims"), "p", "label")
    rows = points.select("p", F.inline(every)).join(found, ["dims", "p"], "left")
    return rows.select("place", F.array_join("dims", ",").alias("dims"), "p", F.coalesce("label", F.lit(-1)).alias("label"))


def to_lists(result: DataFrame, n: int) -> tuple[list[list[int]], list[list[int]]]:
    """Subspaces in result order and, for each, a label for each of n points, -1 for none: for small tables only."""
    rows = result.groupBy("dims").agg(F.collect_list(F.struct("p", "label")).alias("c")).orderBy(result_order(F.col("dims"))).collect()
    spaces, labels = [], []
    for r in rows:
        own = [-1] * n
        for x in r["c"]:
            own[x["p"]] = x["label"]
        spaces.append(list(r["dims"]))
        labels.append(own)
    return spaces, labels


def written(spark, path: str) -> bool:
    """Whether the table at path is there, to its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached_run(spark, path: str, compute) -> DataFrame:
    """The table at path; computed and written first if it is not there."""
    if not written(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
