"""Densities, components and pairs in any number of columns, from pairs of boxes instead of pairs of points.

Points with one position are one row with a count. Positions that lie together are packed into blocks of a bounded number
(operators/blocks.py), a row each, with the box of their bounds, their number, sums and sums of squares. Two blocks that are
nowhere more than eps apart give each other these numbers; two that are everywhere more than eps apart give nothing; of the
others, each block meets those of their positions that may be within eps of its bounds, one block after the other, in one task,
where leaves of a few positions are told in the same way. So only positions about eps apart are compared one by one, no pair of points is a row of Spark, and a
task holds two blocks, whatever the number of points.

Bounds are of the points themselves, and differences, squares and sums round monotonically: whole and empty pairs of boxes are
told exactly as comparing each pair of points would.

Positions are arrays v of at most `most` coordinates, inside one column each, 0 where v has no more; so rows of subspaces of
different sizes go together, told apart by the keys (a subspace, or a region of one).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cutting import counted, stage
from . import blocks
from .components import connected_components

#: Positions of a block, at least and at most.
LEAST, ROOM = 1 << 10, 1 << 14
#: Tasks that blocks are dealt to, at most.
TASKS = 1024


def room_for(pairs: int | None) -> int:
    """Positions of a block where there may be so many pairs of points: what blocks are sent to each other grows with the points'
    number squared and falls with the blocks' size, so that this grows with the root of the number, up to ROOM."""
    return ROOM if pairs is None else int(min(ROOM, max(LEAST, 16 * pairs**0.25))) // blocks.LEAF * blocks.LEAF


def _cols(name: str, most: int) -> list[str]:
    return [f"{name}{i}" for i in range(most)]


def _total(most: int, of: Callable[[int], Column]) -> Column:
    return reduce(lambda a, b: a + b, map(of, range(most)))


def _flat(points: DataFrame, keys: tuple[str, ...], most: int, *keep: str | Column) -> DataFrame:
    """keys, coordinates x0, x1, ... and keep."""
    return points.select(*keys, *(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)).alias(f"x{i}") for i in range(most)), *keep)


def _blocks(rows: DataFrame, keys: tuple[str, ...], most: int, eps: float, room: int, labels: bool = False) -> tuple[DataFrame, int]:
    """Blocks of rows(keys, x0, x1, ..., integers) and their number. Rows are dealt by ranges, so that a task has any number of
    keys or a part of one."""
    order = [*keys, *(F.floor(F.col(x) / eps) for x in _cols("x", most)), "x0"]
    kinds = ", ".join(f"`{k}` bigint" for k in keys)
    schema = f"{kinds}, block bigint, m bigint, n bigint, asked bigint, lo array<double>, hi array<double>, s array<double>, ss double, data binary"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found, seen = counted(dealt.mapInArrow(blocks.cut(keys, most, room, eps if labels else None), schema), "blocks")
    return found, seen["rows"]


def _met(found: DataFrame, keys: tuple[str, ...], most: int, eps: float) -> DataFrame:
    """at, other, whole: blocks that may have positions within eps, of one another; columns of the other after an r."""
    names = ["block", "n", "lo", "hi", "s", "ss"]
    left = found.filter("asked > 0").select(*keys, F.col("block").alias("at"), "lo", "hi")
    right = found.select(*keys, *(F.col(c).alias(f"r{c}") for c in names))
    at = lambda c, i: F.get(c, F.lit(i))
    far = lambda i: F.greatest(at("rhi", i) - at("lo", i), at("hi", i) - at("rlo", i))
    near = lambda i: F.greatest(at("rlo", i) - at("hi", i), at("lo", i) - at("rhi", i), F.lit(0.0))
    distance = lambda gap: F.sqrt(_total(most, lambda i: gap(i) * gap(i)))
    return left.join(right, list(keys)).filter(distance(near) <= eps).withColumn("whole", distance(far) <= eps).withColumnRenamed("rblock", "other")


def _dealt(found: DataFrame, own: DataFrame, pairs: DataFrame, count: int, most: int, ints: int, eps: float) -> DataFrame:
    """Rows of `own`, which has the columns of blocks, and behind each the blocks of pairs(at, other), in one task: of another
    block the positions that may be within eps of the own one's box, so that not all is sent to all blocks around."""
    to = pairs.groupBy("other").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("to"))  # the blocks around one
    held = found.select(F.col("block").alias("other"), "data").join(to, "other")
    others = held.mapInArrow(blocks.sent(most, ints, eps), "at bigint, other bigint, data binary")
    rows = own.withColumn("other", F.lit(None).cast("long")).unionByName(others, allowMissingColumns=True)
    return rows.repartition(max(1, min(TASKS, count)), "at").sortWithinPartitions("at", F.col("other").asc_nulls_first())


def density(left: DataFrame, right: DataFrame, most: int, eps: float, rectangular: bool, keys: tuple[str, ...] = ("mask",), room: int = ROOM, least: Column | None = None) -> DataFrame:
    """keys, v, n_near, density: of each position of left(keys, p, v), the points of right(keys, p, v) within eps, and their
    number or Epanechnikov weights, but for one point at the position itself: left's points are among right's. All v have `most`
    coordinates.

    least: an array of densities, by the keys. Then n_near and density are only so much of them as tells which of these are reached,
    and most leaves that eps cuts need not be compared."""
    at = [*keys, *_cols("x", most)]
    if left is right:
        rows = _flat(right, keys, most).groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("asked"))
    else:
        both = _flat(right, keys, most, F.lit(1).alias("n"), F.lit(0).alias("asked")).unionByName(_flat(left, keys, most, F.lit(0).alias("n"), F.lit(1).alias("asked")))
        rows = both.groupBy(*at).agg(F.sum("n").alias("n"), F.max("asked").cast("long").alias("asked"))
    found, count = _blocks(rows, keys, most, eps, room)
    pairs = stage(_met(found, keys, most, eps), "met")
    mid = F.transform(F.arrays_zip("lo", "hi"), lambda x: (x["lo"] + x["hi"]) / 2)
    apart = lambda i: (F.get("rlo", F.lit(i)) + F.get("rhi", F.lit(i))) / 2 - (F.get("lo", F.lit(i)) + F.get("hi", F.lit(i))) / 2
    s = lambda i: F.get("rs", F.lit(i))
    square = F.col("rss") + _total(most, lambda i: 2 * s(i) * apart(i) + F.col("rn") * apart(i) * apart(i))
    moved = F.array(*(F.sum(s(i) + F.col("rn") * apart(i)) for i in range(most)))
    whole = pairs.filter("whole").groupBy("at").agg(F.sum("rn").alias("wn"), moved.alias("ws"), F.sum(square).alias("wss"))
    own = found.filter("asked > 0").select(*keys, F.col("block").alias("at"), mid.alias("mid"), "data").join(whole, "at", "left")
    own = own.withColumn("least", F.lit(None).cast("array<double>") if least is None else least)
    dealt = _dealt(found, own, pairs.filter("NOT whole"), count, most, 2, eps)
    kinds = ", ".join(f"`{k}` bigint" for k in keys)
    return dealt.mapInArrow(blocks.near_counts(keys, most, eps, rectangular), f"{kinds}, v array<double>, n_near bigint, density double")


def components(core: DataFrame, most: int, eps: float, keys: tuple[str, ...] = ("mask", "region"), key: str = "mask", room: int = ROOM) -> DataFrame:
    """core(keys, p, v) with label: the least p of the points that steps of at most eps join, within the keys. A point has one row
    for each value of `key`, the first of the keys.

    Positions are joined within their block first, then the components of blocks that are near; leaves of one component are not
    compared.
    """
    flat = _flat(core, keys, most, "p")
    rows = flat.groupBy(*keys, *_cols("x", most)).agg(F.min("p").alias("p"))
    found, count = _blocks(rows, keys, most, eps, room, labels=True)
    pairs = _met(found, keys, most, eps).filter("at < other")
    dealt = _dealt(found, found.select(key, F.col("block").alias("at"), "data"), pairs, count, most, 1, eps)
    edges = dealt.mapInArrow(blocks.links(most, eps, key), f"`{key}` bigint, p bigint, q bigint")
    kinds = ", ".join(f"`{k}` bigint" for k in keys)
    held = found.select(*keys, "data").mapInArrow(blocks.unpacked(keys, most), f"{kinds}, v array<double>, top bigint")
    tops = connected_components(held.select(key, F.col("top").alias("p")).distinct(), edges, key)
    placed = held.join(tops.withColumnRenamed("p", "top"), [key, "top"])
    at = _cols("x", most)
    labels = placed.select(*keys, *(F.get("v", F.lit(i)).alias(x) for i, x in enumerate(at)), "label")
    return flat.join(labels, [*keys, *at]).select(*keys, "p", "label")


def pairs(points: DataFrame, most: int, eps: float, with_d2: bool = True, room: int = LEAST) -> DataFrame:
    """p, q (and d2) of different points of points(p, v), a row each, that are within eps. Blocks and leaves that are further apart
    in some column are never compared, so that pairs of more columns are taken from those of fewer without being rows."""
    rows = _flat(points, (), most, "p").withColumn("key", F.lit(0).cast("long")).select("key", *_cols("x", most), "p")
    found, count = _blocks(rows, ("key",), most, eps, room)
    # each block has all its pairs from one task
    dealt = _dealt(found, found.select(F.col("block").alias("at"), "data"), _met(found, ("key",), most, eps), count, most, 1, eps)
    return dealt.mapInArrow(blocks.pairs(most, eps, with_d2), "p bigint, q bigint" + ", d2 double" * with_d2)
