"""Grid cells, border flags and runs of connected cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_of(x: Column, c: int, eps: float, low: float = 0.0, wide: float = 1.0) -> tuple[Column, Column]:
    """Cell, from 0 to c - 1, of a coordinate in a column from `low` that is `wide`, the last one closed; and whether it lies
    within eps of the cell's upper edge. All of a constant column is in cell 0."""
    width = wide / c
    if not width:
        return F.when(x.isNotNull(), F.lit(0)), x.isNotNull() & F.lit(eps >= 0)
    off = x if not low else x - low
    cell = F.least(F.floor(off / width), F.lit(c - 1)).cast("int")
    return cell, off >= (cell + 1) * width - eps


def cells(coords: DataFrame, c: int, eps: float) -> DataFrame:
    """p, dim, x, cell, is_border of scaled coords."""
    cell, border = cell_of(F.col("x"), c, eps)
    return coords.withColumn("cell", cell).withColumn("is_border", border)


def cell_flags(table: DataFrame, keys: list[str]) -> DataFrame:
    """Points and border flag of each cell that has points."""
    return table.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n_points"), F.max("is_border").alias("flag"))


def runs(flags: DataFrame, keys: list[str]) -> DataFrame:
    """flags with run: the first cell of the chain of adjacent cells that their flags connect. A window has at most as many
    rows as the grid has cells in a column."""
    w = Window.partitionBy(*keys).orderBy("cell")
    linked = F.coalesce((F.lag("cell").over(w) == F.col("cell") - 1) & F.lag("flag").over(w), F.lit(False))
    begun = flags.withColumn("__begin", F.when(~linked, F.col("cell")))
    return begun.withColumn("run", F.max("__begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__begin")


def large_runs(named: DataFrame, keys: list[str], min_size: int) -> DataFrame:
    """The cells of runs of at least min_size points."""
    total = F.sum("n_points").over(Window.partitionBy(*keys, "run"))
    return named.withColumn("__n", total).filter(F.col("__n") >= min_size).drop("__n")


def prefix_sum(df: DataFrame, order: str, value: str, bucket: int = 1 << 16) -> DataFrame:
    """df with prefix_sum of value by an integer column: a window within each range of the key, running sums over the ranges of
    each block of ranges, and over the blocks, so that no task has more than a range or block; there is a block for each
    bucket * bucket keys. Rows with one key are all in each other's sum."""
    rows = df.withColumn("__range", F.floor(F.col(order) / bucket))
    sums = rows.groupBy("__range").agg(F.sum(value).alias("__sum")).withColumn("__block", F.floor(F.col("__range") / bucket))
    before = lambda w: F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = sums.withColumn("__in", before(Window.partitionBy("__block").orderBy("__range")))
    blocks = sums.groupBy("__block").agg(F.sum("__sum").alias("__sum")).withColumn("__out", before(Window.orderBy("__block"))).drop("__sum")
    base = inner.join(blocks, "__block").select("__range", (F.col("__in") + F.col("__out")).alias("__base"))
    own = Window.partitionBy("__range").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return rows.join(base, "__range").withColumn("prefix_sum", F.col("__base") + F.sum(value).over(own)).drop("__range", "__base")
