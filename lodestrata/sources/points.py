"""Point tables: coords(p, dim, x), from vectors, columns or files.

Rows are points with a bigint id p; columns are numbered from 0. Null coordinates are left out, and so is a point with none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_vectors(df: DataFrame, p: str, vector: str, dims: int | None = None, kind: str = "double") -> DataFrame:
    """coords of an array column, of its first `dims` entries if given; only those are taken from the array."""
    v = F.col(vector) if dims is None else F.slice(vector, 1, dims)
    return df.select(F.col(p).cast("long").alias("p"), F.posexplode(v).alias("dim", "x")).select("p", "dim", F.col("x").cast(kind).alias("x")).filter("x IS NOT NULL")


def from_columns(df: DataFrame, p, columns: list[str], kind: str = "double") -> DataFrame:
    """coords of numeric columns; p: an expression for the point id."""
    cells = F.array(*(F.struct(F.lit(i).alias("dim"), F.col(c).cast(kind).alias("x")) for i, c in enumerate(columns)))
    return df.select(p.cast("long").alias("p"), F.inline(cells)).filter("x IS NOT NULL")


def read_numbers(spark: SparkSession, path: str, columns: int, drop: tuple[int, ...] = (), sep: str = ",", header: bool = False, kind: str = "float") -> DataFrame:
    """coords of a delimited file of numbers; the dropped columns do not count. Points are numbered in file order.

    Normalise before or after: bounds are by column.
    """
    schema = ", ".join(f"c{i} {kind}" for i in range(columns))
    table = spark.read.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("header", header).csv(path, schema=schema, sep=sep)
    keep = [f"c{i}" for i in range(columns) if i not in drop]
    return from_columns(numbered(table), F.col("p"), keep, kind)


def numbered(df: DataFrame) -> DataFrame:
    """A table of files with p = 0, 1, ... in the order of its files' paths, blocks and lines: a running sum over the counts of
    blocks (a row a block), and the place within the block. Which task reads a block, and when, does not matter."""
    place = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()}
    rows = df.withColumns(place)
    blocks = rows.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("__start", before).select("__file", "__block", "__first", "__start")
    return rows.join(starts, ["__file", "__block"]).withColumn("p", F.col("__start") + F.col("__at") - F.col("__first")).drop("__file", "__block", "__at", "__first", "__start")


def read_glass(spark: SparkSession, path: str) -> DataFrame:
    """Glass measurements: an id, nine numbers and a class in each line."""
    return read_numbers(spark, path, 11, drop=(0, 10))


def read_pendigits(spark: SparkSession, path: str) -> DataFrame:
    """Pen strokes: sixteen padded integers and a class in each line."""
    return read_numbers(spark, path, 17, drop=(16,))


def read_vowel(spark: SparkSession, path: str, columns: int = 10) -> DataFrame:
    """Any file of numbers of which all columns count; also for iris measurements."""
    return read_numbers(spark, path, columns)


def read_generated(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Space-separated numbers under one header line."""
    return read_numbers(spark, path, columns, sep=" ", header=True)
