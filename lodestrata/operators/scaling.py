"""Column bounds and min-max scaling of coords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_bounds(coords: DataFrame) -> DataFrame:
    """mn and mx of each dim: one partial aggregate a task."""
    return coords.groupBy("dim").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))


def normalize(coords: DataFrame) -> DataFrame:
    """x in [0, 1]; 0 in constant columns. The bounds have a row for each column of the table."""
    b = column_bounds(coords)
    x = F.when(F.col("mx") != F.col("mn"), F.try_divide(F.col("x") - F.col("mn"), F.col("mx") - F.col("mn"))).otherwise(0)
    return coords.join(F.broadcast(b), "dim").withColumn("x", x.cast(coords.schema["x"].dataType)).select(*coords.columns)
