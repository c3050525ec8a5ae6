"""Helpers that the text operators share: shared storage, plan cuts and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.cutting import shared_dir, stage, staged_path

__all__ = ["shared_dir", "stage", "staged_path"]

#: Rows of one Arrow batch on its way to Python; texts are long, and a batch must fit beside the heap.
BATCH_ROWS = 1000
#: Bits (as a power of two) of a sieve.
SIEVE = 24


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a narrow table; small ones are then known to be small, so that Spark may broadcast them."""
    return stage(df, "cut")


def counted(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """The table, cut, and the number of its rows that meet the condition, counted while they are written."""
    seen = Observation()
    found = cut(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return found, seen.get["n"]


def sieved(rows: DataFrame, keys: DataFrame, column: str, hit: bool = True) -> DataFrame:
    """The rows whose bigint column falls on a bit that one of the keys (in a column of that name) sets, or the others. The bits
    are a broadcast table of at most 2^(SIEVE - 6) rows, however many keys there are; more keys only let more rows through."""
    at = F.col(column).bitwiseAND(F.lit((1 << SIEVE) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    number = F.call_function("shiftright", at, F.lit(6))
    words = keys.groupBy(number.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    there = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return rows.withColumn("__word", number).join(F.broadcast(words), "__word", "left").filter(there if hit else ~there).select(*rows.columns)


def arrow_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small unless the session already asks for small ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    arrow_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def parts(df: DataFrame, per: int = 1) -> int:
    """Shuffle partitions of the session, at least one."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * per)


def text_or_empty(name: str) -> "F.Column":
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def strings(array: pa.Array) -> list[str]:
    """A string column as Python strings; null is empty, broken UTF-8 is replaced."""
    array = array.fill_null("") if array.null_count else array
    try:
        return array.to_pylist()
    except UnicodeDecodeError:
        return [bytes(x).decode("utf-8", "replace") for x in array.cast(pa.binary()).to_pylist()]


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()) if pa.types.is_string(array.type) else array.cast(pa.large_binary())
    array = array.fill_null("") if pa.types.is_large_string(array.type) else array.fill_null(b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts have about `most` bytes, or one row with a longer text."""
    for batch in batches:
        lengths = np.diff(buffers(batch.column(column))[1])
        ends, start, total = np.cumsum(lengths), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, total + most, "right")))
            yield batch.slice(start, stop - start)
            total, start = int(ends[stop - 1]), stop
