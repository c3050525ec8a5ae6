"""Tables in the folder that driver and executors share: plan cuts that survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, with its file system; a new temporary folder only where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    at = sc._jvm.org.apache.hadoop.fs.Path(found)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString()


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_forget)
    _staged.append((spark, path))
    return path


def _forget() -> None:
    for spark, path in _staged:
        try:
            sc = spark.sparkContext
            if sc._jsc is None:
                continue
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session is gone; what is left is in the folder for such files
            return
    _staged.clear()


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes a table to the shared folder and reads it back. Unlike a checkpoint its columns are pruned and its size is known."""
    path = staged_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "table", **conditions) -> tuple[DataFrame, dict[str, int]]:
    """The table, staged, with its number of rows (`rows`) and of those that meet each condition, counted while they are written."""
    seen = Observation()
    found = stage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in conditions.items())), name)
    return found, {k: observed(seen, k) for k in ("rows", *conditions)}


def observed(seen: Observation, name: str) -> int:
    """An observed count; 0 where Spark knew the table to be empty and left the count out."""
    return seen.get[name] if seen._jo.getRow().length() else 0
