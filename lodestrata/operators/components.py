"""Connected components of many graphs at once.

Each task contracts its edges to a forest, which has fewer edges than vertices, however dense the graph. A forest of up to
FEW edges is finished in one task; of a larger one, labels pass to neighbours and then to the label's own label (hook and
jump), so that chains halve, in about as many rounds as the logarithm of the longest path. The result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cutting import counted, stage
from . import forest

#: Edges (24 bytes each) that one task may hold.
FEW = 2_000_000


def connected_components(vertices: DataFrame, edges: DataFrame, key: str = "mask", few: int = FEW) -> DataFrame:
    """key, p, label: the least p of its component. vertices(key, p), of bigints; edges(key, p, q) in one direction or both."""
    rows = edges.select(F.col(key).cast("long").alias(key), F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q"))
    schema = f"`{key}` bigint, p bigint, q bigint"
    found, seen = counted(rows.mapInArrow(forest.contract, schema), "forest")
    if seen["rows"] <= few:
        top = found.coalesce(1).mapInArrow(forest.contract, schema).select(key, F.col("q").alias("p"), F.col("p").alias("top"))
    else:
        top = _rounds(found, key)
    return vertices.select(key, "p").join(top, [key, "p"], "left").select(key, "p", F.coalesce("top", "p").alias("label"))


def _rounds(edges: DataFrame, key: str) -> DataFrame:
    """key, p, top for each vertex of the edges (p < q)."""
    both = stage(edges.union(edges.select(key, F.col("q").alias("p"), F.col("p").alias("q"))).distinct(), "edges")
    labels = stage(both.groupBy(key, "p").agg(F.min("q").alias("near")).select(key, "p", F.least("p", "near").alias("label")), "labels")
    while True:
        from_q = labels.select(F.col(key), F.col("p").alias("q"), F.col("label").alias("near"))
        near = both.join(from_q, [key, "q"]).groupBy(key, "p").agg(F.min("near").alias("near"))
        hooked = labels.join(near, [key, "p"]).select(key, "p", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col(key), F.col("p").alias("label"), F.col("label").alias("top"))
        jumped = stage(hooked.join(up, [key, "label"], "left").select(key, "p", "was", F.least("label", "top").alias("label")), "labels")
        labels = jumped.select(key, "p", "label")
        if jumped.filter("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "top")
