"""Vector code compression: product codes of integer vectors, trained by rounds of nearest entries and integer means.

Vectors become integers and are cut into parts. Each round broadcasts one kd-tree for the codebook of each part (a few hundred
entries, a bound that no table changes), every task finds the nearest entries of its vectors by branch and bound, and adds up
sums and counts of the entries; these partial sums are summed by Spark as integers, so that the order of rows never matters. A
node is visited while its least possible distance is equal to the best one found, so that of entries at one distance the lower
index is found. Only codebooks reach the driver.

Defined cases: rows whose vector is null, or holds null or non-finite components, have no row; nor have those whose length
differs from that of the kept row with the least id. Integers beyond +-LARGEST become +-LARGEST, so that errors fit a bigint.
Null ids come last in the order of ids; rows with equal ids are told apart by their integers; repeated rows count as often as
they come. Fewer kept rows than entries give a smaller codebook. Parts differ by one component where the length is no multiple
of their number, the first ones being longer. An empty table gives an empty table. All other columns pass through, whatever
their names (but for those that begin with two underscores); null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_arrow

#: Integers of components lie within +- this.
LARGEST = 1 << 27
#: Entries of a leaf.
LEAF = 8
#: Vectors that are searched at a time.
ROWS = 4096


@dataclass
class _Node:
    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray  # of a leaf, ascending
    axis: int = 0
    at: int = 0  # entries of `left` are at most this on the axis
    left: _Node | None = None
    right: _Node | None = None


def kd_tree(book: np.ndarray, leaf: int = LEAF) -> _Node:
    """A tree over the rows of an integer matrix, cut in the middle of the widest axis; equal rows may share a large leaf."""

    def grow(at: np.ndarray) -> _Node:
        low, high = book[at].min(0), book[at].max(0)
        node = _Node(low, high, at)
        axis = int(np.argmax(high - low)) if len(low) else 0
        if len(at) <= leaf or not len(low) or low[axis] == high[axis]:
            return node
        x = book[at, axis]
        middle = np.sort(x)[(len(x) - 1) // 2]
        middle = middle if middle < high[axis] else x[x < high[axis]].max()
        node.axis, node.at = axis, int(middle)
        node.left, node.right = grow(at[x <= middle]), grow(at[x > middle])
        return node

    return grow(np.arange(len(book)))


def nearest(tree: _Node, book: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, the nearest row of the book for each point; of equals the lowest index."""
    index, best = np.full(len(points), len(book)), np.full(len(points), np.iinfo(np.int64).max)

    def bound(node: _Node, x: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(node.low - x, x - node.high), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def visit(node: _Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.left is None:
            x, d, i = points[who], best[who], index[who]
            for e in node.entries.tolist():
                gap = x - book[e]
                own = np.einsum("ij,ij->i", gap, gap)
                better = (own < d) | ((own == d) & (e < i))
                d, i = np.where(better, own, d), np.where(better, e, i)
            best[who], index[who] = d, i
            return
        first = points[who, node.axis] <= node.at
        for near, far, mine in ((node.left, node.right, who[first]), (node.right, node.left, who[~first])):
            visit(near, mine)
            visit(far, mine[bound(far, points[mine]) <= best[mine]])

    visit(tree, np.arange(len(points)))
    return index, best


def _matrix(array: pa.Array) -> np.ndarray:
    """A column of integer lists of one length, as rows."""
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(array), len(flat) // max(1, len(array)))


def _edges(width: int, parts: int) -> list[int]:
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(width), parts)]).tolist()]


def _integers(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """df with __v, the integers of rows whose vector is whole and finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST))))
    return df.filter(v.isNotNull()).filter(fine).withColumn("__v", F.transform(v, whole))


def _first(rows: DataFrame, ident: str, entries: int) -> np.ndarray:
    found = rows.select(F.col(f"`{ident}`").alias("__id"), "__v").orderBy(F.col("__id").asc_nulls_last(), "__v").limit(entries).collect()
    width = len(found[0]["__v"]) if found else 0
    kept = [r["__v"] for r in found if len(r["__v"]) == width]
    return np.array(kept, np.int64).reshape(len(kept), width)


def _search(trees: list, books: list[np.ndarray], edges: list[int], v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its slice of the vectors, indexes and squared distances."""
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        x = np.ascontiguousarray(v[:, lo:hi])
        yield x, *nearest(trees[k], books[k], x)


def _sums(rows: DataFrame, books: list[np.ndarray], edges: list[int]) -> list[np.ndarray]:
    """Codebooks of the next round: the floor of the mean of each entry's parts; unused entries stay."""
    shared = rows.sparkSession.sparkContext.broadcast([(kd_tree(b), b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, books = zip(*shared.value, strict=True)
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                for k, (x, index, _) in enumerate(_search(trees, books, edges, _matrix(batch.column("__v").slice(lo, ROWS)))):
                    np.add.at(total[k], index, np.concatenate([x, np.ones((len(x), 1), np.int64)], 1))
        used = [(k, int(e), t[e].tolist()) for k, t in enumerate(total) for e in np.flatnonzero(t[:, -1])]
        yield pa.RecordBatch.from_pylist([{"part": k, "entry": e, "sums": s} for k, e, s in used], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64()))]))

    partial = map_arrow(rows.select("__v"), run, "part int, entry int, sums array<bigint>")
    most = max(b - a for a, b in zip(edges, edges[1:], strict=False)) + 1
    sums = partial.groupBy("part", "entry").agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(most))).alias("sums"))
    out = [b.copy() for b in books]
    for r in sums.collect():  # at most parts * entries rows
        *s, n = (x for x in r["sums"] if x is not None)
        out[r["part"]][r["entry"]] = [x // n for x in s]
    return out


def compress(
    df: DataFrame, vector: str = "embedding", ident: str = "vec_id", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4, keep: list[str] | None = None,
) -> tuple[DataFrame, list[np.ndarray]]:
    """df (or its columns `keep`) with __codes (an index for each part) and __error (squared distances, summed); and the codebooks."""
    if entries > 256:
        raise ValueError("an index has two hex digits")
    keep = df.columns if keep is None else keep
    rows = cut(_integers(df, vector, scale).select(*dict.fromkeys([*keep, ident, vector]), "__v").select(*[f"`{c}`" for c in dict.fromkeys([*keep, ident])], "__v"))
    first = _first(rows, ident, entries)
    width = first.shape[1]
    rows = rows.filter(F.size("__v") == width)
    edges = _edges(width, parts)
    books = [first[:, lo:hi] for lo, hi in zip(edges, edges[1:], strict=False)]
    for _ in range(rounds if len(first) and width else 0):
        books = _sums(rows, books, edges)
    shared = df.sparkSession.sparkContext.broadcast([(kd_tree(b) if len(b) else None, b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, books = zip(*shared.value, strict=True)
        for whole in batches:
            for batch in (whole.slice(lo, ROWS) for lo in range(0, whole.num_rows, ROWS)):
                codes, error = [np.zeros(batch.num_rows, np.int64)] * parts, np.zeros(batch.num_rows, np.int64)
                if width:
                    codes = []
                    for _, index, d in _search(trees, books, edges, _matrix(batch.column("__v"))):
                        codes.append(index)
                        error += d
                flat = pa.array(np.stack(codes, 1).ravel().astype(np.int32))
                made = [pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * parts), flat), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "__codes", "__error"])

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("__codes", T.ArrayType(T.IntegerType())), T.StructField("__error", T.LongType())])
    return map_arrow(rows, run, schema), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def hex_code(codes) -> F.Column:
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Rows with __label_error: their errors summed over equal labels. Sums are made before rows meet them."""
    rows = cut(coded)
    sums = rows.groupBy(F.col(f"`{label}`").alias("__l")).agg(F.sum("__error").alias("__label_error"))
    return rows.join(sums, rows[f"`{label}`"].eqNullSafe(sums["__l"])).drop("__l")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id", "label"])
    return with_label_error(coded).select(
        "vec_id", hex_code(F.col("__codes")).alias("code"), F.col("__error").alias("error"), F.col("__label_error").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256")
    )


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    d2 = "list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS w FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, w[part * (len(w) // {parts}) + 1:(part + 1) * (len(w) // {parts})] AS v FROM kept, range({parts}) r(part))",
        f"b0 AS MATERIALIZED (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1) AS entry, v AS e FROM p QUALIFY entry < {entries})",
    ]
    for k in range(rounds + 1):
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, part, v, min(row(d, entry)) AS best FROM (SELECT vec_id, label, p.part, v, entry, {d2} AS d FROM p JOIN b{k} USING (part)) GROUP BY ALL)")
        if k < rounds:
            out.append(f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.e, b.e) AS e FROM b{k} b LEFT JOIN (
  SELECT part, entry, list(floor(s / c)::BIGINT ORDER BY i) AS e FROM (
    SELECT part, best[2] AS entry, i, sum(v[i])::DOUBLE AS s, count(*) AS c FROM a{k}, range(1, 1000) r(i) WHERE i <= len(v) GROUP BY ALL) GROUP BY ALL) n USING (part, entry))""")
    return "WITH " + ",\n".join(out) + f""",
done AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM done"""


OP11_SQL = _sql()
