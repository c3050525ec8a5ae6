"""Near-duplicate documents: SetSketch bands, joint likelihood, exact verification, connected components.

Texts with equal word sequences are one class, collapsed by a map-side combined grouping, so that copies cost a row for
each task. Classes meet in buckets of equal bands. No bucket's pairs are enumerated: every member is compared with the
bucket's first, by likelihood from the registers and then on full shingle sets, and components are formed. Buckets that
still hold more than one component are open. Large open buckets get more pivots from their main component; then, exactly,
all members outside it meet all members of the bucket in a grid of cells of at most CELL by CELL, whose tasks compare
registers, confirm likely pairs of different components, and tell fewer links than a cell has members. So each pair of different components
that shares a band is either compared or already in one component; nothing is capped.

A pair at the threshold shares no band with a probability of (1 - t^ROWS)^BANDS: under 1e-6 at 0.85, 5e-5 at 0.8. One
that shares a band is dropped by its estimate with a probability under 1e-8 at 0.85, 4e-7 at 0.8 (sets of equal size,
registers taken as independent).

Defined cases: a text without words, empty or null has an empty set and is linked with nothing; one with fewer words than
a shingle has the whole sequence as its only shingle; rows with one doc_id are one document with the links of all its
texts; a null doc_id is linked with nothing and has a null component; other columns are not read; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import buffers, counted, cut, map_arrow, parts, slabs, stage
from .tokens import LOWER, SPACED, doc_shingles, hashes, words

#: Most members of a cell; most ids that are broadcast (8 MB) instead of joined by a shuffle; pivot rounds; how far under
#: the threshold an estimate may be (about six standard errors) for a pair to be verified; tasks a core, and at least, of tables
#: of ids.
CELL, BROADCAST_IDS, ROUNDS, SLACK, WAVES, TASKS = 256, 250_000, 1, 0.20, 4, 32


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    starts, ends, first = words(data, offsets, SPACED)
    h, at = doc_shingles(hashes(data, starts, ends), first, size)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def sketches(df: DataFrame, text: str, doc: str, size: int) -> DataFrame:
    """__doc, __k1, __k2 (of the word sequence), __n (distinct shingles), __sketch, __bands, __z (the compressed words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in slabs(batches, "__text"):
            data, offsets = buffers(batch.column("__text"))
            starts, ends, first = words(data, offsets, SPACED)
            h, at = doc_shingles(hashes(data, starts, ends), first, size)
            sets = [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = np.array([len(x) for x in sets], np.int64)
            k = sketch.registers(np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(n))))
            low = LOWER[data].tobytes()
            keys, z = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                joined = b" ".join(low[a:b].split())
                d = xxhash.xxh3_128_intdigest(joined)
                keys.append(((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)))
                z.append(zip_.compress(joined))
            width = 2 * sketch.M
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(k), [None, pa.py_buffer(k.tobytes())]).cast(pa.binary())
            b = sketch.bands(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__doc"), pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), pa.array(n), blob,
                 pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1) * sketch.BANDS, pa.int32()), pa.array(b.ravel())), pa.array(z, pa.binary())],
                ["__doc", "__k1", "__k2", "__n", "__sketch", "__bands", "__z"],
            )

    rows = df.select(F.col(doc).cast("long").alias("__doc"), F.col(text).cast("string").alias("__text"))
    return map_arrow(rows, run, "__doc bigint, __k1 bigint, __k2 bigint, __n bigint, __sketch binary, __bands array<bigint>, __z binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(buffers(column)[0].tobytes(), np.int16).reshape(-1, sketch.M)


def _confirmed(size: int, num: int, den: int):
    """Pairs whose registers make the threshold likely and whose full sets reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        known: dict[bytes, np.ndarray] = {}

        def of(z: bytes) -> np.ndarray:
            key = xxhash.xxh3_128_digest(z)
            if key not in known:
                if len(known) >= 256:
                    known.clear()
                data = np.frombuffer(unzip.decompress(z), np.uint8)
                known[key] = _sets(data, np.array([0, len(data)]), size)[0]
            return known[key]

        for batch in batches:
            na, nb = batch.column("__na").to_numpy(), batch.column("__nb").to_numpy()
            good = sketch.likely(_registers(batch.column("__sa")), _registers(batch.column("__sb")), na, nb, num / den - SLACK)
            batch = batch.filter(pa.array(good, pa.bool_()))
            linked = []
            for za, zb in zip(batch.column("__za").to_pylist(), batch.column("__zb").to_pylist(), strict=True):
                a, b = of(za), of(zb)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(both > 0 and den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(linked, pa.bool_())) for c in ("__a", "__b")], ["__a", "__b"])

    return run


def _narrow(ids: DataFrame) -> DataFrame:
    """Rows of a few ids each, behind a shuffle, in a few tasks a core: a file a partition costs more than such rows."""
    return ids.coalesce(max(TASKS, WAVES * ids.sparkSession.sparkContext.defaultParallelism))


def _only(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of table whose key is in ids (__id, distinct, cut); few ids are broadcast, more are joined by a shuffle."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return table.join(ids, table[key] == ids["__id"], "left_semi")


class _Verifier:
    def __init__(self, reps: DataFrame, size: int, num: int, den: int) -> None:
        self.reps, self.size, self.num, self.den = reps, size, num, den

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs (__a < __b, cut)."""
        ids = cut(_narrow(pairs.select(F.explode(F.array("__a", "__b")).alias("__id")).distinct()))
        few = stage(_only(self.reps.select("__doc", "__n", "__sketch", "__z"), "__doc", ids), "texts")
        left, right = (few.select(F.col("__doc").alias(f"__{x}"), F.col("__n").alias(f"__n{x}"), F.col("__sketch").alias(f"__s{x}"), F.col("__z").alias(f"__z{x}")) for x in "ab")
        fits = self.den * F.least("__na", "__nb") >= self.num * F.greatest("__na", "__nb")
        both = pairs.join(left, "__a").join(right, "__b").filter(fits)
        return cut(_narrow(map_arrow(both, _confirmed(self.size, self.num, self.den), "__a bigint, __b bigint").distinct()))


def components(links: DataFrame) -> DataFrame:
    """__id and __comp, the least id of its component, for each id of the links (__a, __b).

    Labels go to neighbours and then to the label's own label, until nothing changes: about log(n) rounds.
    """
    edges = cut(_narrow(links.select("__a", "__b").union(links.select(F.col("__b"), F.col("__a"))).distinct()))
    labels = cut(_narrow(edges.groupBy(F.col("__a").alias("__id")).agg(F.least(F.min("__b"), F.first("__a")).alias("__comp"))))
    moved = 1
    while moved:
        near = edges.join(labels, edges["__b"] == labels["__id"]).groupBy("__a").agg(F.min("__comp").alias("__near"))
        own = labels.withColumnsRenamed({"__comp": "__was"})
        hooked = own.join(near, own["__id"] == near["__a"]).select("__id", "__was", F.least("__was", "__near").alias("__hook"))
        up = labels.select(F.col("__id").alias("__hook"), F.col("__comp").alias("__top"))
        labels, moved = counted(_narrow(hooked.join(up, "__hook").select("__id", "__was", F.least("__hook", "__top").alias("__comp"))), "__comp <> __was")
        labels = labels.select("__id", "__comp")
    return labels


def _cells(size: int, num: int, den: int):
    """Links between different components in each cell; rows come sorted by cell, side 0 first.

    Pairs that the registers make likely are confirmed on full sets here, unless links found before in the cell join their
    components already: a cell tells fewer links than it has members.
    """

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        unzip = zstandard.ZstdDecompressor()
        side, doc, comp, n = (np.array([r[i] for r in rows], np.int64) for i in range(1, 5))
        k = np.frombuffer(b"".join(r[5] for r in rows), np.int16).reshape(-1, sketch.M)
        top = np.unique(comp, return_inverse=True)[1]
        every, near = np.flatnonzero(side == 1), []
        for i in np.flatnonzero(side == 0).tolist():
            ok = every[(top[every] != top[i]) & (den * np.minimum(n[every], n[i]) >= num * np.maximum(n[every], n[i]))]
            ok = ok[sketch.likely(k[i], k[ok], n[i], n[ok], num / den - SLACK)]
            if len(ok):
                near.append((i, ok))
        if not near:
            return []

        def of(i: int) -> np.ndarray:
            data = np.frombuffer(unzip.decompress(rows[i][6]), np.uint8)
            return _sets(data, np.array([0, len(data)]), size)[0]

        # shingles of side 0 by number: those of one set are marked, and the marks of another's counted
        own = {i: of(i) for i, _ in near}
        all_ = np.unique(np.concatenate(list(own.values())))
        numbers = {i: np.searchsorted(all_, x).astype(np.int32) for i, x in own.items()}
        own.clear()
        for j in np.unique(np.concatenate([ok for _, ok in near])).tolist():
            x = of(j)
            at = np.minimum(np.searchsorted(all_, x), len(all_) - 1)
            numbers[j] = at[all_[at] == x].astype(np.int32)
        marked = np.zeros(len(all_), bool)
        out: list[tuple[int, int]] = []
        for i, ok in near:
            ok = ok[top[ok] != top[i]]
            marked[numbers[i]] = True
            both = np.array([np.count_nonzero(marked[numbers[j]]) for j in ok.tolist()], np.int64)
            marked[numbers[i]] = False
            for j in ok[(both > 0) & (den * both >= num * (n[i] + n[ok] - both))].tolist():
                if top[i] != top[j]:
                    out.append((int(min(doc[i], doc[j])), int(max(doc[i], doc[j]))))
                    top[top == top[j]] = top[i]
        return out

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["__a", "__b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if held and held[-1][0] != row[0]:
                    found += links(held)
                    held = []
                held.append(row)
            yield batch_of(found)
        if held:
            yield batch_of(links(held))

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("__x <> __y").select(F.least("__x", "__y").alias("__a"), F.greatest("__x", "__y").alias("__b")).distinct()


def near_duplicates(df: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; documents are linked if den * intersection >= num * union."""
    every = stage(sketches(df, text, doc, shingle), "sketches")
    full = every.filter("__n > 0 AND __doc IS NOT NULL")
    classes = cut(_narrow(full.groupBy("__k1", "__k2").agg(F.min("__doc").alias("__node"))))
    reps = full.join(classes.select(F.col("__k1").alias("__c1"), F.col("__k2").alias("__c2"), "__node"), (F.col("__doc") == F.col("__node")) & (F.col("__k1") == F.col("__c1")) & (F.col("__k2") == F.col("__c2")))
    rows = reps.select("__node", F.explode("__bands").alias("__band"))
    buckets = cut(rows.groupBy("__band").agg(F.min("__node").alias("__pivot"), F.count(F.lit(1)).alias("__size")).filter("__size > 1"))
    members = cut(rows.join(buckets, "__band").select("__band", "__node", "__pivot", "__size"))
    verify = _Verifier(full, shingle, num, den)
    links = verify(cut(_narrow(_ordered(members.select(F.col("__node").alias("__x"), F.col("__pivot").alias("__y"))))))
    again = full.groupBy("__doc").count().filter("count > 1").select(F.col("__doc").alias("__id"))
    texts = _only(full.select("__doc", "__k1", "__k2"), "__doc", cut(_narrow(again))).join(classes, ["__k1", "__k2"])
    firsts = texts.groupBy("__doc").agg(F.collect_set("__node").alias("__nodes")).select(F.array_min("__nodes").alias("__x"), F.explode("__nodes").alias("__y"))
    links = cut(_narrow(links.union(_ordered(firsts)).distinct()))  # the classes of one doc_id are one document
    comps = components(links)
    members = members.filter("__size > 2")
    for round_ in range(ROUNDS + 1):
        named = members.join(comps, members["__node"] == comps["__id"], "left").select("__band", "__node", "__pivot", "__size", F.coalesce("__comp", "__node").alias("__comp"))
        state = named.groupBy("__band").agg(
            F.min("__comp").alias("__low"), F.max("__comp").alias("__high"), F.min_by("__comp", F.xxhash64("__comp", F.col("__node"), F.lit(round_))).alias("__main"),
        ).filter("__low <> __high").select("__band", "__main")
        still = cut(named.join(cut(_narrow(state)), "__band"))
        if round_ == ROUNDS or not still.filter(f"__size > {CELL}").limit(1).count():
            break
        large = still.filter(f"__size > {CELL}")
        inner = large.filter("__comp = __main").groupBy("__band").agg(*(F.min_by("__node", F.xxhash64("__node", F.lit(12 * round_ + i + 1))).alias(f"__p{i}") for i in range(12)))
        pivots = cut(_narrow(inner.select("__band", F.explode(F.array_distinct(F.array(*(f"__p{i}" for i in range(12))))).alias("__new"))))
        more = verify(cut(_narrow(_ordered(large.filter("__comp <> __main").join(pivots, "__band").select(F.col("__node").alias("__x"), F.col("__new").alias("__y"))))))
        links = links.union(more)
        comps = components(links)
    outside = F.col("__comp") != F.col("__main")
    counts = cut(_narrow(still.groupBy("__band").agg(F.count_if(outside).alias("__out"))))
    grid = still.join(counts, "__band").withColumns({"__r": F.ceil(F.col("__out") / CELL).cast("int"), "__i": F.ceil(F.col("__size") / CELL).cast("int")})
    spot = lambda n: F.pmod(F.xxhash64("__node"), F.col(n)).cast("int")
    one = grid.filter(outside).select("*", F.lit(0).alias("__side"), spot("__r").alias("__row"), F.explode(F.sequence(F.lit(0), F.col("__i") - 1)).alias("__col"))
    two = grid.select("*", F.lit(1).alias("__side"), F.explode(F.sequence(F.lit(0), F.col("__r") - 1)).alias("__row"), spot("__i").alias("__col"))
    cells = cut(one.unionByName(two.select(*one.columns)).select(F.xxhash64("__band", "__row", "__col").alias("__cell"), "__side", "__node", "__comp"))
    few = _only(full.select("__doc", "__n", "__sketch", "__z"), "__doc", cut(_narrow(cells.select(F.col("__node").alias("__id")).distinct()))).dropDuplicates(["__doc", "__sketch", "__n"])
    dealt = (
        cells.join(few, cells["__node"] == few["__doc"]).select("__cell", "__side", "__node", "__comp", "__n", "__sketch", "__z")
        .repartition(parts(df), "__cell").sortWithinPartitions("__cell", "__side")
    )
    rest = cut(_narrow(map_arrow(dealt, _cells(shingle, num, den), "__a bigint, __b bigint").distinct()))
    if rest.limit(1).count():
        comps = components(links.union(rest))
    nodes = every.select("__doc", "__k1", "__k2", "__n").join(classes, ["__k1", "__k2"], "left")
    linked = (F.col("__n") > 0) & F.col("__doc").isNotNull()
    found = nodes.join(comps, nodes["__node"] == comps["__id"], "left").select("__doc", "__n", F.when(linked, F.coalesce("__comp", "__node")).otherwise(F.col("__doc")).alias("__comp"))
    return found.select(F.col("__doc").alias("doc_id"), F.col("__n").alias("n_shingles"), F.col("__comp").alias("component_id"), F.col("__doc").eqNullSafe(F.col("__comp")).alias("kept"))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, num=85, den=100)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id AND r.c < e.b
), comp AS (
  SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""
