"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (13 consecutive words; an item with fewer words is one window) must occur whole in a document: a
containment of 1. Shingles of five words are ordered by rarity, measured over all documents; under full containment one
token is a sufficient prefix, so each window is indexed by its rarest shingle alone. Documents probe that index with
their shingles; a match gives the one place where the window can stand, length and positional bounds discard places that
reach outside the document, and the words themselves confirm the rest.

The items are read in blocks of at most `block_words` words. The index of a block is broadcast: its size is bounded by
that number, whatever the table's size. More items mean more blocks, each held by a worker in turn.

Defined cases: a null or empty text has no words, no hits and is not contaminated; items without words occur nowhere;
items of null item_id hit words but are neither counted nor listed; repeated items of one id count once; repeated
documents are judged each; without items nothing is hit; other columns pass through; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, map_arrow, slabs
from .tokens import ALNUM, LOWER, hashes, shingles, words

WINDOW, SHINGLE, SHARE, BLOCK_WORDS = 13, 5, 20, 1_000_000
_BITS = 22


class _Block:
    """Windows of some items: word hashes end to end, and for each window its item, first word, length and shingles."""

    def __init__(self, rows: list[tuple], window: int, shingle: int) -> None:
        data, offsets = buffers(pa.array([r[1] for r in rows], pa.string()))
        starts, ends, first = words(data, offsets, ALNUM)
        self.h = hashes(data, starts, ends)
        low = LOWER[data].tobytes()
        self.words = [low[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        self.ids = [None if r[0] is None else str(r[0]) for r in rows]
        found: list[tuple[int, int, int]] = []
        for i in range(len(rows)):
            n = int(first[i + 1] - first[i])
            size = min(n, window)
            found += [(i, int(first[i]) + k, size) for k in range(n - size + 1 if n else 0)]
        self.windows = np.array(found, np.int64).reshape(-1, 3)
        self.sizes = sorted({min(int(x), shingle) for x in self.windows[:, 2]})
        self.tokens = {n: shingles(self.h, n) for n in self.sizes}
        of = {n: self.windows[np.minimum(self.windows[:, 2], shingle) == n] for n in self.sizes}
        self.of = of
        keys = [self.tokens[n][w[:, 1, None] + np.arange(int(size) - n + 1)].ravel() for n in self.sizes for size in np.unique(of[n][:, 2]) for w in [of[n][of[n][:, 2] == size]]]
        self.keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        self.index: dict[int, tuple] = {}

    def order(self, frequency: np.ndarray) -> None:
        """Indexes each window by its rarest shingle; frequency: documents that hold each of self.keys."""
        for n in self.sizes:
            entries = []
            for item, at, size in self.of[n].tolist():
                k = self.tokens[n][at : at + size - n + 1]
                seen = frequency[np.searchsorted(self.keys, k)]
                best = min(range(len(k)), key=lambda j: (seen[j], k[j]))  # noqa: B023
                entries.append((int(k[best]), item, at, size, best))
            entries.sort()
            key = np.array([e[0] for e in entries], np.uint64)
            unique, begin = np.unique(key, return_index=True)
            self.index[n] = (unique, np.append(begin, len(key)), np.array([e[1:] for e in entries], np.int64).reshape(-1, 4), _sieve(unique))


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _BITS, bool)
    out[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return out


def _look(h: np.ndarray, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in h that hold one of the sorted keys, and which."""
    at = np.flatnonzero(sieve[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    if not len(at) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    same = keys[which] == h[at]
    return at[same], which[same]


def _held(block, last: bool):
    value = block.value
    if not last:
        block.__dict__.pop("_value", None)
    return value


def _frequencies(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        total, sieve = np.zeros(len(b.keys), np.int64), _sieve(b.keys)
        for batch in slabs(batches, "__text"):
            data, offsets = buffers(batch.column("__text"))
            starts, ends, first = words(data, offsets, ALNUM)
            h = hashes(data, starts, ends)
            for n in b.sizes:
                at, which = _look(shingles(h, n), b.keys, sieve)
                doc = np.searchsorted(first, at, "right") - 1
                inside = at + n <= first[doc + 1]
                pairs = np.unique(doc[inside] * len(b.keys) + which[inside])
                total += np.bincount(pairs % len(b.keys), minlength=len(b.keys)) if len(b.keys) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["key", "n"])

    return run


def _matches(blocks: list, carried: list[str], share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "__text"):
            data, offsets = buffers(batch.column("__text"))
            starts, ends, first = words(data, offsets, ALNUM)
            h = hashes(data, starts, ends)
            low = LOWER[data].tobytes()
            hit = np.zeros(len(h) + 1, np.int64)
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for block in blocks:
                b = _held(block, len(blocks) == 1)
                for n, (keys, begin, entries, sieve) in b.index.items():
                    at, which = _look(shingles(h, n), keys, sieve)
                    many = begin[which + 1] - begin[which]
                    at = np.repeat(at, many)
                    entry = entries[np.repeat(begin[which] + many - np.cumsum(many), many) + np.arange(len(at))]
                    item, source, size, shift = entry.T
                    doc = np.searchsorted(first, at, "right") - 1
                    start = at - shift
                    fits = (start >= first[doc]) & (start + size <= first[doc + 1])
                    for i, s, d, k, w in zip(item[fits].tolist(), source[fits].tolist(), doc[fits].tolist(), start[fits].tolist(), size[fits].tolist(), strict=True):
                        if all(low[starts[k + j] : ends[k + j]] == b.words[s + j] for j in range(w)):
                            hit[k] += 1
                            hit[k + w] -= 1
                            if b.ids[i] is not None:
                                items[d].add(b.ids[i])
            inside = np.concatenate(([0], np.cumsum(np.cumsum(hit[:-1]) > 0)))
            n_words, n_hit = np.diff(first), inside[first[1:]] - inside[first[:-1]]
            names = [sorted(x) for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried]
                + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array((n_hit > 0) & (share * n_hit >= n_words))],
                [*carried, "__n_words", "__n_hit", "__items", "__contaminated"],
            )

    return run


def _blocks(items: DataFrame, text: str, key: str, block_words: int) -> Iterator[list[tuple]]:
    rows: list[tuple] = []
    total = 0
    for row in items.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")).toLocalIterator():
        size = len(row["t"] or "") // 2 + 1  # no text has more words
        if rows and total + size > block_words:
            yield rows
            rows, total = [], 0
        rows.append((row["k"], row["t"]))
        total += size
    if rows:
        yield rows


def decontaminate(
    df: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
    window: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE, block_words: int = BLOCK_WORDS, keep: list[str] | None = None,
) -> DataFrame:
    """df (or its columns `keep`) with __n_words, __n_hit, __items (sorted item_ids) and __contaminated
    (some hits, and share * n_hit >= n_words)."""
    sc = df.sparkSession.sparkContext
    keep = df.columns if keep is None else keep
    rows = df.select(*[f"`{c}`" for c in keep], F.col(text).cast("string").alias("__text"))
    blocks = []
    for some in _blocks(items, item_text, item_id, block_words):
        block = _Block(some, window, shingle)
        frequency = np.zeros(len(block.keys), np.int64)
        counts = map_arrow(rows.select("__text"), _frequencies(sc.broadcast(block)), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        for r in counts.toLocalIterator():  # as many as the block has shingles, at most
            frequency[r["key"]] = r["n"]
        block.order(frequency)
        blocks.append(sc.broadcast(block))
    schema = T.StructType(
        [rows.schema[c] for c in keep]
        + [T.StructField("__n_words", T.LongType()), T.StructField("__n_hit", T.LongType()), T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__contaminated", T.BooleanType())]
    )
    return map_arrow(rows, _matches(blocks, keep, share), schema)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items, keep=["doc_id"]).select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items").cast("binary"), 256).alias("items_sha256"), F.col("__contaminated").alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), sized AS (
  SELECT item_id, ws, least(13, len(ws)) AS w FROM b WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item_id, w, array_to_string(ws[i + 1 : i + w], ' ') AS s FROM (SELECT *, unnest(range(len(ws) - w + 1)) AS i FROM sized)
), places AS (
  SELECT doc_id, i, w, array_to_string(ws[i + 1 : i + w], ' ') AS s
  FROM (SELECT doc_id, ws, w, unnest(range(greatest(len(ws) - w + 1, 0))) AS i FROM d, (SELECT DISTINCT w FROM windows))
), hits AS (
  SELECT p.doc_id, p.i, p.w, x.item_id FROM places p JOIN windows x USING (w, s)
), words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + w)) AS k FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
