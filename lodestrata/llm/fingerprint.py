"""Canonical exact fingerprints of documents.

A text's canonical form is NFKC, case-folded, NFKC again, with each run of white space as one space and none at the ends.
Its fingerprint is the 128-bit xxh3 digest of that form. Groups of equal documents come from grouping by the wide digest
with the canonical bytes themselves (compressed without loss, by the same coder everywhere) as the rest of the key: inside
a bucket of equal digests, the bytes decide. Spark's hash aggregation combines copies before the shuffle, so that a group
with a third of all rows reaches the network as one row from each task.

The digest is exact: the likeness of two fingerprints is 1.0 if they and the canonical bytes are equal, else 0.0.

Defined cases: a null text is empty; the empty text has a fingerprint like any other; repeated rows and repeated doc_ids
are rows of their own; a null doc_id comes before all others and is never a group's representative if another is there;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, parts, sieved, slabs, stage, strings

LEVEL = 6


def canonical(text: str) -> bytes:
    """The canonical form in UTF-8."""
    folded = (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold()
    if not folded.isascii():
        folded = unicodedata.normalize("NFKC", folded)
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def _second(canon: bytes) -> int:
    """64 more bits, signed."""
    return xxhash.xxh3_64_intdigest(canon, 1) - (1 << 63)


def likeness(a: str, b: str) -> float:
    """Of two exact fingerprints."""
    return 1.0 if a == b else 0.0


def _marks(with_bytes: bool):
    """Digests of canonical texts, and their compressed bytes if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        for batch in slabs(batches, "__text"):
            canons = [canonical(x) for x in strings(batch.column("__text"))]
            columns = [pa.array([digest(x) for x in canons], pa.string()), pa.array([_second(x) for x in canons], pa.int64()), batch.column("__doc")]
            columns += [pa.array([zip_.compress(x) for x in canons], pa.binary())] if with_bytes else []
            yield pa.RecordBatch.from_arrays(columns, ["fingerprint", "__check", "__doc", "__bytes"][: len(columns)])

    return run


def exact_groups(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """A row for each distinct canonical text: fingerprint, __check, group_id (smallest doc), group_size."""
    rows = df.select(F.col(doc).alias("__doc"), F.col(text).cast("string").alias("__text"))
    kind = df.schema[doc].dataType.simpleString()
    canon = map_arrow(rows, _marks(True), f"fingerprint string, __check bigint, __doc {kind}, __bytes binary")
    return _groups(canon).drop("__bytes")


def _groups(canon: DataFrame) -> DataFrame:
    return canon.groupBy("fingerprint", "__check", "__bytes").agg(F.min("__doc").alias("group_id"), F.count(F.lit(1)).alias("group_size"))


def _spread(bounds: np.ndarray, first: int | None):
    """Rows by range of doc_id; the first row of each range once more, as the end of the range before it."""
    last = len(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        for batch in slabs(batches, "__text"):
            docs = batch.column("__doc").to_pylist()
            texts = [zip_.compress(x.encode("utf-8", "surrogatepass")) for x in strings(batch.column("__text"))]
            at = [0 if d is None else int(np.searchsorted(bounds, d, "right")) for d in docs]
            tail = [False] * len(docs)
            for i, d in enumerate(list(docs)):
                before = last if d == first else at[i] - 1 if d is not None and at[i] and bounds[at[i] - 1] == d else None
                if d is not None and d == first and at[i] and bounds[at[i] - 1] == d:
                    before = None  # the first range is empty
                    for b in {at[i] - 1, last}:
                        docs.append(d), texts.append(texts[i]), at.append(b), tail.append(True)
                if before is not None:
                    docs.append(d), texts.append(texts[i]), at.append(before), tail.append(True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(tail), pa.array(docs, pa.int64()), pa.array(texts, pa.binary())], ["__at", "__tail", "__doc", "__z"])

    return run


def _ranged(bounds: np.ndarray):
    """Doc_ids whose canonical bytes are asked for, dealt as their texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column("__doc").to_numpy(), "right").astype(np.int32)
            none = pa.nulls(len(at), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), bool)), batch.column("__doc"), none], ["__at", "__tail", "__doc", "__z"])

    return run


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_, unzip = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), zstandard.ZstdDecompressor()
    held = asked = None
    for batch in batches:
        out: list[tuple] = []
        for at, tail, doc, z in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if z is None:
                asked = doc
                continue
            text = unzip.decompress(z).decode("utf-8", "surrogatepass")
            canon = canonical(text)
            mark = digest(canon)
            if held is not None and held[0] == at:
                _, doc0, text0, mark0, check0, z0 = held
                half = len(text0) // 2
                edit = text0[: len(text0) - half] + text[:half]
                mark1 = digest(canonical(edit))
                sha = hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((doc0, len(text0), sha, mark0, mark1, likeness(mark0, mark1), likeness(mark0, mark), check0, z0))
            held = None if tail else (at, doc, text, mark, _second(canon), zip_.compress(canon) if doc is None or doc == asked else None)
        columns = list(zip(*out, strict=True)) if out else [[]] * 9
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.binary()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "__check", "__bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    if held is not None:
        raise ValueError("a range of documents has no end")


def with_next(df: DataFrame, text: str = "text", doc: str = "doc_id", asked: DataFrame | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose latter half the next document's beginning replaces; __bytes (the
    canonical text, compressed) of the documents that are asked for (__doc, distinct), which travel with the texts' shuffle.

    Documents follow each other by doc_id (rows of one doc_id by their compressed bytes); after the last comes the first.
    Texts are dealt once, compressed, by ranges of doc_id; the row that begins a range also closes the one before it.
    """
    n = 4 * parts(df)
    rows = df.select(F.col(doc).cast("long").alias("__doc"), F.col(text).cast("string").alias("__text"))
    marks = rows.agg(
        F.percentile_approx("__doc", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("b"),
        F.min("__doc").alias("least"), F.count_if(F.col("__doc").isNull()).alias("nulls"),
    ).first()
    bounds = np.unique(np.array(marks["b"] or [], np.int64))
    first = None if marks["nulls"] else marks["least"]
    schema = "__at int, __tail boolean, __doc bigint, __z binary"
    dealt = map_arrow(rows, _spread(bounds, first), schema)
    if asked is not None:
        dealt = dealt.union(map_arrow(asked.filter("__doc IS NOT NULL").select(F.col("__doc").cast("long").alias("__doc")), _ranged(bounds), schema))
    dealt = dealt.repartition(parts(df), "__at")
    ordered = dealt.sortWithinPartitions("__at", "__tail", F.col("__doc").asc_nulls_first(), "__z")
    return map_arrow(
        ordered, _edited,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, __check bigint, __bytes binary",
    )


def fingerprints(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """with_next, and group_id and group_size of the documents of equal canonical texts.

    A count of narrow digests, and a sieve of bounded size, tell which documents may have copies; only their bytes are grouped, so
    that others' texts cross the network once, with the shuffle that brings each document to its next.
    """
    rows = df.select(F.col(doc).cast("long").alias("__doc"), F.col(text).cast("string").alias("__text"))
    marks = stage(map_arrow(rows, _marks(False), "fingerprint string, __check bigint, __doc bigint"), "marks")
    many = marks.groupBy("fingerprint", "__check").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    found = stage(with_next(df, text, doc, sieved(marks, many, "__check").select("__doc").distinct()), "edited")
    copies = found.filter("__bytes IS NOT NULL")
    groups = cut(_groups(copies.select("fingerprint", "__check", "__bytes", F.col("doc_id").alias("__doc"))).filter("group_size > 1"))
    both = copies.join(groups, ["fingerprint", "__check", "__bytes"], "left")  # groups are cut, so that a large one's rows can be split
    named = both.select(*found.columns, F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    alone = found.filter("__bytes IS NULL").select("*", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"))
    return named.unionByName(alone).drop("__bytes", "__check")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprints(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "group_size")
