"""Fill-in-middle: documents cut into prefix, middle and suffix at unit ends, and the middle moved to the end.

Units (lines, or code points) are counted in one pass over a text's UTF-8 bytes, which records byte and code-point offsets
of every EVERY-th unit: a sparse index of checkpoints. A cut at unit k is found by binary search of the checkpoint before
it and a scan of at most EVERY units from there, so that the index of a text of any length has a row for EVERY units.

Choices (cuts, form) come from the SHA-256 of the seed and the decimal id alone, so that a retried task repeats them.

Defined cases: a null or empty text has no units and is plain; a null id hashes as the empty string; a text that contains a
sentinel is plain; rows with equal ids are treated alike; bytes that are no UTF-8 pass unchanged; all other columns pass
through, whatever their names (but for those that begin with two underscores); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, map_arrow, slabs

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Units from one checkpoint to the next.
EVERY = 64
#: Bytes that are scanned at a time while units are counted.
SCAN = 1 << 20


def _heads(data: np.ndarray) -> np.ndarray:
    """Whether each byte begins a code point."""
    return (data & 0xC0) != 0x80


@dataclass
class Index:
    """Units of a text, and (byte, code point) offsets of the starts of units 0, every, 2 * every and so on."""

    data: np.ndarray
    unit: str
    every: int
    n: int
    units: np.ndarray
    at_byte: np.ndarray
    at_char: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, unit: str = "line", every: int = EVERY) -> Index:
        """Counts the units of UTF-8 bytes, SCAN bytes at a time."""
        marks: list[tuple[int, int, int]] = [(0, 0, 0)] if len(data) else []
        n = chars = 0  # unit ends and code points so far
        for lo in range(0, len(data), SCAN):
            block = data[lo : lo + SCAN]
            heads = _heads(block)
            # byte offsets, within the block, at which a unit other than the first of the text starts
            starts = np.flatnonzero(block == 10) + 1 if unit == "line" else np.flatnonzero(heads)[lo == 0 :]
            picked = np.flatnonzero((n + 1 + np.arange(len(starts))) % every == 0)
            if len(picked):
                seen = np.concatenate(([0], np.cumsum(heads)))
                marks += [(n + 1 + int(i), lo + int(starts[i]), chars + int(seen[starts[i]])) for i in picked]
            n += len(starts)
            chars += int(np.count_nonzero(heads))
        n += bool(len(data)) and (unit == "char" or data[-1] != 10)
        marks = [m for m in marks if m[1] < len(data)] + [(n, len(data), chars)]
        units, at_byte, at_char = np.array(marks, np.int64).T
        return cls(data, unit, every, int(n), units, at_byte, at_char)

    def cut(self, k: int) -> tuple[int, int]:
        """Byte and code-point offsets of the end of the first k units."""
        i = int(np.searchsorted(self.units, k, "right")) - 1
        at, char, left = int(self.at_byte[i]), int(self.at_char[i]), k - int(self.units[i])
        if not left:
            return at, char
        block = self.data[at : int(self.at_byte[i + 1])]
        ends = np.flatnonzero(block == 10) + 1 if self.unit == "line" else np.append(np.flatnonzero(_heads(block))[1:], len(block))
        step = int(ends[left - 1]) if left <= len(ends) else len(block)
        return at + step, char + int(np.count_nonzero(_heads(block[:step])))


def choices(doc: str, seed: int) -> list[int]:
    """Four numbers of 32 bits."""
    found = hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()
    return [int(found[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(data: np.ndarray, doc: str, seed: int, rate: int, spm: int, unit: str, every: int) -> tuple[bytes, int, str, int | None, int | None]:
    """Output, number of units, form, code points of prefix and middle (None where plain)."""
    text = data.tobytes()
    index = Index.of(data, unit, every)
    h1, h2, h3, h4 = choices(doc, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return text, index.n, "plain", None, None
    a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (p, p_chars), (m, m_chars) = index.cut(a), index.cut(b)
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    if h4 % 100 < spm:
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), index.n, "spm", p_chars, m_chars - p_chars
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), index.n, "psm", p_chars, m_chars - p_chars


def _strings(rows: list[bytes]) -> pa.Array:
    """Bytes as strings, as they are."""
    at = np.concatenate(([0], np.cumsum([len(x) for x in rows], dtype=np.int64)))
    return pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(b"".join(rows))])


def fill_in_middle(
    df: DataFrame, text: str = "text", doc: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", every: int = EVERY, keep: list[str] | None = None,
) -> DataFrame:
    """df (or its columns `keep`) with __output, __form (plain, psm, spm), __n (units), __prefix_chars and __middle_chars.

    rate: percentage of texts that are transformed; spm: percentage of those whose suffix comes first. unit: line or char.
    """
    if unit not in ("line", "char"):
        raise ValueError(unit)
    keep = df.columns if keep is None else keep
    out = ["__output", "__n", "__form", "__prefix_chars", "__middle_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "__text"):
            data, at = buffers(batch.column("__text"))
            docs = batch.column("__id").to_pylist()
            found = [transform(data[at[i] : at[i + 1]], docs[i], seed, rate, spm, unit, every) for i in range(batch.num_rows)]
            texts, n, form, prefix, middle = zip(*found, strict=True)
            made = [_strings(list(texts)), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
            made[0] = made[0].cast(pa.string()) if made[0].nbytes < 1 << 30 else made[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *out])

    rows = df.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").cast("string").alias("__text"), F.coalesce(F.col(f"`{doc}`").cast("string"), F.lit("")).alias("__id"))
    types = [T.StringType(), T.LongType(), T.StringType(), T.LongType(), T.LongType()]
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(c, t) for c, t in zip(out, types, strict=True))])
    return map_arrow(rows, run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: a transformed text has each sentinel once."""
    parts = F.split(output, "<[PSM]>", -1)
    of = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(of(1), of(3), of(2))).otherwise(F.concat(of(2), of(3), of(1)))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = fill_in_middle(docs, keep=["doc_id"])
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.col("__n").alias("n"), F.col("__form").alias("form"), F.col("__prefix_chars").alias("prefix_chars"), F.col("__middle_chars").alias("middle_chars"),
        sha(F.col("__output")).alias("output_sha256"), sha(restored(F.col("__output"), F.col("__form"))).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[25:32])::BIGINT % 100 < 50 AS back,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM base
), cuts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN back THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN back THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cuts
"""
