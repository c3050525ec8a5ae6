"""Best-fit packing of tokenised documents under several capacities.

Every piece is a vector: its tokens, one document, and its attention cost (tokens squared). All three depend on the
length alone, so the plan needs only the number of pieces of each length: at most `capacity` numbers, whatever the corpus.
Lengths are taken in descending order; open bins are kept as types of equal residual vectors with their multiplicity, and
each length goes to the feasible type with the best score, many bins at a time: the least weighted norm of the residual
that would be left, or the largest weighted dot product of piece and residual. The plan is a list of runs (ranks of a
length, to bins), bounded by the capacity too, and is broadcast. Pieces get their ranks by hashed buckets: a count for
each length and bucket, a running sum over buckets, and the row number within; a length with a third of all rows is
dealt over all buckets.

Defined cases: a null text is empty, a document of the end id alone; repeated documents are packed each; documents over
the capacity are cut into whole pieces of it, the last may be shorter; other columns are not read; an empty table gives
an empty table.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, parts, slabs, stage, strings

CAPACITY = 2048
#: Entries of each of a worker's two caches of words: the words met last, and those before them, which come back when met again.
CACHE = 200_000
# How word_bpe_49k.json cuts words.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PARTS = regex.compile(_PATTERN).findall
_SIMPLE = regex.compile(r"[!-~\u00A1-\u012F\u0131-\u024F]+").fullmatch


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_characters() -> list[str]:
    """The characters that byte-level BPE gives to bytes: printable ones keep their own, the others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class _Encoder:
    """Ids of texts as bytes. A tokenizer that cuts as _CUTS never joins what a space or newline parts, so each such word is
    encoded once; for any other, whole texts take the tokenizer's own way.

    Words of characters up to U+024F have one normal form, so they are cut as the tokenizer cuts them and the parts go to
    its model at once; all other words take the tokenizer's whole way.
    """

    def __init__(self, path: str) -> None:
        tokenizer = _tokenizer(path)
        self.whole, self.model = tokenizer.encode_batch_fast, tokenizer.model
        self.known, self.parts = {"": b""}, {}
        self.old, self.old_parts = {}, {}
        self.chars = _byte_characters()
        self.plain = json.loads(tokenizer.to_str())["pre_tokenizer"] == _CUTS

    def _part(self, part: str) -> bytes:
        got = self.old_parts.get(part)
        if got is None:
            marks = part if part.isascii() else "".join(map(self.chars.__getitem__, part.encode()))
            got = array("I", [x.id for x in self.model.tokenize(marks)]).tobytes()
        self.parts[part] = got
        return got

    def _words(self, new: list[str]) -> None:
        known, old, parts, part, hard = self.known, self.old, self.parts, self._part, []
        for w in new:
            if w in old:
                known[w] = old[w]
                continue
            if "<|" in w or not (_SIMPLE(w) if not w.isascii() else w.isprintable()):
                hard.append(w)
                continue
            low = w.lower()
            if low.isalpha():
                known[w] = parts[low] if low in parts else part(low)
                continue
            many = (low[:-1], low[-1]) if low[:-1].isalpha() and low[-1] in ".,;:!?" else _PARTS(low)
            known[w] = b"".join([parts[x] if x in parts else part(x) for x in many])
        if hard:
            for w, e in zip(hard, self.whole(hard, add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.plain:  # it may join what spaces part
            return [array("I", e.ids).tobytes() for e in self.whole(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {"": b""}
        if len(self.parts) > CACHE:
            self.old_parts, self.parts = self.parts, {}
        new: set[str] = set()
        for ws in split:
            new.update(ws)
        self._words([w for w in new if w not in self.known])
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


@cache
def _encoder(path: str) -> _Encoder:
    """One for each worker, whose next tasks find the words of the last ones."""
    return _Encoder(path)


def tokenise(df: DataFrame, path: str, text: str = "text", doc: str = "doc_id", capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece: __doc, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop, width = _encoder(path), np.array([end], "<u4").tobytes(), 4 * capacity
        for batch in slabs(batches, "__text"):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, blob in enumerate(encode(strings(batch.column("__text")))):
                blob += stop
                for p in range(0, len(blob), width):
                    one = blob[p : p + width]
                    row.append(i), piece.append(p // width), start.append(p // 4), length.append(len(one) // 4), crc.append(zlib.crc32(one))
                    if with_ids:
                        ids.append(np.frombuffer(one, "<u4").astype(np.int32))
            columns = [batch.column("__doc").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["__doc", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32()))), names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[doc].dataType.simpleString()
    rows = df.select(F.col(doc).alias("__doc"), F.col(text).cast("string").alias("__text"))
    return map_arrow(rows, run, f"__doc {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


class Plan:
    """Runs of the packing: pieces of `length` and ranks from `rank` on go to bins from `bin` on, `each` to a bin, at `offset`."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, documents: int | None = None, cost: int | None = None, weights: tuple = (1.0, 1.0, 1.0), rule: str = "norm") -> None:
        self.full = np.array([capacity, documents or capacity, cost or capacity * capacity], np.int64)
        self.weights, self.rule = np.array(weights, float), rule
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, rank, bin, each, offset
        self.bins = 0
        self._left = np.zeros((64, 3), np.int64)
        self._open: list[list[tuple[int, int]]] = []
        self._count = np.zeros(64, np.int64)
        self._known: dict[tuple, int] = {}
        for length in sorted(counts, reverse=True):
            self._place(int(length), int(counts[length]))

    def _add(self, left: np.ndarray, first: int, n: int) -> None:
        if not n or not left.all():
            return
        key = tuple(left.tolist())
        k = self._known.setdefault(key, len(self._open))
        if k == len(self._open):
            self._open.append([])
            if k == len(self._left):
                self._left, self._count = np.concatenate((self._left, self._left * 0)), np.concatenate((self._count, self._count * 0))
            self._left[k] = left
        self._open[k].append((first, n))
        self._count[k] += n

    def _place(self, length: int, n: int) -> None:
        size, rank = np.array([length, 1, length * length], np.int64), 0
        while n:
            m = len(self._open)
            left, fits = self._left[:m], (self._left[:m] >= size).all(1) & (self._count[:m] > 0)
            if fits.any():
                at = np.flatnonzero(fits)
                share = (left[at] - (size if self.rule == "norm" else 0)) / self.full
                score = (self.weights * share**2).sum(1) if self.rule == "norm" else -(self.weights * share * size / self.full).sum(1)
                k = int(at[np.lexsort((left[at, 0], score))[0]])
                residual = self._left[k].copy()
                first, many = self._open[k].pop()
                self._count[k] -= many
            else:
                if (size > self.full).any():
                    raise ValueError(f"a piece of {length} tokens exceeds the capacities {self.full.tolist()}")
                residual, first, k = self.full.copy(), self.bins, -1
                each = int((residual // size).min())
                many = -(-n // each)
                self.bins += many
            each = int((residual // size).min())
            whole = min(many, n // each)
            rest = min(n - whole * each, each - 1) if whole < many else 0
            offset = int(self.full[0] - residual[0])
            if whole:
                self.runs.append((length, rank, first, each, offset))
                self._add(residual - each * size, first, whole)
            if rest:
                self.runs.append((length, rank + whole * each, first + whole, rest, offset))
                self._add(residual - rest * size, first + whole, 1)
            over = many - whole - bool(rest)
            if over:
                self._add(residual, first + whole + bool(rest), over)
            rank += whole * each + rest
            n -= whole * each + rest

    def table(self) -> dict[int, np.ndarray]:
        out: dict[int, list] = {}
        for length, *run in self.runs:
            out.setdefault(length, []).append(run)
        return {k: np.array(v, np.int64) for k, v in out.items()}


def _seats(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at, runs = np.flatnonzero(length == n), table[int(n)]
                r = rank[at]
                first, bin_, each, offset = runs[np.searchsorted(runs[:, 0], r, "right") - 1].T
                seq[at], off[at] = bin_ + (r - first) // each, offset + (r - first) % each * n
            names = [x for x in batch.schema.names if x != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, **limits) -> DataFrame:
    """Pieces with sequence_id and offset. `pieces` is read twice: stage it first."""
    spark = pieces.sparkSession
    n = parts(pieces)
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64("__doc", "piece"), F.lit(n)).cast("int"))
    counts = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    total = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as the capacity, at most
    plan = spark.sparkContext.broadcast(Plan(total, capacity, **limits).table())
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("length", "__bucket").orderBy("__doc", "piece", "ids_crc32")
    ranked = dealt.withColumn("__row", F.row_number().over(own)).join(base, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__base") + F.col("__row") - 1).select(*pieces.columns, "__rank")
    schema = pieces.schema
    from pyspark.sql import types as T

    out = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_arrow(ranked, _seats(plan), out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = stage(tokenise(docs, default_tokenizer()), "pieces")
    return pack(pieces).select(F.col("__doc").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
