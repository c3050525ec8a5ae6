"""Language-model scores of documents: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) P(word | class). Classes: one for words that training has not seen or seen once,
one for the end of a text, one for each of the TOP most frequent words, and the rest by a hash of how words end. The
class softmax has a bias, the classes' training shares, an n-gram feature (the pair of the last two words' classes), and hashed
identities of the last word and, as a skip feature, of the one before it. Within a class hashed by ending, P(word | class, history) is a
product of logistic decisions down a binary tree of the class's words, so that it adds up to 1. A decision's bias is the
discounted training shares of its two sides; its features, hashed with the node, are the last word and, as a skip feature,
the one before it, in a table that grows with the root of the vocabulary; the weights of a history for LEVELS levels of the
tree lie side by side. Words seen equally often are a run; the tree splits runs by mass, then a run's words by rank. Unseen
words and words seen once share the mass of their class by the Good-Turing estimate, whatever the history: words seen once
evenly, an unseen word by the probability of its spelling, byte after byte, each from the one before it, as in training texts.
So a text of unknown words has the probability of its letters, not of an event that all unknown words share.

Data flow. Documents are tokenised once, in chunks, to a staged table. Each chunk sends its distinct words' hashes and
training counts, cut by hash range, to shards that add them up and send the totals back: every distinct word crosses the
network once for each chunk, as packed arrays, and both messages and shards are bounded by the chunk size and the number
of shards, with no word's rows ever meeting in one place but as two numbers for each chunk (total, and rank among the
shard's words of its class and total; how many those are is broadcast). Training: in each of ROUNDS rounds, as many tasks as
there are cores start from the broadcast weights, take steps over their chunks (a chunk trains in one round; AdaGrad for the class
weights, diagonal Newton for the words') and send changes, which are averaged by how often each class row was met, and by the
curvature that each word weight met. Scoring reads the chunks again. The class weights' size is fixed by the parameters; word weights, counts, and what
is exchanged, grow with the corpus.

Defined cases: a null or empty text is the end token alone; repeated rows count and are scored each; a null doc_id
counts as not held out; words beyond ASCII are bytes like others; a word is identified by a 64-bit hash; other columns
are not read; an empty table gives an empty table, and without training texts N and V are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, map_arrow, parts, slabs, stage
from .langid import held_out
from .tokens import LOWER, SPACED, hashes, mix, words

CHUNK = 6 << 20
CLASSES, TOP, ROUNDS, BATCH = 32, 10, 2, 1 << 14
IDS = 1 << 12
#: Levels of a tree whose weights for one history lie side by side, in so many slots.
LEVELS, LINE = 4, 16
#: Word weights: SLOTS times the root of the vocabulary, so that they grow with it and can be broadcast.
SLOTS = 1024
DISCOUNT, RATE = 0.5, 0.25
#: A step's share of Newton's, as two weights share a decision, and the curvature that a weight begins with.
NEWTON, STIFF = 0.5, 2.0
_ENDS = CLASSES - 2 - TOP
_END = np.uint64(0x8000000000000001)
#: What stands before and behind a word's bytes.
_EDGE = 256
_ROWS = (CLASSES * CLASSES, IDS, IDS)


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpack(z: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut, to about `most` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = buffers(batch.column(column))[1][1:]
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= most or start < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lower-case bytes of words, _EDGE for those between, and an _EDGE before each row and behind the last."""
    code = np.where(SPACED[data], LOWER[data].astype(np.int32), _EDGE)
    return np.append(np.insert(code, offsets[:-1], _EDGE), _EDGE).astype(np.int32)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte of a word, or its end, stands behind each other, or its beginning."""
    total = np.zeros((_EDGE + 1) ** 2, np.int64)
    for batch in slabs(batches, "__text"):
        code = _letters(*buffers(batch.column("__text")))
        total += np.bincount(code[:-1] * (_EDGE + 1) + code[1:], minlength=len(total))
    total[-1] = 0  # between words
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["pair", "n"])


def spelling(rows: DataFrame) -> np.ndarray:
    """log P(byte or end | byte or beginning) of the words of rows(__text), each pair being seen half a time more."""
    counts = np.zeros((_EDGE + 1) ** 2)
    for r in map_arrow(rows.select("__text"), _pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most as many as pairs of bytes
        counts[r["pair"]] = r["n"]
    counts = counts.reshape(_EDGE + 1, _EDGE + 1) + 0.5
    counts[_EDGE, _EDGE] = 0  # words are not empty
    with np.errstate(divide="ignore"):
        return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def spelled(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log P(spelling) of each of the words."""
    n = ends - starts
    at = np.cumsum(n) - n
    code = LOWER[data[np.repeat(starts - at, n) + np.arange(int(n.sum()))]].astype(np.int64)
    before = np.empty_like(code)
    before[1:] = code[:-1]
    before[at] = _EDGE
    inner = np.add.reduceat(table[before, code], at) if len(n) else np.zeros(0)
    return inner + table[code[at + n - 1], _EDGE]


def _chunks(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunked(batches, table.value)

    return run


def _chunked(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in _gathered(batches, "__text", CHUNK):
        data, offsets = buffers(batch.column("__text"))
        starts, ends, first = words(data, offsets, SPACED)
        n = np.diff(first) + 1
        at = np.concatenate(([0], np.cumsum(n)))
        h = np.empty(int(at[-1]), np.uint64)
        tail = np.zeros(len(h), np.uint8)
        is_end = np.zeros(len(h), bool)
        is_end[at[1:] - 1] = True
        own = hashes(data, starts, ends)
        h[~is_end] = np.where(own == _END, own ^ np.uint64(2), own)
        h[is_end] = _END
        if len(starts):
            low = LOWER[data[ends - 1]].astype(np.int64) * 257 + np.where(ends - starts > 1, LOWER[data[np.maximum(ends - 2, 0)]], 0)
            tail[~is_end] = (low * 0x9E3779B1 >> 7) % _ENDS
        unique, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        train = batch.column("__train").to_numpy(zero_copy_only=False)
        counts = np.bincount(inverse, np.repeat(train, n), len(unique)).astype(np.int64)
        place = np.cumsum(~is_end)[index] - 1  # of each distinct word among the words
        real = (unique != _END) & (counts == 0)  # what the chunk learns from is not unseen
        spell = np.zeros(len(unique), np.float32)
        spell[real] = spelled(table, data, starts[place[real]], ends[place[real]])
        one = [
            pa.array([batch.column("__doc").to_pylist()], pa.list_(pa.int64())),
            pa.array([_pack(n.astype(np.int64))]), pa.array([train.astype(np.uint8).tobytes()]), pa.array([_pack(inverse.astype(np.int32))]),
            pa.array([unique.tobytes()]), pa.array([tail[index].tobytes()]), pa.array([_pack(counts)]), pa.array([_pack(spell)]),
        ]
        yield pa.RecordBatch.from_arrays(one, ["__docs", "__len", "__held", "__ids", "__words", "__tails", "__counts", "__spell"])


_CHUNK = "__docs array<bigint>, __len binary, __held binary, __ids binary, __words binary, __tails binary, __counts binary, __spell binary"


def _few(df: DataFrame, fn, schema: str) -> DataFrame:
    """map_arrow over rows that are large: batches end by their bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return map_arrow(df, fn, schema)


def _ask(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, w, t, c in zip(*(batch.column(x).to_pylist() for x in ("__chunk", "__words", "__tails", "__counts")), strict=True):
                w, t, c = np.frombuffer(w, np.uint64), np.frombuffer(t, np.uint8), _unpack(c, np.int64)
                edge = np.searchsorted(w, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
                edge = np.concatenate(([0], edge, [len(w)]))
                rows = [(s, chunk, w[a:b].tobytes(), t[a:b].tobytes(), _pack(c[a:b])) for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["__shard", "__chunk", "__words", "__tails", "__counts"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each shard, back to every chunk that asked; and the shard's statistics, as chunk -1."""

    def done(shard: int, held: list[tuple]) -> pa.RecordBatch:
        w = np.concatenate([x[1] for x in held])
        unique, index, inverse = np.unique(w, return_index=True, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, inverse, np.concatenate([x[3] for x in held]))
        tail = np.concatenate([x[2] for x in held])[index]
        end, rare = unique == _END, total == 1
        known = (total > 1) & ~end
        words_ = np.flatnonzero(known)
        key = _run_key(tail[words_], total[words_])
        order = np.argsort(key, kind="stable")
        _, first, many = np.unique(key[order], return_index=True, return_counts=True)
        rank = np.zeros(len(unique), np.int64)
        rank[words_[order]] = np.arange(len(order)) - np.repeat(first, many)
        lead = words_[order][first]
        runs = [_pack(tail[lead]), _pack(total[lead]), _pack(many.astype(np.int64))]
        rows, at = [], 0
        for chunk, own, _, _ in held:
            mine = inverse[at : at + len(own)]
            rows.append((shard, chunk, _pack(total[mine]), _pack(rank[mine]), None, None))
            at += len(own)
        mass = np.bincount(tail[known], total[known] - DISCOUNT, _ENDS)
        best = np.flatnonzero(~end)[np.argsort(-total[~end], kind="stable")[: 4 * TOP]]
        stats = [float(total.sum()), float((total > 0).sum()), float((rare & ~end).sum()), float(((total == 2) & ~end).sum()), float(total[end].sum()), *mass.tolist()]
        top = [x for i in best if total[i] > 1 for x in (float(unique[i] >> np.uint64(32)), float(unique[i] & np.uint64(0xFFFFFFFF)), float(total[i]), float(tail[i]))]
        rows.append((shard, -1, b"", b"", [*stats, *top], runs))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["__shard", "__chunk", "__totals", "__ranks", "__stats", "__runs"])

    at, held = None, []
    for batch in batches:
        for shard, chunk, w, t, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and shard != at:
                yield done(at, held)
                held = []
            at = shard
            held.append((chunk, np.frombuffer(w, np.uint64), np.frombuffer(t, np.uint8), _unpack(c, np.int64)))
    if held:
        yield done(at, held)


def _run_key(tails: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Orders by class, then the most frequent first; leaves room for a shard."""
    return (np.asarray(tails, np.int64) << 56) | (((1 << 40) - 1 - np.asarray(totals, np.int64)) << 16)


class Tree:
    """Binary trees over the words of all classes: runs: for each shard its number, and classes, totals and words of its runs.

    Words stand in the order of class, total (falling), shard and hash. A node is named by the first word of its right side.
    The words that have classes of their own (top) are the first of their run, and left out.
    """

    def __init__(self, runs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], top: list[tuple[int, float, int]], bits: int) -> None:
        self.bits = bits
        none = [np.zeros(0, np.int64)]
        key = np.concatenate([_run_key(t, c) | s for s, t, c, _ in runs] or none)
        order = np.argsort(key)
        self.key, many = key[order], np.concatenate([n for *_, n in runs] or none)[order]
        self.less = np.zeros(len(key), np.int64)
        for w, c, t in top:
            self.less[np.searchsorted(self.key, _run_key(t, int(c)) | self.shards(np.array([w], np.uint64))[0])] += 1
        many = many - self.less
        first = np.cumsum(many) - many
        run, at, self.run = np.unique(self.key >> 16, return_index=True, return_inverse=True)
        self.first, self.many = first[at], np.add.reduceat(many, at) if len(at) else many
        self.offset = first - self.first[self.run]
        self.size = int(many.sum())
        mass = np.concatenate(([0], np.cumsum(self.many * (2 * ((1 << 40) - 1 - (run & ((1 << 40) - 1))) - 1))))
        used = np.flatnonzero(self.many)
        whole = np.append(mass[used], mass[-1])  # of the runs before each
        kind = run[used] >> 40
        lo, hi = np.searchsorted(kind, kind), np.searchsorted(kind, kind, "right")
        levels, self.depth = [], np.zeros(len(self.many), np.int64)
        active = np.flatnonzero(hi - lo > 1)
        while len(active):
            a, b = lo[active], hi[active]
            half = (whole[a] + whole[b]) // 2
            m = np.searchsorted(whole, half)
            m = np.clip(m - (half - whole[m - 1] < whole[m] - half), a + 1, b - 1)
            right = active >= m
            levels.append((used[active], self.first[used[m]], np.log((whole[b] - whole[m]) / (whole[m] - whole[a])), right))
            lo[active], hi[active] = np.where(right, m, a), np.where(right, b, m)
            self.depth[used[active]] += 1
            active = active[hi[active] - lo[active] > 1]
        self.start = np.cumsum(self.depth) - self.depth
        self.path = _laid(self.start, levels, int(self.depth.sum()))

    def shards(self, w: np.ndarray) -> np.ndarray:
        return (w >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(w), np.int64)

    def paths(self, w: np.ndarray, tails: np.ndarray, totals: np.ndarray, ranks: np.ndarray) -> tuple:
        """Place of the first decision and number of decisions of each word; nodes, biases and sides of all decisions."""
        entry = np.searchsorted(self.key, _run_key(tails, totals) | self.shards(w))
        run = self.run[entry]
        rank = self.offset[entry] + ranks - self.less[entry]
        lo, hi, upper, levels = np.zeros(len(w), np.int64), self.many[run], self.depth[run], []
        depth = upper.copy()
        active = np.flatnonzero(hi > 1)
        while len(active):
            a, b = lo[active], hi[active]
            m = (a + b) // 2
            right = rank[active] >= m
            levels.append((active.astype(np.int32), (self.first[run[active]] + m).astype(np.uint32), np.log((b - m) / (m - a)).astype(np.float32), right))
            lo[active], hi[active] = np.where(right, m, a), np.where(right, b, m)
            depth[active] += 1
            active = active[hi[active] - lo[active] > 1]
        start = np.cumsum(depth) - depth
        out = _laid(start + upper, levels, int(depth.sum()))
        del levels
        for k in range(0, len(w), 1 << 16):  # piece by piece, to save memory
            at = slice(k, k + (1 << 16))
            n = upper[at]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            to, of = np.repeat(start[at], n) + step, np.repeat(self.start[run[at]], n) + step
            for x, y in zip(out, self.path, strict=True):
                x[to] = y[of]
        return start, depth, *out


def _laid(start: np.ndarray, levels: list[tuple], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, biases and sides of decisions, those of one word together."""
    node, bias, right = np.zeros(size, np.uint32), np.zeros(size, np.float32), np.zeros(size, bool)
    for k, (who, n, b, r) in enumerate(levels):
        at = start[who] + k
        node[at], bias[at], right[at] = n, b, r
    return node, bias, right


def _blocked(node: np.ndarray, right: np.ndarray, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Of each decision of paths: the hash of the first node of its block of LEVELS levels, its place in the block (as in a heap,
    from 1), and in the last bit the side."""
    if not len(node):
        return node
    order = np.argsort(start)
    level = np.arange(len(node)) - np.repeat(start[order], depth[order])
    within = level % LEVELS
    root = node[np.arange(len(node)) - within]
    place = np.ones(len(node), np.uint32)
    for back in range(LEVELS - 1, 0, -1):  # the sides that were taken in the block before
        has = within >= back
        place[has] = 2 * place[has] + right[np.flatnonzero(has) - back]
    return (root * np.uint32(0x9E3779B1) & np.uint32(0xFFFFFFFF ^ (2 * LINE - 1))) | (place << np.uint32(1)) | right


class Stats:
    """Corpus totals and classes of words."""

    def __init__(self, total: np.ndarray, top: list[tuple[int, float, int]]) -> None:
        self.n, self.v, self.once, twice, self.ends = (int(x) for x in total[:5])
        #: Good and Turing: of text that is not trained on, once / N is unseen, and twice * 2 / N are words that were seen once.
        self.unseen = (self.once + 1) / (self.once + 2 * twice + 2) if self.once else 1.0
        self.mass = total[5 : 5 + _ENDS].copy()
        top = self.best = sorted(top, key=lambda x: (-x[1], x[0]))[:TOP]
        for _, c, t in top:
            self.mass[t] -= c - DISCOUNT
        self.top = np.array([x[0] for x in sorted(top)], np.uint64)
        share = np.zeros(CLASSES)
        share[:2], share[2 : 2 + len(top)], share[2 + TOP :] = (self.once, self.ends), [x[1] for x in sorted(top)], self.mass
        share = np.maximum(share, DISCOUNT)
        self.bias = np.log(share / share.sum()).astype(np.float32)

    def classes(self, w: np.ndarray, tails: np.ndarray, c: np.ndarray, spell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word, and log P(word | class); spell: log P(spelling), for unseen words."""
        kind = (2 + TOP + tails).astype(np.int32)
        inner = np.log(np.maximum(c - DISCOUNT, DISCOUNT) / np.maximum(self.mass[tails], DISCOUNT))
        if len(self.top):
            k = np.minimum(np.searchsorted(self.top, w), len(self.top) - 1)
            is_top = self.top[k] == w
            kind[is_top], inner[is_top] = 2 + k[is_top], 0.0
        rare = c <= 1
        kind[rare] = 0
        inner[rare] = np.where(c[rare] == 0, np.log(self.unseen) + spell[rare], np.log(max(1 - self.unseen, 1e-12) / max(self.once, 1)))
        end = w == _END
        kind[end], inner[end] = 1, 0.0
        return kind, inner


class Chunk:
    """One chunk's tokens with their classes and features."""

    def __init__(self, row: dict, stats: Stats, tree: Tree, slots: int) -> None:
        self.ids, self.len = _unpack(row["__ids"], np.int32), _unpack(row["__len"], np.int64)
        self.train = np.frombuffer(row["__held"], np.uint8).astype(bool)
        w, self.totals = np.frombuffer(row["__words"], np.uint64), _numbers(row["__replies"], 1)
        tails = np.frombuffer(row["__tails"], np.uint8)
        kind, self.inner = stats.classes(w, tails, self.totals, _unpack(row["__spell"], np.float32))
        tree_words = np.flatnonzero(kind >= 2 + TOP)
        self.inner[tree_words] = 0.0
        self.start, self.depth = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        self.start[tree_words], self.depth[tree_words], self.node, self.bias, self.right = tree.paths(w[tree_words], tails[tree_words], self.totals[tree_words], _numbers(row["__replies"], 2)[tree_words])
        self.node = _blocked(self.node, self.right, self.start[tree_words], self.depth[tree_words])
        self.shift = np.uint32(32 - (slots // LINE - 1).bit_length())
        self.kind = kind[self.ids]
        self.at = np.concatenate(([0], np.cumsum(self.len)))
        one, two = np.empty_like(self.ids), np.empty_like(self.ids)
        end = int(np.flatnonzero(w == _END)[0])
        one[1:], two[2:] = self.ids[:-1], self.ids[:-2]
        one[self.at[:-1]] = two[self.at[:-1]] = end
        second = self.at[:-1][self.len > 1] + 1
        two[second] = end
        names = ((mix(w + np.uint64(1)) >> np.uint64(20)) % np.uint64(IDS)).astype(np.int32)
        skips = ((mix(w + np.uint64(2)) >> np.uint64(20)) % np.uint64(IDS)).astype(np.int32)
        self.features = (kind[two] * CLASSES + kind[one], names[one], skips[two])
        self.history = [(mix(w + np.uint64(k)) >> np.uint64(32)).astype(np.uint32)[x] for k, x in ((3, one), (4, two))]

    def decisions(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of the tokens `at`, where their decisions end and how many they are; of each decision, bias, side and weight slots."""
        ids = self.ids[at]
        n = self.depth[ids]
        ends = np.cumsum(n)
        spot = np.repeat(self.start[ids] - (ends - n), n)
        spot += np.arange(len(spot))
        own = self.node[spot]
        right = (own & np.uint32(1)).astype(np.float32)
        place = own >> np.uint32(1) & np.uint32(LINE - 1)
        slots = []
        for h in self.history:
            x = np.repeat(h[at], n)
            x ^= own | np.uint32(2 * LINE - 1)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            x >>= self.shift
            x *= np.uint32(LINE)
            x += place
            slots.append(x.astype(np.intp))
        return ends, n, self.bias[spot], right, slots


def _numbers(replies: list[tuple], i: int) -> np.ndarray:
    return np.concatenate([_unpack(x[i], np.int64) for x in sorted(replies, key=lambda x: x[0])])


def _word_step(w: np.ndarray, bent: np.ndarray, chunk: Chunk, at: np.ndarray) -> None:
    """One diagonal Newton step on a batch's decisions within classes; bent: the curvature that each weight has met."""
    _, _, bias, right, slots = chunk.decisions(at)
    z = bias
    for x in slots:
        z += w[x]
    p = 1 / (1 + np.exp(-z))
    curve = p - p * p
    for x in slots:
        np.add.at(bent, x, curve)
    p -= right
    p *= np.float32(-NEWTON)
    for x in slots:
        np.add.at(w, x, p / bent[x])


def _word_logs(w: np.ndarray, chunk: Chunk, at: np.ndarray) -> np.ndarray:
    """log P(word | class, history) by the tree, of each token."""
    ends, n, bias, right, slots = chunk.decisions(at)
    z = bias
    for x in slots:
        z += w[x]
    z *= 1 - 2 * right
    out = np.zeros(len(at))
    p = 1 / (1 + np.exp(np.clip(z, -30, 30)).astype(np.float64))
    some = n > 0
    if len(p):
        out[some] = np.log(np.maximum(np.multiply.reduceat(p, (ends - n)[some]), 1e-300))
    return out


def _softmax(weights: list[np.ndarray], features: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    z = weights[0][features[0]] + bias
    for w, f in zip(weights[1:], features[1:], strict=True):
        z += w[f]
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _step(weights: list, squares: list, met: list, features: list[np.ndarray], kind: np.ndarray, bias: np.ndarray) -> None:
    """One AdaGrad step on a batch's mean log-likelihood, row by row."""
    g = _softmax(weights, features, bias)
    g[np.arange(len(kind)), kind] -= 1
    for w, s, m, f in zip(weights, squares, met, features, strict=True):
        f = f.astype(np.int16)
        order = np.argsort(f, kind="stable")
        f = f[order]
        first = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        rows, many = f[first], np.diff(np.append(first, len(f)))
        d = np.add.reduceat(g[order], first, axis=0) / np.sqrt(many)[:, None].astype(np.float32)
        s[rows] += d * d
        w[rows] -= RATE * d / np.sqrt(s[rows] + 1e-6)
        m[rows] += many


def _train(weights, stats, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, own = weights.value, None
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, *stats.value, len(start[-1]))
                if own is None:
                    # New arrays of the plain type: np.add.at is slow with the copied types that pickled arrays have.
                    own = [np.add(w, 0, out=np.empty(w.shape, np.float32)) for w in start]
                    squares, met = [np.ones(w.shape, np.float32) for w in start[:-1]], [np.zeros(len(w), np.float64) for w in start[:-1]]
                    bent = np.full(len(start[-1]), STIFF, np.float32)
                use = np.flatnonzero(np.repeat(c.train, c.len))
                for k in range(0, len(use), BATCH):
                    at = use[k : k + BATCH]
                    _step(own[:-1], squares, met, [f[at] for f in c.features], c.kind[at], stats.value[0].bias)
                    _word_step(own[-1], bent, c, at)
                del c, use  # before the next chunk is unpacked
        if own is not None:
            for i in range(blocks):
                at = slice(i * len(own[-1]) // blocks, (i + 1) * len(own[-1]) // blocks)
                change, curve = (own[-1][at] - start[-1][at]).astype(np.float16), np.minimum(bent[at] - STIFF, 6e4).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([blocks + i], pa.int32()), pa.array([_pack(change)], pa.binary()), pa.array([_pack(curve)], pa.binary())], ["__block", "__change", "__met"])
            change = np.concatenate([(a - b) * m[:, None].astype(np.float32) for a, b, m in zip(own[:-1], start[:-1], met, strict=True)])
            many = np.concatenate(met)
            edge = np.linspace(0, len(many), blocks + 1).astype(int)
            rows = [(i, _pack(change[a:b].ravel().astype(np.float32)), _pack(many[a:b])) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["__block", "__change", "__met"])

    return run


def _summed(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for block, change, met in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block < blocks:
                    got = [_unpack(change, np.float32).astype(np.float64), _unpack(met, np.float64)]
                else:
                    curve = _unpack(met, np.float16).astype(np.float32)
                    got = [_unpack(change, np.float16).astype(np.float32) * curve, curve]
                total[block] = [a + b for a, b in zip(total[block], got, strict=True)] if block in total else got
        for block, (change, met) in total.items():
            mean = change.reshape(len(met), -1) / np.where(met > 0, met, 1)[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["__block", "__mean"])

    return run


def _score(weights, stats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, (s, tree) = weights.value, stats.value
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, s, tree, len(w[-1]))
                outer = np.empty(len(c.ids))
                for k in range(0, len(c.ids), BATCH):
                    at = slice(k, k + BATCH)
                    p = _softmax(w[:-1], [f[at] for f in c.features], s.bias)
                    outer[at] = np.log(np.maximum(p[np.arange(len(p)), c.kind[at]], 1e-30)) + _word_logs(w[-1], c, np.arange(k, min(k + BATCH, len(c.ids))))
                base = np.log10((c.totals + 1) / (s.n + s.v + 1))
                add = lambda x, at=c.at[:-1]: np.add.reduceat(x, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["__docs"], pa.int64()), pa.array(~c.train), pa.array(c.len), pa.array(add((c.totals > 0)[c.ids].astype(np.int64))),
                     pa.array(np.full(len(c.len), s.n)), pa.array(add(base[c.ids])), pa.array(add(outer + c.inner[c.ids]) / np.log(10))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(df: DataFrame, train, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; train: the column that says what to learn from."""
    spark = df.sparkSession
    rows = df.select(F.col(doc).cast("long").alias("__doc"), F.coalesce(train, F.lit(True)).alias("__train"), F.col(text).cast("string").alias("__text"))
    table = spark.sparkContext.broadcast(spelling(rows.filter("__train")))
    chunks = stage(_few(rows, _chunks(table), _CHUNK).withColumn("__chunk", F.monotonically_increasing_id()), "chunks")
    n = parts(df)
    bits = max(0, (n - 1).bit_length())
    asked = _few(chunks.select("__chunk", "__words", "__tails", "__counts"), _ask(bits), "__shard int, __chunk bigint, __words binary, __tails binary, __counts binary")
    replies = stage(_few(asked.repartition(n, "__shard").sortWithinPartitions("__shard"), _answer, "__shard int, __chunk bigint, __totals binary, __ranks binary, __stats array<double>, __runs array<binary>"), "replies")
    lines = replies.filter("__chunk = -1")
    total = np.zeros(5 + _ENDS)
    for r in lines.select(F.posexplode(F.slice("__stats", 1, 5 + _ENDS)).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        total[r["i"]] = r["x"]
    four = F.transform(F.sequence(F.lit(5 + _ENDS), F.size("__stats") - 4, F.lit(4)), lambda i: F.struct(*(F.get("__stats", i + k).alias(f"x{k}") for k in range(4))))
    best = lines.filter(F.size("__stats") > 5 + _ENDS).select(F.inline(four)).orderBy(F.desc("x2"), "x0", "x1").limit(TOP).collect()
    stats = Stats(total, [((int(r["x0"]) << 32) | int(r["x1"]), r["x2"], int(r["x3"])) for r in best])
    runs = [(r["__shard"], _unpack(r["__runs"][0], np.uint8), *(_unpack(x, np.int64) for x in r["__runs"][1:])) for r in lines.select("__shard", "__runs").collect()]
    tree = Tree(runs, stats.best, bits)
    back = replies.filter("__chunk >= 0").groupBy("__chunk").agg(F.collect_list(F.struct("__shard", "__totals", "__ranks")).alias("__r"))
    whole = chunks.drop("__counts").join(back, "__chunk")
    ready = stage(whole.withColumn("__replies", F.col("__r")).drop("__r"), "counted")

    names = [c for c in ready.columns]

    def rowed(fn):
        def run(batches):
            return fn(_rows(batches, names))

        return run

    slots = 1 << max(10, math.ceil(math.log2(SLOTS * math.sqrt(tree.size + 1))))
    weights = [*(np.zeros((k, CLASSES), np.float32) for k in _ROWS), np.zeros(slots, np.float32)]
    blocks = max(16, min(n, 512))
    shared_stats = spark.sparkContext.broadcast((stats, tree))
    for round_ in range(ROUNDS):
        mine = ready.filter(F.pmod(F.xxhash64("__chunk"), F.lit(ROUNDS)) == round_)
        few = mine.coalesce(max(1, spark.sparkContext.defaultParallelism))  # each training task sends all weights once
        sent = _few(few, rowed(_train(spark.sparkContext.broadcast(weights), shared_stats, blocks)), "__block int, __change binary, __met binary")
        parts_ = map_arrow(sent.repartition(blocks, "__block"), _summed(blocks), "__block int, __mean binary").collect()  # as large as the weights
        if parts_:
            mean = np.concatenate([np.frombuffer(r["__mean"], np.float32) for r in sorted(parts_, key=lambda r: r["__block"])])
            weights = [w + d.reshape(w.shape) for w, d in zip(weights, np.split(mean, np.cumsum([w.size for w in weights])[:-1]), strict=True)]
    return _few(ready, rowed(_score(spark.sparkContext.broadcast(weights), shared_stats)), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


class _Row(list):
    """A batch of chunk rows that gives them one by one."""

    def to_pylist(self):
        return self


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[_Row]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in names}
            row["__replies"] = [(x["__shard"], x["__totals"], x["__ranks"]) for x in row["__replies"]]
            yield _Row([row])


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, ~held_out("doc_id", 7, 2))
