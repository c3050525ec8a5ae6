"""Suffix arrays by linear grouping, and the removal of repeated byte strings with them.

`suffix_array` sorts in the manner of Baier's grouping algorithm: suffixes are grouped by the Lyndon word that they begin
with; groups are processed in descending order, where each member's pointer to the previous smaller suffix is found by
following pointers, and the suffix it points to is moved to a group of a longer prefix; then one pass emits the order of
each group. Nothing is renamed or sorted recursively.

A corpus is too large for one array, and only repeats of LENGTH bytes matter. Every string of LENGTH bytes has an anchor:
its GRAM bytes of least hash, the same in equal strings. Chunks of documents send their anchors' hashes, packed, to shards
that tell which occur again; the strings around each such anchor (those that it is the anchor of) meet by its hash, equal
ones are put together, different ones are cut to what others share, and a suffix array of those finds all strings of LENGTH bytes that occur again, of
which only the first place stays. Anchors with over HOT places are exchanged as packed hashes of the strings themselves,
cut by hash range, so that no task holds them all. Whole texts that repeat are settled before: texts of one digest are grouped by their bytes.

Defined cases: a null text has no bytes; texts under LENGTH bytes lose nothing; strings are judged on the input; rows
with one doc_id count as one document, in which a string starts at its place in its row, so that repeated rows do not
remove each other; a null doc_id comes first; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, cut, map_arrow, parts, sieved, stage, text_or_empty
from .lm import _few, _gathered
from .tokens import mix

LENGTH, GRAM = 100, 32
HOT = 2000
CHUNK = 4 << 20
#: Starts that are hashed at a time; bits for a place among them.
STRETCH, _PLACE = 1 << 19, 20
_FIRST = -(1 << 63)


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of s in order; the last number must be smaller than all others."""
    n = len(s)
    letters = sorted(set(s))
    gid_of = {c: g for g, c in enumerate(letters)}
    group = [gid_of[c] for c in s]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    above = [g + 1 for g in range(len(letters))]
    below = [g - 1 for g in range(len(letters))]
    above[-1] = -1
    top = len(letters) - 1
    prev = [-2] * n  # not yet known
    g = top
    while g >= 0:
        mine = members[g] = sorted(i for i in members[g] if group[i] == g)
        times: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while j >= 0 and prev[j] != -2:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            last: dict[int, int] = {}
            new: dict[tuple[int, int], int] = {}
            for j, m in times.items() if len(times) == 1 else sorted(times.items(), key=lambda x: x[1]):
                h = group[j]
                k = new.get((h, m))
                if k is None:
                    k = new[(h, m)] = len(members)
                    under = last.get(h, h)
                    over = above[under]
                    members.append([])
                    above.append(over)
                    below.append(under)
                    above[under] = k
                    if over >= 0:
                        below[over] = k
                    last[h] = k
                group[j] = k
                members[k].append(j)
        g = below[g]
    start = [0] * len(members)
    g, at = 0, 0
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = above[g]
    out = [-1] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[start[g]] = i
            start[g] += 1
            placed[i] = True
            i = prev[i]
    return out


def repeated(segments: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Groups of (segment, start) of equal strings of `length` bytes, of at least two places."""
    total = sum(map(len, segments))
    s: list[int] = []
    owner: list[int] = []
    starts = []
    for k, x in enumerate(segments):
        starts.append(len(s))
        s += [b + len(segments) for b in x]
        s.append(len(segments) - 1 - k)
        owner += [k] * (len(x) + 1)
    if not total:
        return []
    blob = b"\0".join(segments) + b"\0"
    ends = [a + len(x) - length for a, x in zip(starts, segments, strict=True)]
    out: list[list[tuple[int, int]]] = []
    held, run = None, []
    for i in suffix_array(s):
        k = owner[i]
        if i > ends[k]:
            continue
        word = blob[i : i + length]
        if word != held:
            if len(run) > 1:
                out.append(run)
            held, run = word, []
        run.append((k, i - starts[k]))
    if len(run) > 1:
        out.append(run)
    return out


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes (a power of two) from each place on."""
    x = mix(data.astype(np.uint64) + np.uint64(0x51ED270B))
    power, n = 0x9E3779B97F4A7C15, 1
    while n < size:
        x = x[:-n] * np.uint64(power) + x[n:]
        power, n = power * power & 0xFFFFFFFFFFFFFFFF, 2 * n
    return mix(x)


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` bytes from each place on."""
    x = mix(data.astype(np.uint64) + np.uint64(0xA5A5A5A5))
    out, covered, power, n = None, 0, 0x9E3779B97F4A7C15, 1
    while True:
        if length & n:
            part = x if out is None else out[: len(out) - n] * np.uint64(power) + x[covered:][: len(out) - n]
            out, covered = part, covered + n
        if 2 * n > length:
            return mix(out)
        x = x[:-n] * np.uint64(power) + x[n:]
        power, n = power * power & 0xFFFFFFFFFFFFFFFF, 2 * n


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor: hash, place, and the first and last start of the strings whose anchor it is. Strings are taken by
    ranges of STRETCH starts, so that memory is bounded whatever a text's length; a range's end may part an anchor's."""
    out = []
    for at in range(0, max(1, len(data) - LENGTH + 1), STRETCH):
        a, b = np.searchsorted(offsets, [at, at + STRETCH + LENGTH - 1], "right")
        inner = np.concatenate(([at], offsets[a:b], [min(len(data), at + STRETCH + LENGTH - 1)])) - at
        h, p, x, y = _anchors(data[at : at + STRETCH + LENGTH - 1], np.unique(inner))
        out.append((h, p + at, x + at, y + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.view(np.uint64), none, none, none
    h = _gram_hashes(data, GRAM)
    w = LENGTH - GRAM + 1
    low = np.uint64(_PLACE)
    key = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    n = len(key) - w + 1
    rows = -(-len(key) // w)
    grid = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(key)] = key
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    place = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    good = np.zeros(n + 1, np.int64)
    fits = np.diff(offsets) >= LENGTH
    np.add.at(good, offsets[:-1][fits], 1)
    np.add.at(good, np.minimum(offsets[1:][fits] - LENGTH + 1, n), -1)
    starts = np.flatnonzero(np.cumsum(good[:n]) > 0)
    if not len(starts):
        return none.view(np.uint64), none, none, none
    p = place[starts]
    new = np.append(True, (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return h[p[first]], p[first], starts[first], starts[last]


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["__z"]), np.uint8)
    return data, np.frombuffer(row["__at"], np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _gathered(batches, "__text", CHUNK):
        data, offsets = buffers(batch.column("__text"))
        z = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([batch.column("__doc").to_pylist()], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(offsets).tobytes()]), pa.array([z])], ["__docs", "__at", "__z"]
        )


def _edges(h: np.ndarray, bits: int) -> np.ndarray:
    inner = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
    return np.concatenate(([0], inner, [len(h)])).astype(np.int64)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _ask(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            h = np.unique(np.sort(anchors(*_texts(row))[0]), return_counts=True)
            edge = _edges(h[0], bits)
            rows = [(s, row["__chunk"], h[0][a:b].tobytes(), np.minimum(h[1][a:b], 1 << 30).astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
            if rows:
                yield _batch(rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["__shard", "__chunk", "__h", "__n"])

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    held: list[dict] = []
    for row in _each(batches):
        if held and held[0]["__shard"] != row["__shard"]:
            yield held[0]["__shard"], held
            held = []
        held.append(row)
    if held:
        yield held[0]["__shard"], held


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, which of its anchors occur again: 1, or 2 if they have over HOT places."""
    for shard, rows in _by_shard(batches):
        own = [np.frombuffer(r["__h"], np.uint64) for r in rows]
        unique, inverse = np.unique(np.concatenate(own), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([np.frombuffer(r["__n"], np.uint32) for r in rows]), len(unique))
        mark = ((n > 1).astype(np.uint8) + (n > HOT))[inverse]
        out, at = [], 0
        for r, h in zip(rows, own, strict=True):
            m = mark[at : at + len(h)]
            at += len(h)
            out.append((shard, r["__chunk"], h[m == 1].tobytes(), h[m == 2].tobytes()))
        yield _batch(out, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["__shard", "__chunk", "__again", "__hot"])


def _found(row: dict) -> tuple:
    """Texts and anchors of a chunk, with the marks of its anchors."""
    data, offsets = _texts(row)
    h, p, a, b = anchors(data, offsets)
    place = p - a
    replies = sorted(row["__r"], key=lambda x: x["__shard"])
    again, hot = (np.frombuffer(b"".join(x[k] for x in replies), np.uint64) for k in ("__again", "__hot"))

    def of(keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h if len(keys) else np.zeros(len(h), bool)

    return data, offsets, h, a, b, place, of(again), of(hot)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _each(batches):
        data, offsets, h, a, b, off, again, _ = _found(row)
        h, a, b, off = h[again], a[again], b[again], off[again]
        doc = np.searchsorted(offsets, a, "right") - 1
        docs = np.array([_FIRST if x is None else x for x in row["__docs"]], np.int64)
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(docs[doc]), pa.array(np.full(len(h), row["__chunk"])), pa.array(doc.astype(np.int32)), pa.array(a - offsets[doc]), pa.array(off),
             pa.array([raw[x : y + LENGTH] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())],
            ["__h", "__doc", "__chunk", "__i", "__start", "__off", "__bytes"],
        )


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def _trimmed(same: dict[tuple, list[tuple]]) -> dict[tuple, list[tuple]]:
    """Different strings around one anchor, cut to what any two have in common on either side of the anchor's start; those
    that are then too short hold no repeat. Neighbours in order share the most."""
    kinds = list(same)
    reach = [[0] * len(kinds), [0] * len(kinds)]
    for side in (0, 1):
        order = sorted((x[off:] if side else x[:off][::-1], k) for k, (off, x) in enumerate(kinds))
        for (a, i), (b, j) in zip(order, order[1:], strict=False):
            n = _common(a, b)
            reach[side][i], reach[side][j] = max(reach[side][i], n), max(reach[side][j], n)
    out: dict[tuple, list[tuple]] = {}
    for k, (off, x) in enumerate(kinds):
        if len(same[(off, x)]) > 1:  # its copies share all of it
            reach[0][k], reach[1][k] = off, len(x) - off
        a, b = off - reach[0][k], off + reach[1][k]
        if b - a >= LENGTH:
            out.setdefault((reach[0][k], x[a:b]), []).extend((*r[:4], r[4] + a, r[5], r[6]) for r in same[(off, x)])
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of starts of repeated strings that are not their first; rows come sorted by anchor."""

    def settle(rows: list[tuple], out: list[tuple]) -> None:
        same: dict[tuple, list[tuple]] = {}
        for r in rows:
            same.setdefault((r[5], r[6]), []).append(r)
        if len(same) > 1:
            same = _trimmed(same)
        places = {x: min((r[1], r[4]) for r in rs) for (_, x), rs in same.items()}
        if not same:
            return
        if len(same) == 1:
            ((_, x),) = same
            out += [(r[2], r[3], r[4], r[4] + len(x) - LENGTH) for rs in same.values() for r in rs if (r[1], r[4]) != places[x]]
            return
        merged: dict[bytes, list[tuple]] = {}
        for (_, x), rs in same.items():
            merged.setdefault(x, []).extend(rs)
        kinds = list(merged)
        first = {}
        for k, x in enumerate(kinds):
            doc, start = min((r[1], r[4]) for r in merged[x])
            for t in range(len(x) - LENGTH + 1):
                first[(k, t)] = (doc, start + t)
        for run in repeated(kinds):
            low = min(first[x] for x in run)
            for x in run:
                first[x] = low
        for k, x in enumerate(kinds):
            n = len(x) - LENGTH + 1
            for r in merged[x]:
                begin = None
                for t in range(n):
                    gone = first[(k, t)] < (r[1], r[4] + t)
                    if gone and begin is None:
                        begin = t
                    elif not gone and begin is not None:
                        out.append((r[2], r[3], r[4] + begin, r[4] + t - 1))
                        begin = None
                if begin is not None:
                    out.append((r[2], r[3], r[4] + begin, r[4] + n - 1))

    kinds, names = [pa.int64(), pa.int32(), pa.int64(), pa.int64()], ["__chunk", "__i", "__from", "__to"]
    held: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for r in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if held and held[0][0] != r[0]:
                settle(held, out)
                held = []
            held.append(r)
        yield _batch(out, kinds, names)
    out = []
    if held:
        settle(held, out)
    yield _batch(out, kinds, names)


def _hot_ask(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            data, offsets, _, a, b, _, _, hot = _found(row)
            if not hot.any():
                continue
            n = (b - a + 1)[hot]
            starts = np.repeat(a[hot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            h = window_hashes(data, LENGTH)[starts]
            h2 = mix(_gram_hashes(data, 64)[starts] ^ _gram_hashes(data, GRAM)[starts + LENGTH - GRAM])
            doc = np.searchsorted(offsets, starts, "right") - 1
            docs = np.array([_FIRST if x is None else x for x in row["__docs"]], np.int64)
            order = np.argsort(h, kind="stable")
            h, h2, doc, place = h[order], h2[order], doc[order], (starts - offsets[doc])[order]
            edge = _edges(h, bits)
            rows = [
                (s, row["__chunk"], h[x:y].tobytes(), h2[x:y].tobytes(), docs[doc[x:y]].tobytes(), doc[x:y].astype(np.int32).tobytes(), place[x:y].tobytes())
                for s, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if y > x
            ]
            yield _batch(rows, [pa.int32(), pa.int64(), *[pa.binary()] * 5], ["__shard", "__chunk", "__h", "__h2", "__d", "__di", "__p"])

    return run


def _hot_answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_shard(batches):
        h, h2 = (np.concatenate([np.frombuffer(r[k], np.uint64) for r in rows]) for k in ("__h", "__h2"))
        d, p = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in ("__d", "__p"))
        i = np.concatenate([np.frombuffer(r["__di"], np.int32) for r in rows])
        chunk = np.repeat([r["__chunk"] for r in rows], [len(r["__h"]) // 8 for r in rows])
        order = np.lexsort((p, d, h2, h))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1]))
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = order[(d[lead] != d[order]) | (p[lead] != p[order])]
        gone = gone[np.lexsort((p[gone], i[gone], chunk[gone]))]
        out: dict[int, np.ndarray] = {}
        for c in np.unique(chunk[gone]):
            at = gone[chunk[gone] == c]
            out[int(c)] = np.stack([i[at].astype(np.int64), p[at], p[at]], 1)
        yield _batch([(c, x.tobytes()) for c, x in out.items()], [pa.int64(), pa.binary()], ["__chunk", "__packed"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text; the last column has the spans that went."""
    for row in _each(batches):
        data, offsets = _texts(row)
        gone = [np.array([(x["__i"], x["__from"], x["__to"]) for x in row["__ranges"] or ()], np.int64).reshape(-1, 3)]
        gone += [np.frombuffer(x, np.int64).reshape(-1, 3) for x in row["__hots"] or ()]
        i, a, b = np.concatenate(gone).T
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, offsets[i] + a, 1)
        np.add.at(change, offsets[i] + b + LENGTH, -1)
        covered = np.cumsum(change[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(covered)))
        raw = data.tobytes()
        out = []
        for k, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            removed = int(total[y] - total[x])
            spans: list[tuple[int, int]] = []
            text = raw[x:y]
            if removed:
                edge = np.flatnonzero(np.diff(np.concatenate(([False], covered[x:y], [False]))))
                spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                at, kept = 0, []
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                text = b"".join([*kept, text[at:]])
            out.append((row["__docs"][k], y - x, removed, [{"start": s, "end": e} for s, e in spans], hashlib.sha256(text).hexdigest(), text))
        yield _batch(out, [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary()], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary"


def remove_repeats(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept_sha256 and kept (the remaining bytes)."""
    docs = df.select(F.col(doc).cast("long").alias("__doc"), text_or_empty(text).alias("__text")).withColumns(
        {"__k1": F.xxhash64("__text"), "__k2": F.xxhash64(F.lit("text"), F.length("__text"), "__text"), "__o": F.coalesce("__doc", F.lit(_FIRST))}
    )
    pair = ["__k1", "__k2"]
    many = cut(docs.groupBy(*pair).agg(F.min("__o").alias("__lo"), F.max("__o").alias("__hi")).filter("__hi > __lo").select(*pair))
    doubtful = stage(sieved(docs, many, "__k1"), "doubtful")
    same = doubtful.join(many, pair, "left_semi").groupBy(*pair, "__text").agg(F.min("__o").alias("__lead"))  # the bytes decide
    texts = cut(same.groupBy(*pair).agg(F.count(F.lit(1)).alias("__n"), F.min("__lead").alias("__lead")).filter("__n = 1").drop("__n"))
    later = cut(doubtful.select("__o", *pair).join(texts, pair).filter("__o > __lead").select("__o", *pair).distinct())
    copies = doubtful.join(later, ["__o", *pair], "left_semi")
    firsts = sieved(docs, many, "__k1", hit=False).unionByName(doubtful.join(later, ["__o", *pair], "left_anti").select(*docs.columns))
    chunks = stage(_few(firsts.select("__doc", "__text"), _chunks, "__docs array<bigint>, __at binary, __z binary").withColumn("__chunk", F.monotonically_increasing_id()), "texts")
    n = parts(df)
    bits = max(0, (n - 1).bit_length())
    asked = _few(chunks, _ask(bits), "__shard int, __chunk bigint, __h binary, __n binary")
    replies = _few(asked.repartition(n, "__shard").sortWithinPartitions("__shard"), _answer, "__shard int, __chunk bigint, __again binary, __hot binary")
    told = stage(replies.groupBy("__chunk").agg(F.collect_list(F.struct("__shard", "__again", "__hot")).alias("__r")), "anchors")
    known = chunks.join(told, "__chunk")
    segments = _few(known, _segments, "__h bigint, __doc bigint, __chunk bigint, __i int, __start bigint, __off bigint, __bytes binary")
    ranges = map_arrow(segments.repartition(2 * n, "__h").sortWithinPartitions("__h"), _settle, "__chunk bigint, __i int, __from bigint, __to bigint")
    hot = _few(known.filter(F.exists("__r", lambda x: F.octet_length(x["__hot"]) > 0)), _hot_ask(bits), "__shard int, __chunk bigint, __h binary, __h2 binary, __d binary, __di binary, __p binary")
    hots = _few(hot.repartition(n, "__shard").sortWithinPartitions("__shard"), _hot_answer, "__chunk bigint, __packed binary")
    ranges = ranges.groupBy("__chunk").agg(F.collect_list(F.struct("__i", "__from", "__to")).alias("__ranges"))
    hots = hots.groupBy("__chunk").agg(F.collect_list("__packed").alias("__hots"))
    kept = _few(chunks.join(ranges, "__chunk", "left").join(hots, "__chunk", "left"), _joined, _OUT)
    size = F.octet_length("__text").cast("long")
    whole = size >= LENGTH
    left = F.when(whole, F.lit("")).otherwise(F.col("__text")).cast("binary")
    span = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    gone = copies.select(
        F.col("__doc").alias("doc_id"), size.alias("n_bytes"), F.when(whole, size).otherwise(F.lit(0).cast("long")).alias("n_removed"), span.alias("spans"), F.sha2(left, 256).alias("kept_sha256"), left.alias("kept")
    )
    return kept.unionByName(gone)


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
