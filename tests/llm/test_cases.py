"""Cases that operators' docstrings define and limits at their least: hot paths, repeated rows, nulls, long texts, other tokenizers."""

from __future__ import annotations

import hashlib
import random
from array import array
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import common, fingerprint, neardup, packing, suffix, warc


def said(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_fingerprint_groups(spark):
    """Groups by bytes; null and repeated doc_ids, columns of clashing names."""
    r = random.Random(1)
    texts = [said(r, 12) for _ in range(20)]
    rows = [(i, texts[i % 20].upper() if i % 3 else texts[i % 20] + " ", "f") for i in range(70)] + [(100 + i, said(r, 9), "f") for i in range(20)]
    rows += [(5, texts[0], "f"), (5, texts[0], "f"), (None, texts[1], "f"), (None, None, "f"), (200, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(6)
    got = Counter((x["doc_id"], x["fingerprint"], x["group_id"], x["group_size"]) for x in fingerprint.fingerprints(df).collect())
    groups = defaultdict(list)
    for doc, text, _ in rows:
        groups[fingerprint.canonical(text or "")].append(doc)
    want = Counter()
    for doc, text, _ in rows:
        mine = groups[fingerprint.canonical(text or "")]
        want[doc, fingerprint.digest(fingerprint.canonical(text or "")), min((d for d in mine if d is not None), default=None), len(mine)] += 1
    assert got == want
    assert fingerprint.fingerprints(df.limit(0)).count() == 0


def test_digests_alone_do_not_make_copies(spark, monkeypatch):
    """With all digests equal, the bytes decide."""
    rows = spark.createDataFrame([("same", 1, i, bytes([i % 3])) for i in range(9)], "fingerprint string, __check long, __doc long, __bytes binary")
    assert sorted((x["group_id"], x["group_size"]) for x in fingerprint._groups(rows).collect()) == [(0, 3), (1, 3), (2, 3)]


@pytest.mark.parametrize("bits", [6, 24])
def test_sieve_lets_all_copies_through(spark, monkeypatch, bits):
    """A sieve of 64 bits lets nearly all rows through; results are the same."""
    monkeypatch.setattr(common, "SIEVE", bits)
    r = random.Random(8)
    rows = [(i, said(r, 30) if i % 3 else "the same text for a third of all documents, and rather more than a hundred bytes of it, as is needed here") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = Counter(x["group_size"] for x in fingerprint.fingerprints(df).collect())
    assert sizes == {1: 60, 30: 30}
    assert {x["doc_id"]: bytes(x["kept"]) for x in suffix.remove_repeats(df).collect()} == brute_removed(rows)


def brute_removed(rows: list[tuple]) -> dict[int, bytes]:
    seen: dict[bytes, tuple] = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - suffix.LENGTH + 1):
            w = b[i : i + suffix.LENGTH]
            seen[w] = min(seen.get(w, (doc, i)), (doc, i))
    out = {}
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - suffix.LENGTH + 1):
            if seen[b[i : i + suffix.LENGTH]] < (doc, i):
                gone[i : i + suffix.LENGTH] = [True] * suffix.LENGTH
        out[doc] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("hot", [0, 3, 2000])
def test_repeats_with_whole_copies(spark, monkeypatch, hot):
    """Copies of whole texts in large groups, texts that copies share in part, a very long text, columns of clashing names."""
    monkeypatch.setattr(suffix, "HOT", hot)
    r = random.Random(2)
    shared, copy = said(r, 60), said(r, 80)
    rows = [(i, copy) for i in range(0, 40, 2)] + [(i, f"{said(r, 20)} {shared} {said(r, 20)}") for i in range(1, 30, 2)]
    rows += [(50, copy[: len(copy) // 2] + said(r, 5)), (51, said(r, 9000) + copy), (52, "short"), (53, "short"), (54, None), (55, "ab" * 300)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kept string").repartition(5)
    got = {x["doc_id"]: bytes(x["kept"]) for x in suffix.remove_repeats(df).collect()}
    assert got == brute_removed(rows)


@pytest.mark.parametrize("ids", [0, 250_000])
def test_near_duplicates_whatever_is_broadcast(spark, monkeypatch, ids):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", ids)
    r = random.Random(3)
    base = [said(r, 80).split() for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(base[i % 6])
        w[r.randrange(len(w))] = f"x{i % 4}"
        rows.append((i, " ".join(w)))
    got = {
        x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, num=85, den=100).collect()
    }
    sets = {d: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for d, t in rows}
    top = {d: d for d in sets}
    for _ in range(len(rows)):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    assert got == top


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)]
    got = {x["__id"]: x["__comp"] for x in neardup.components(spark.createDataFrame(links, "__a long, __b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer(name):
    """Ids equal those of whole texts, also where a tokenizer joins a space to a word."""
    path = Path("/opt/tokenizers") / name
    if not path.exists():
        pytest.skip("no tokenizers here")
    r = random.Random(4)
    texts = ["", " ", "Hello  world\nagain", "it's 1234 <|endoftext|> é ﬁne İ", said(r, 3000), "x" * 5000, "日本語 text \t tab"]
    whole = packing._tokenizer(str(path))
    want = [array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert packing._Encoder(str(path))(texts) == want


def test_packing_cases(spark):
    """Null and repeated doc_ids and null texts are pieces of their own; sequences are filled without gaps, and few."""
    r = random.Random(5)
    rows = [(None, "a b"), (None, None), (7, "a b"), (7, "a b"), (8, said(r, 4000))] + [(10 + i, said(r, r.randint(1, 700))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.tokenise(df, packing.default_tokenizer()).cache()
    got = packing.pack(pieces).collect()
    assert len(got) == pieces.count() and sum(x["__doc"] is None for x in got) == 2 and sum(x["__doc"] == 7 for x in got) == 2
    filled = defaultdict(list)
    for x in got:
        filled[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    least = -(-sum(x["length"] for x in got) // packing.CAPACITY)
    assert len(filled) <= 1.05 * least + 1


def test_warc_cases(spark, tmp_path):
    """A payload of several reading blocks in a gzip member that tells its length; columns of clashing names; no rows."""
    long = random.Random(6).randbytes(1 << 20).hex()
    rows = [(1, "http://a", long, "x"), (2, "http://b", None, "x"), (3, "http://a", long, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    warc.write_warc(warc.with_revisits(pages).select("record_type", "record_id", "target_uri", "warc_date", "refers_to", "payload"), str(tmp_path / "w"))
    got = sorted((x["record_id"], x["warc_type"], x["payload_length"], bytes(x["payload"] or b"")) for x in warc.read_warc(spark, str(tmp_path / "w")).collect())
    kinds = Counter((kind, n) for _, kind, n, _ in got)
    assert kinds == {("response", len(long)): 1, ("revisit", len(long)): 1, ("response", 0): 1} and any(hashlib.sha1(p).digest() == hashlib.sha1(long.encode()).digest() for *_, p in got)
    warc.write_warc(warc.with_revisits(pages.limit(0)).select("record_type", "record_id", "target_uri", "warc_date", "refers_to", "payload"), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_stages_of_odd_rows(spark, tmp_path):
    """Null doc_ids, repeated rows and a very long text in every stage."""
    r = random.Random(7)
    texts = {k: said(r, 60) for k in range(6)}
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()] + [(None, said(r, 50), "en", "s", 1), (3, texts[3], "en", "s", 1), (9, said(r, 20_000), None, "s", 1), (10, None, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[5])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path)).cache()
        seen[name] = sorted(x["doc_id"] if x["doc_id"] is not None else -1 for x in table.select(F.col("doc_id")).collect())
    assert seen["language_id"] == seen["line_dedup"] == [-1, 0, 1, 2, 3, 3, 4, 5, 9]
    assert seen["near_dedup"] == [-1, 0, 1, 2, 3, 4, 5, 9] and seen["decontamination"] == [-1, 0, 1, 2, 3, 4, 9]
    assert set(seen["best_fit_packing"]) == {-1, 0, 1, 2, 3, 4, 9}
