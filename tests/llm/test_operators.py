"""Each text operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrata.llm import decontam, fingerprint, html, langid, lines, lm, neardup, packing, sketch, suffix, tokens, warc

UP, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = str.maketrans(UP, DOWN)
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """doc_id, text, lang, and columns whose names clash with the operators' own."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 7))) for _ in range(150)]
    said = lambda k: " ".join(r.choice(vocabulary).title() if r.random() < 0.1 else r.choice(vocabulary) for _ in range(k))
    shared = [said(22) for _ in range(4)]
    texts: list[str | None] = [None, "", " \n ", "a", "123 456", "Licensed under the same terms.\nB", said(3000)]
    for _ in range(n):
        parts = [said(r.randint(1, 60)) for _ in range(r.randint(1, 4))] + [r.choice(shared)] * (r.random() < 0.5) + ["Licensed under the same terms. "] * (r.random() < 0.4)
        r.shuffle(parts)
        texts.append("\n".join(parts))
    for _ in range(12):  # exact and near copies
        t = r.choice(texts[7:])
        w = t.split(" ")
        if r.random() < 0.6 and len(w) > 40:
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = [(i * 3 + 1, t, r.choice(["x", "y", None]), i, "clash") for i, t in enumerate(texts)]
    return rows


SCHEMA = "doc_id long, text string, lang string, n_words int, kept string"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hashes_follow_words():
    text = "Ab  ab\taB é ÉÉ x"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, first = tokens.words(data, np.array([0, 9, len(data)]), tokens.SPACED)
    h = tokens.hashes(data, starts, ends)
    assert [data[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)] == ["Ab", "ab", "aB", "é", "ÉÉ", "x"]
    assert h[0] == h[1] == h[2] and len(set(h.tolist())) == 4 and first.tolist() == [0, 3, 6]


def test_fingerprints(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in fingerprint.with_next(docs).collect()}
    texts = [t or "" for _, t, *_ in rows]
    assert len(got) == len(rows)
    for k, (doc, *_) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(rows)]
        edit = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.digest(fingerprint.canonical(t)) and r["near_next"] == float(fingerprint.canonical(t) == fingerprint.canonical(following))
        assert r["near_edited"] == float(fingerprint.canonical(t) == fingerprint.canonical(edit))
    groups = defaultdict(list)
    for doc, t, *_ in rows:
        groups[fingerprint.canonical(t or "")].append(doc)
    want = Counter((min(v), len(v)) for v in groups.values())
    assert Counter((r["group_id"], r["group_size"]) for r in fingerprint.exact_groups(docs).collect()) == want
    assert fingerprint.canonical("ＡB  straße\n") == "ab strasse".encode()
    assert fingerprint.with_next(empty).count() == 0 and fingerprint.exact_groups(empty).count() == 0
    odd = spark.createDataFrame([(None, "n"), (5, "a b"), (5, "a b"), (5, None)], "doc_id long, text string")
    assert fingerprint.with_next(odd).count() == 4
    assert fingerprint.with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def brute_hits(text: str | None, items: list[tuple], window: int) -> tuple[int, int, list[str]]:
    w = ALNUM.findall((text or "").translate(LOW))
    hit, found = [False] * len(w), set()
    for key, item in items:
        v = ALNUM.findall((item or "").translate(LOW))
        size = min(window, len(v))
        for k in range(len(v) - size + 1 if v else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == v[k : k + size]:
                    hit[i : i + size] = [True] * size
                    if key is not None:
                        found.add(str(key))
    return len(w), sum(hit), sorted(found)


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_decontamination(spark, docs, rows, empty, block_words):
    source = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(source[0].split()[3:25])), (10, "b"), (2, source[3].upper().replace("É", "é")), (2, "123, 456"), (None, source[5]), (4, None), (5, "!!"), (6, "not there at all")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(docs, table, block_words=block_words).collect()}
    for doc, t, _, n, _ in rows:
        r = got[doc]
        n_words, n_hit, names = brute_hits(t, items, 13)
        assert (r["__n_words"], r["__n_hit"], r["__items"]) == (n_words, n_hit, names), doc
        assert r["__contaminated"] == (n_hit > 0 and 20 * n_hit >= n_words) and r["n_words"] == n
    if block_words > 40:
        assert decontam.decontaminate(empty, table).count() == 0
        assert not decontam.decontaminate(docs, table.limit(0)).filter("__n_hit > 0 OR __contaminated").count()


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/1", "<p>x</p>"), (7, "http://a/7", "<p>x</p>"), (3, None, None), (4, "http://b/\r\n4", ""), (None, "http://c/", "é" * 5000), (9, "u", "WARC/1.1\r\n\r\n\r\n"), (9, "u", "WARC/1.1\r\n\r\n\r\n")],
        "page_id long, url string, html string",
    )
    path = str(tmp_path / "w")
    warc.write_warc(warc.with_revisits(pages), path)
    got = [(r["record_id"], r["warc_type"], r["refers_to"], r["payload_length"], r["payload_digest"], r["payload"]) for r in warc.read_warc(spark, path).collect()]
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    assert ("urn:page:1", "revisit", "urn:page:7", 8, sha(b"<p>x</p>"), None) in got and ("urn:page:7", "response", None, 8, sha(b"<p>x</p>"), bytearray(b"<p>x</p>")) in got
    assert ("urn:page:3", "revisit", "urn:page:4", 0, sha(b""), None) in got and len(got) == 7 and sum(x[0] == "urn:page:9" and x[1] == "response" for x in got) == 2
    plan = warc.read_warc(spark, path, "false").filter("warc_type = 'revisit'")
    assert "Filter (" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 2
    assert warc.read_warc(spark, path, "verify").filter("target_uri LIKE 'http://a%'").count() == 2
    plain = tmp_path / "x.warc"
    plain.write_bytes(warc.record("response", "urn:page:5", "u", None, None, b"abc") + warc.record("metadata", "urn:x", None, None, None, b"m" * 3_000_000) + warc.record("response", "urn:page:6", "u", None, None, b"de"))
    assert sorted(bytes(r["payload"]) for r in warc.read_warc(spark, str(plain)).filter("warc_type = 'response'").collect()) == [b"abc", b"de"]
    import gzip

    foreign = tmp_path / "y.warc.gz"
    foreign.write_bytes(gzip.compress(warc.record("response", "urn:page:5", "u", None, None, b"abc")) + gzip.compress(warc.record("response", "urn:page:6", "u", None, None, b"d" * 100_000)))
    assert sorted(r["payload_length"] for r in warc.read_warc(spark, str(foreign)).collect()) == [3, 100_000]
    none = str(tmp_path / "none")
    warc.write_warc(warc.with_revisits(pages.limit(0)), none)
    assert warc.read_warc(spark, none).count() == 0


def test_warc_writes_add_up(spark, tmp_path):
    """A second write to a folder leaves the first one's records readable."""
    for i in range(2):
        pages = spark.createDataFrame([(i, f"http://h.example/{i}", f"<p>{i}</p>")], "page_id long, url string, html string")
        warc.write_warc(warc.with_revisits(pages), f"file://{tmp_path}/two")
    assert sorted(r["record_id"] for r in warc.read_warc(spark, f"file://{tmp_path}/two").collect()) == ["urn:page:0", "urn:page:1"]


def brute_components(rows: list[tuple], size: int, num: int, den: int) -> dict:
    sets = {}
    for doc, t, *_ in rows:
        w = SPACED.findall((t or "").translate(LOW))
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("cell", [256, 3])
def test_near_duplicates(spark, rows, monkeypatch, cell):
    r = random.Random(5)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    more = list(rows)
    for k in range(40):  # a large group around one text, its members up to several edits apart
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"e{r.randrange(9)}"
        more.append((1000 + k, " ".join(w), None, 0, ""))
    monkeypatch.setattr(neardup, "CELL", cell)
    df = spark.createDataFrame(more, SCHEMA)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(df, shingle=3, num=85, den=100).collect()}
    assert got == brute_components(more, 3, 85, 100)


def test_near_duplicates_edges(spark, empty):
    assert neardup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "A b  c\td e f"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(((x["doc_id"] or -1, x["component_id"] or -1, x["kept"]) for x in neardup.near_duplicates(odd).collect()))
    assert got == [(-1, -1, True), (2, 2, True), (2, 2, True), (3, 3, True), (4, 4, True), (9, 2, False)]


def test_near_duplicates_of_repeated_ids(spark):
    """Rows with one doc_id are one document, with the links of all its texts."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (9, "something else")], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()]
    assert sorted(got) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True)]


def test_sketch_estimates():
    r = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        common, own = r.integers(1, 1 << 62, int(2000 * share)), int(2000 * (1 - share) / 2)
        a = np.unique(np.concatenate((common, r.integers(1, 1 << 62, own)))).astype(np.uint64)
        b = np.unique(np.concatenate((common, r.integers(1, 1 << 62, own)))).astype(np.uint64)
        k = sketch.registers(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        got = sketch.jaccard(k[:1], k[1:], np.array([len(a)]), np.array([len(b)]))[0]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(got - true) < 0.15
        both = sketch.registers(np.union1d(a, b), np.array([0, len(np.union1d(a, b))]))
        assert (both[0] == np.maximum(k[0], k[1])).all()


def test_estimates_drop_fewer_links_than_bands():
    """Registers of sets of equal size as independent draws: below, equal, above."""
    m = sketch.M
    ways = np.array([(u, d) for u in range(m + 1) for d in range(m + 1 - u)])
    a, b = np.zeros((2, len(ways), m), np.int16)
    for i, (u, d) in enumerate(ways):
        a[i, :u] = b[i, u : u + d] = 1
    found = sketch.jaccard(a, b, np.full(len(ways), 100), np.full(len(ways), 100))
    logs = np.array([math.lgamma(i + 1) for i in range(m + 1)])
    for t in (0.85, 0.8):
        p, unequal = float(sketch._p(np.array((1 - t) / 2))), ways.sum(1)
        chance = np.exp(logs[m] - logs[ways[:, 0]] - logs[ways[:, 1]] - logs[m - unequal] + unequal * np.log(p) + (m - unequal) * np.log(1 - 2 * p))
        assert math.isclose(chance.sum(), 1) and chance[found < t - neardup.SLACK].sum() < (1 - t**sketch.ROWS) ** sketch.BANDS


def test_suffix_array():
    r = random.Random(2)
    for _ in range(500):
        s = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 40))] + [0]
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert [sorted(x) for x in suffix.repeated([b"xabcabcx", b"abcd"], 3)] == [[(0, 1), (0, 4), (1, 0)]]


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeated_strings(spark, docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs).collect()}
    seen: set[bytes] = set()
    for doc, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        r = got[doc]
        assert (r["n_bytes"], r["n_removed"], bytes(r["kept"]), len(r["spans"])) == (len(b), sum(gone), kept, sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))), doc


def test_repeated_strings_edges(spark, empty):
    assert suffix.remove_repeats(empty).count() == 0
    long = "".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(100))
    odd = spark.createDataFrame([(1, long), (1, long), (None, long[:150]), (5, "y" * 300)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffix.remove_repeats(odd).collect())
    assert got == [(-1, 0), (1, 150), (1, 150), (5, 299)]


def test_line_dedup(docs, rows, empty, spark):
    got = {r["doc_id"]: r for r in lines.line_dedup(docs).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for doc, t, *_ in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(doc)
    for doc, t, *_ in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < 20 or len(held[key(x)]) < 3 or doc == max(held[key(x)])]
        r = got[doc]
        assert (r["text"], r["__n_lines"], r["__n_dropped"], r["kept"]) == ("\n".join(kept), len(every), len(every) - len(kept), "clash")
    assert lines.line_dedup(empty).count() == 0
    line = "a line of twenty characters"
    odd = spark.createDataFrame([(None, line), (1, line), (1, line), (2, f"{line.upper()}\nx\n  {line}")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["text"], r["__n_dropped"]) for r in lines.line_dedup(odd).collect()) == [(-1, "", 1), (1, "", 1), (1, "", 1), (2, f"{line.upper()}\nx\n  {line}", 0)]


def test_language_id(spark, empty):
    r = random.Random(4)
    make = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["ção", "que", "os", "ão"]}
    said = lambda k: " ".join("".join(r.choice(make[k]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 80)))
    table = [(i, said(k := r.choice(list(make))), k) for i in range(200)] + [(900, None, "aa"), (901, "12 !!", "bb"), (902, said("cc"), None), (None, said("aa"), "aa")]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert all(got[d]["__lang"] == k for d, t, k in table if t and k and d != 901)
    assert got[900]["__lang"] == got[901]["__lang"] == "und" and got[901]["__score"] == 0 and got[902]["__lang"] == "cc"
    assert all(0 <= x["__score"] <= 1 for x in got.values())
    table_ = langid._automaton([1, 2, 1, 3])
    state, phrases = 0, 1
    for c in [1, 2, 1, 1, 3, 2, 4]:  # 121 | 13 | 2 | 4
        state = int(table_[state + c])
        if state < 0:
            state, phrases = ~state, phrases + 1
    assert phrases == 4
    none = langid.train(empty)
    assert langid.identify(df, none).filter("__lang <> 'und'").count() == 0 and langid.identify(empty, model).count() == 0


def test_language_id_of_many_scripts():
    """Languages are told apart by letters that are rare beside those of other scripts and larger alphabets."""
    r = random.Random(6)
    alphabets = {"big": [chr(0x4E00 + i) for i in range(900)], "ja": [chr(0x3041 + i) for i in range(0, 80, 2)], "jb": [chr(0x30A1 + i) for i in range(0, 80, 2)]}
    said = lambda k, n: " ".join("".join(r.choice(alphabets[k]) for _ in range(5)) for _ in range(n))
    model = langid.Model({"big": [said("big", 4000)], "ja": [said("ja", 60)], "jb": [said("jb", 60)]})
    texts = {k: said(k, 40) for k in alphabets}
    assert model.predict(list(texts.values()))[0] == list(texts)
    spelled = [tuple(model.encode(c)) for k in ("ja", "jb") for c in alphabets[k]]
    assert len(set(spelled)) == len(spelled)


def test_language_id_learns_from_all_sampled_texts(spark):
    """A long text of junk does not fill the sample, nor do copies of one text."""
    long, short = "junk " * 20_000, [f"word{'abcdefghij'[i]} lorem ipsum" for i in range(10)]
    said = langid._shared([long, *short], 2000)
    assert len(said) <= 2000 and all(t in said for t in short)
    table = [(i, "one and the same", "aa") for i in range(100)] + [(200 + i, t, "aa") for i, t in enumerate(short)]
    got = langid.sample(spark.createDataFrame(table, "doc_id long, text string, lang string"), "text", "lang", docs=11)
    assert sorted(got["aa"]) == sorted(["one and the same", *short])


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    odd = [(2001, "it's <|endoftext|> don't x y İstanbul ΣΑΣ é ½ ²", None, 0, ""), (2002, "日本語 \x1c a\tb", None, 0, ""), (2003, "word " * 5000, None, 0, "")]
    df = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    pieces = packing.tokenise(df, path, with_ids=True).cache()
    got = defaultdict(list)
    for r in packing.pack(pieces).collect():
        got[r["__doc"]].append(r)
    whole = Tokenizer.from_file(path)
    for doc, t, *_ in rows + odd:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(got[doc], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in own] == [(k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    bins = defaultdict(list)
    for rs in got.values():
        for r in rs:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.tokenise(empty, path)).count() == 0


def test_packing_constraints():
    r = random.Random(1)
    for rule in ("norm", "dot"):
        counts = Counter(r.randint(1, 100) for _ in range(3000))
        plan = packing.Plan(dict(counts), 100, documents=4, cost=6000 if rule == "norm" else None, rule=rule) if max(counts) ** 2 <= 6000 or rule == "dot" else packing.Plan(dict(counts), 100, documents=4, cost=10_000, rule=rule)
        bins = defaultdict(list)
        for length, rank, first, each, offset in plan.runs:
            nxt = min((x[1] for x in plan.runs if x[0] == length and x[1] > rank), default=counts[length])
            for k in range(rank, nxt):
                bins[first + (k - rank) // each].append((offset + (k - rank) % each * length, length))
        assert sum(map(len, bins.values())) == sum(counts.values())
        for x in bins.values():
            assert len(x) <= 4 and sum(b for _, b in x) <= 100 and sum(b * b for _, b in x) <= plan.full[2]
            at = 0
            for offset, length in sorted(x):
                assert offset == at
                at += length


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="site"><h2>Site</h2></header><nav><a href=/>Home</a></nav><div class="cookie-notice"><p>We use cookies</p></div>
<main><article><h1>Title &amp; more</h1><p>One<br>two &eacute;&nbsp;x<p>Three <b>bold</b> text.<!-- gone --><ul><li>First<li>Second</ul><div class="ad-box">Buy</div>
<form><input>Sign</form><table><tr><td>a<td>b</table><section id="comments"><p>Nice!</p></section></article></main>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    assert html.extract(PAGE).split("\n\n") == ["Title & more", "One two é x", "Three bold text.", "First", "Second", "a b"]
    assert html.extract("") == "" and html.extract("plain &lt;text") == "plain <text" and html.extract("<p>a<p") == "a"
    assert html.extract("<body><div class='menu'>m</div><div id=content><p>a long story that goes on</p></div></body>") == "a long story that goes on"
    block = "<section><p>Same on all pages of the host</p></section>"
    pages = [(i, f"http://h.example/{i}", f"<body>{block}<div><p>Own words {i}</p><p>Shared sentence</p></div></body>") for i in range(12)]
    pages += [(50, "http://other.example/", f"<body>{block}</body>"), (51, None, None), (52, "http://h.example/x", "")] + [(60 + i, "http://copies.example/", f"<body>{block}</body>") for i in range(12)]
    got = {r["page_id"]: r["__main"] for r in html.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own words 3" and got[50] == "Same on all pages of the host" and got[51] == got[52] == "" and got[65] == "Same on all pages of the host"


def test_lm(spark, docs, rows, empty):
    train = {doc for doc, *_ in rows if zlib.crc32(str(doc).encode()) % 7 != 2}
    texts = {doc: [*SPACED.findall((t or "").translate(LOW)), None] for doc, t, *_ in rows}
    c = Counter(w for d in train for w in texts[d])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.score(docs, ~langid.held_out("doc_id", 7, 2)).collect()}
    for doc, ws in texts.items():
        r = got[doc]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (doc not in train, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs_tol=1e-6) and r["score"] < 0
    unseen = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert lm.score(empty, ~langid.held_out("doc_id", 7, 2)).count() == 0


def test_lm_is_a_distribution():
    """Probabilities of all known words and the unseen one add up to 1 after any history."""
    r = np.random.default_rng(3)
    w = np.sort(np.unique(r.integers(1, 1 << 62, 300)).astype(np.uint64))
    tail, count = r.integers(0, lm._ENDS, len(w)).astype(np.uint8), r.integers(1, 9, len(w)).astype(np.int64)
    mass = np.bincount(tail[count > 1], count[count > 1] - lm.DISCOUNT, lm._ENDS)
    best = np.argsort(-count, kind="stable")[: lm.TOP]
    stats = lm.Stats(np.array([count.sum(), len(w), (count == 1).sum(), (count == 2).sum(), 5, *mass]), [(int(w[i]), float(count[i]), int(tail[i])) for i in best])
    kind, inner = stats.classes(np.append(w, [np.uint64(5), lm._END]), np.append(tail, [0, 0]).astype(np.uint8), np.append(count, [0, 5]))
    per_class = np.bincount(kind, np.exp(inner), lm.CLASSES)
    used = np.bincount(kind, minlength=lm.CLASSES) > 0
    assert np.allclose(per_class[used], 1)


def test_lm_words_follow_history(spark):
    """Two words that are seen equally often and end alike (one class) are told apart by the word before them."""
    common = " ".join(f"c{i}" * 2 for i in range(12))
    train = [(i, f"{common} {common} left stone {common} right phone {common}") for i in range(60)]
    asked = [(100 + i, f"{common} {x} {common}") for i, x in enumerate(("left stone", "left phone", "right phone", "right stone"))]
    df = spark.createDataFrame(train + asked, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(df, lm.F.col("doc_id") < 100).collect()}
    assert got[100] > got[101] + 0.01 and got[102] > got[103] + 0.01


def test_lm_tree_is_a_distribution():
    """By the tree, words of each class add up to 1 with any weights, and have their count shares with none."""
    r = np.random.default_rng(5)
    w = np.sort(np.unique(r.integers(1, 1 << 64, 400, dtype=np.uint64)))
    tails, counts = r.integers(0, 3, len(w)).astype(np.uint8), r.integers(2, 9, len(w)).astype(np.int64)
    shard, runs, ranks = (w >> np.uint64(62)).astype(np.int64), [], np.zeros(len(w), np.int64)
    for s in range(4):
        groups = defaultdict(list)
        for i in np.flatnonzero(shard == s).tolist():
            groups[int(tails[i]), int(counts[i])].append(i)
        for many in groups.values():
            ranks[many] = range(len(many))
        runs.append((s, *(np.array(x, np.int64) for x in zip(*((t, c, len(x)) for (t, c), x in groups.items()), strict=True))))
    best = sorted(range(len(w)), key=lambda i: (-counts[i], w[i]))[: lm.TOP]
    tree = lm.Tree(runs, [(int(w[i]), float(counts[i]), int(tails[i])) for i in best], 2)
    rest = np.setdiff1d(np.arange(len(w)), best)
    start, depth, node, bias, right = tree.paths(w[rest], tails[rest], counts[rest], ranks[rest])
    of = np.repeat(np.arange(len(rest)), depth)
    own = r.normal(size=tree.size)
    mass = np.bincount(tails[rest], counts[rest] - lm.DISCOUNT)
    for z, trained in ((bias.astype(float), False), (bias + own[node], True)):
        p = np.exp(np.bincount(of, -np.logaddexp(0, np.where(right, -z, z)), len(rest)))
        assert np.allclose(np.bincount(tails[rest], p), 1)
        assert np.allclose(p, (counts[rest] - lm.DISCOUNT) / mass[tails[rest]], rtol=1e-4) != trained
