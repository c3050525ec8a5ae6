"""What training adds to the language model, and the cases that its docstring defines."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import lm


def corpus(n: int, seed: int) -> list[str]:
    """Texts in which each word depends on the two before it."""
    r = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ri") for b in ("sta", "ven", "dor", "lin", "gra", "tos", "mer", "qui")]
    follow = {(a, b): random.Random(f"{a}{b}").sample(words, 3) for a in words for b in words}
    out = []
    for _ in range(n):
        text = [r.choice(words), r.choice(words)]
        for _ in range(r.randint(20, 60)):
            text.append(r.choice(follow[text[-2][:2] + "sta", text[-1]]) if r.random() < 0.9 else f"odd{r.randrange(10**6)}")
            text[-1] = text[-1] if (text[-2][:2] + "sta", text[-1]) in follow else r.choice(words)
        out.append(" ".join(text))
    return out


def test_training_beats_shares(spark, monkeypatch):
    """On texts that are held out: trained weights against zero weights, which leave the classes' and words' count shares."""
    df = spark.createDataFrame(list(enumerate(corpus(1500, 1))), "doc_id long, text string").repartition(3)
    train = F.col("doc_id") >= 300
    mean = lambda: lm.score(df, train).filter("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("m"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).first()
    trained = mean()
    monkeypatch.setattr(lm, "ROUNDS", 0)
    assert trained["m"] > mean()["m"] + 0.1 and trained["m"] > trained["b"] + 0.1


def test_unseen_words_have_the_estimated_mass():
    count = np.array([1] * 30 + [2] * 5 + [9] * 10)
    stats = lm.Stats(np.array([count.sum(), len(count), 30, 5, 4, *np.zeros(lm._ENDS)]), [])
    assert math.isclose(stats.unseen, 31 / 42)
    assert lm.Stats(np.array([9, 1, 0, 0, 4, *np.zeros(lm._ENDS)]), []).unseen == 1.0
    w, spell = np.array([5, 6], np.uint64), np.array([-20.0, -9.0], np.float32)
    _, inner = stats.classes(w, np.zeros(2, np.uint8), np.array([0, 1]), spell)
    assert math.isclose(inner[0], math.log(31 / 42) - 20) and math.isclose(inner[1], math.log(11 / 42 / 30))


def test_blocks_name_decisions():
    """Decisions of one node have one name, those of different nodes of a tree different ones."""
    r = np.random.default_rng(2)
    counts, w = r.integers(2, 6, 300).astype(np.int64), np.sort(r.integers(1, 1 << 62, 300).astype(np.uint64))
    groups = {c: np.flatnonzero(counts == c) for c in np.unique(counts)}
    ranks = np.zeros(300, np.int64)
    for many in groups.values():
        ranks[many] = range(len(many))
    runs = [(0, *(np.array(x, np.int64) for x in zip(*((0, c, len(x)) for c, x in groups.items()), strict=True)))]
    start, depth, node, _, right = lm.Tree(runs, [], 0).paths(w, np.zeros(300, np.uint8), counts, ranks)
    name = lm._blocked(node, right, start, depth)
    assert ((name & 1) == right).all() and ((name >> 1 & (lm.LINE - 1)) > 0).all()
    pairs = set(zip(node.tolist(), (name >> 1).tolist(), strict=True))
    assert len(pairs) == len(set(node.tolist())) == len({x for _, x in pairs}) == 299


def test_lm_cases(spark):
    """Null doc_ids and texts, repeated rows, a very long text, columns of clashing names; nothing to learn from."""
    rows = [(1, "a b a", 1), (1, "a b a", 1), (None, "a c", 2), (3, None, 3), (4, "a b " * 60_000, 4), (5, "x a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted(((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"]) for r in lm.score(df, F.col("doc_id") != 5).collect()))
    assert got == [(0, False, 3, 3), (1, False, 4, 4), (1, False, 4, 4), (3, False, 1, 1), (4, False, 120_001, 120_001), (5, True, 3, 2)]
    none = lm.score(df, F.lit(False)).collect()
    assert len(none) == 6 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isclose(r["base_score"], 0) and math.isfinite(r["score"]) for r in none)


def test_spelling_is_a_distribution():
    """The probabilities of all words of up to some length, and of longer ones by what is left, are 1."""
    r = np.random.default_rng(3)
    counts = r.integers(0, 5, (lm._EDGE + 1, lm._EDGE + 1)) + 0.5
    counts[lm._EDGE, lm._EDGE] = 0
    with np.errstate(divide="ignore"):
        table = np.log(counts / counts.sum(1, keepdims=True))
    one = np.array([[b] for b in range(256) if not 65 <= b <= 90], np.uint8)
    data = one.ravel()
    at = np.arange(len(data))
    singles = np.exp(lm.spelled(table, data, at, at + 1))
    want = np.exp(table[lm._EDGE, data] + table[data, lm._EDGE])
    assert np.allclose(singles, want)
    words = [b"ab", b"Ba", b"a", b"\xc3\xa9x"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts = np.array([0, 3, 6, 8])
    got = lm.spelled(table, data, starts, starts + [2, 2, 1, 3])
    for w, x in zip(words, got, strict=True):
        path = [lm._EDGE, *w.lower(), lm._EDGE]
        assert math.isclose(x, sum(table[a, b] for a, b in zip(path, path[1:])), rel_tol=1e-5)  # noqa: B905


def test_unknown_words_cost_their_letters(spark):
    """Log probabilities a token fall with the share of unknown words; random letters are below every real text, and unknown
    words that are spelled like known ones above them."""
    texts = corpus(800, 4)
    r = random.Random(5)
    noise = lambda n: " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(4, 9))) for _ in range(n))
    like = lambda n: " ".join(r.choice(("kalo", "mipe", "rinu")) + r.choice(("sta", "ven", "dor")) + r.choice(("lin", "gra")) for _ in range(n))
    held = [(10_000 + i, t) for i, t in enumerate(texts[:20])] + [(20_000 + i, noise(40)) for i in range(10)] + [(30_000 + i, like(40)) for i in range(10)]
    held += [(40_000 + 10 * k + i, " ".join(texts[i].split()[: 40 - 4 * k] + noise(4 * k).split())) for k in range(10) for i in range(5)]
    df = spark.createDataFrame([*enumerate(texts[20:]), *held], "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["score"] / x["n_tokens"] for x in lm.score(df, F.col("doc_id") < 10_000).collect()}
    real, junk, alike = ([got[i] for i in range(lo, lo + n)] for lo, n in ((10_000, 20), (20_000, 10), (30_000, 10)))
    assert max(junk) < min(real) - 1 and max(junk) < min(alike) and max(alike) < min(real)
    for i in range(5):
        falls = [got[40_000 + 10 * k + i] for k in range(10)]
        assert all(a > b for a, b in zip(falls, falls[1:]))  # noqa: B905
    assert math.isfinite(sum(got.values()))
