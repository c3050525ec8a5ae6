"""Levenshtein automata against the plain recurrence, contexts, and a model of planted terms."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestrata.llm import toxicity


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automata():
    """All terms within the errors that they allow, and the first of the nearest."""
    r = random.Random(5)
    terms = list(dict.fromkeys("".join(r.choice("abc") for _ in range(r.randint(4, 9))) for _ in range(60)))
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 12))) for _ in range(800)] + ["", "x" * 100, terms[0], "é𝄞ab"]
    trie = toxicity.Trie(terms)
    want = {(w, t): d for w, word in enumerate(words) for t, term in enumerate(terms) if (d := distance(word, term)) <= trie.most[t] and toxicity.SHORTEST - 2 <= len(word)}
    got = {(int(w), t): d for who, t, d in trie.near(words) for w in who}
    assert got == want
    term, errors = trie.nearest(words)
    for w in range(len(words)):
        near = sorted((d, t) for (i, t), d in want.items() if i == w)
        assert (errors[w], term[w]) == near[0] if near else term[w] == -1
    few = toxicity.Trie(terms, [-1 if i % 2 else 0 for i in range(len(terms))])
    assert {(int(w), t): d for who, t, d in few.near(words) for w in who} == {(w, t): 0 for (w, t), d in want.items() if d == 0 and t % 2 == 0}
    assert toxicity.Trie([]).nearest(["word"])[0].tolist() == [-1]


@pytest.mark.parametrize(
    ("token", "want"),
    [("idiot!!", ["idiot"]), ("1d10t", ["idiot"]), ("idiooooot", ["idiot"]), ("***", []), ("2024", []), ("fool-like", ["fool", "like", "fool-like"]), ("st*pid", ["st", "pid", "st*pid"]), ("a", [])],
)
def test_spellings(token, want):
    assert toxicity.spellings(token) == want


@pytest.mark.parametrize(
    ("text", "at", "want"),
    [("he is an idiot today", 3, 0.0), ('the note "you are an idiot" was read', 5, 1.0), ("a 'fool' here", 1, 1.0), ('"yes" you fool and "no"', 2, 0.0), ("he said fool", 2, 0.5), ("« le sot » ici", 2, 1.0)],
)
def test_quotation(text, at, want):
    assert toxicity.quotation(text.split(), at) == want


TERMS = ["blockhead", "nitwit", "dunce"]


def planted(r: random.Random, bad: bool, word: str | None = None) -> str:
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(10, 60))]
    if bad:
        for _ in range(r.randint(1, 3)):
            words.insert(r.randrange(len(words)), word or r.choice(TERMS))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    return [(i, planted(r, i % 5 == 0), "x") for i in range(600)], [(i, int(i % 5 == 0)) for i in range(500)]


def test_model(spark, corpus):
    """Held-out labels, misspelled terms, quotations; nulls, repeated rows, clashing names; empty tables."""
    texts, marks = corpus
    r = random.Random(7)
    extra = [(1000, "you are a bl0ckhead", "x"), (1001, planted(r, True, "nitwlt"), "x"), (1002, None, "x"), (1003, "", "x"), (None, "what a dunce", "x"), (1004, 'the word "dunce" was read', "x"), (7, texts[7][1], "x"), (1005, planted(r, True, "d" + "unce!" * 1), "x")]
    docs = spark.createDataFrame(texts + extra, "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([*marks, (0, 1), (3, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert set(model.terms) == set(TERMS)
    found = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    assert len(found) == len(texts) + len(extra) - 1
    wrong = [i for i, _, _ in texts if (found[i]["__score"] >= 0.3) != (i % 5 == 0)]
    assert len(wrong) <= 3 and all(i % 5 for i in wrong)  # random words come near a term by chance
    assert all(found[k]["__score"] >= 0.3 for k in (1000, 1001, None, 1005))
    assert all(found[k]["__score"] < 0.3 for k in (1002, 1003, 1004))
    assert found[1000]["__terms"] == ["bl0ckhead"] and found[1002]["__terms"] == []
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).filter("__score <> 0").count() == 0


def test_held_out_labels_are_not_learned(spark, corpus):
    """Turning the labels of the held-out fold round changes nothing."""
    texts, marks = corpus
    docs = spark.createDataFrame(texts, "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id", 4, 2), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a.terms == b.terms and np.array_equal(a.weights, b.weights) and np.array_equal(a.beta, b.beta)


def test_long_text(monkeypatch):
    """Pieces of a long text end between words and are learned one by one."""
    monkeypatch.setattr(toxicity, "PIECE", 50)
    monkeypatch.setattr(toxicity, "WINDOW", 0)  # windows end with their piece
    monkeypatch.setattr(toxicity, "REPORTS", frozenset())
    model = toxicity.Model(["dunce"], np.array([[5.0, 3.0, 0.0]]), {})
    text = "some quiet words " * 30 + "dunce" + " and more of them" * 30 + " dunse " + "x" * 500
    (features, found), (whole, _) = model.read([text]).__next__(), toxicity.Model(["dunce"], np.array([[5.0, 3.0, 0.0]]), {}).features([text.split()])
    assert found == {"dunce": 5.0, "dunse": 3.0} and features == whole
    monkeypatch.setattr(toxicity, "KNOWN", 3)
    assert model.features([["dunse", "x", "dunce"]])[1] == {"dunse": 3.0, "dunce": 5.0}
