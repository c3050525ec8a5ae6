"""Cross-parsing against phrases found by substring search, and the cases that the docstring defines."""

from __future__ import annotations

import pickle
import random

import numpy as np

from lodestrata.llm import langid


def said(r: random.Random, letters: str, n: int) -> str:
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(40)]
    return " ".join(r.choice(words) for _ in range(n))


def phrases(sample: str, text: str) -> int:
    n, now = 1, ""
    for c in text:
        if now + c in sample:
            now += c
        else:
            n, now = n + 1, c if c in sample else ""
    return n


def test_phrases_by_substring_search():
    """Whole texts, far longer than a lane, with long repeats and letters that no sample has."""
    r = random.Random(1)
    model = langid.Model({"a": [said(r, "abcdefg", 300), "a" * 700], "b": [said(r, "abcxyzw", 300)]})
    model = pickle.loads(pickle.dumps(model))
    texts = [said(r, "abcdefgxyzwq", n) for n in (1, 3, 30, 200, 700)] + ["a" * 3000, "abc " * 700, "q" * 600, said(r, "abcdefg", 900), model.texts[1][100:2000] * 2]
    codes = [model.encode(t) for t in texts]
    assert max(map(len, codes)) > 8 * langid.LANE
    got = model.entropies(codes)
    for k, sample in enumerate(model.texts):
        spelled = bytes(model.encode(sample).tolist()).decode("latin-1")
        want = [phrases(spelled, bytes(c.tolist()).decode("latin-1")) * model.weights[k] / max(1, len(c)) for c in codes]
        assert np.allclose(got[:, k], want)


def test_language_cases(spark):
    """Repeated rows, a very long text, columns of clashing names, and more languages than the sample has room for."""
    r = random.Random(2)
    letters = {f"l{k:02d}": "".join(chr(0x4E00 + 12 * k + i) for i in range(12)) for k in range(20)}
    rows = [(i, said(r, letters[f"l{i % 20:02d}"], 30), f"l{i % 20:02d}", "x", 1) for i in range(100)]
    rows += [(500, said(r, letters["l07"], 30_000), None, "x", 1)] + [(501, rows[3][1], None, "x", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, text_ string, score int")
    model = langid.Model(langid.sample(df, "text", "lang", docs=3), total=8_000)
    assert len(model.names) == 20 and all(len(t) <= 400 for t in model.texts)
    found = langid.identify(df, model)
    assert found.columns == [*df.columns, "__lang", "__score"]
    got = [(x["doc_id"], x["__lang"]) for x in found.collect()]
    assert sorted(got) == sorted((i, k or {500: "l07", 501: "l03"}[i]) for i, _, k, *_ in rows)
