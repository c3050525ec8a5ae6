"""Fill-in-middle against regular expressions over whole texts, and the index at every spacing."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import infill


def units_of(text: str, unit: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)


def drawn(r: random.Random, n: int) -> str:
    return "".join(r.choice("ab é€𝄞\n\n<PSM>\r\x85 ") for _ in range(n))


@pytest.mark.parametrize("unit", ["line", "char"])
def test_index(unit, monkeypatch):
    """Cuts at all units, whatever the spacing of checkpoints and the size of what is scanned at a time."""
    r = random.Random(3)
    for scan in (5, 64, 1 << 20):
        monkeypatch.setattr(infill, "SCAN", scan)
        for text in ["", "\n", "a", "a\n", "\n\na", *(drawn(r, r.randint(1, 60)) for _ in range(60))]:
            want = units_of(text, unit)
            for every in (1, 2, 7, 64):
                index = infill.Index.of(np.frombuffer(text.encode(), np.uint8), unit, every)
                assert index.n == len(want)
                assert len(index.units) <= len(want) // every + 2
                for k in range(len(want) + 1):
                    head = "".join(want[:k])
                    assert index.cut(k) == (len(head.encode()), len(head))


def plain_transform(text: str, doc: str, rate: int = 100, spm: int = 50, unit: str = "line"):
    units = units_of(text, unit)
    h = [int(hashlib.sha256(f"7:{doc}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return text, len(units), "plain", None, None
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return f"<S>{s}<P>{p}<M>{m}", len(units), "spm", len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", len(units), "psm", len(p), len(m)


@pytest.mark.parametrize(("rate", "spm", "unit", "every"), [(100, 50, "line", 64), (60, 0, "line", 2), (100, 100, "char", 3)])
def test_fill_in_middle(spark, rate, spm, unit, every):
    """Outputs of plain Python; nulls, empty texts, sentinels, repeated rows and columns of clashing names; a round trip."""
    r = random.Random(4)
    rows = [(i, drawn(r, r.randint(0, 300)), "x") for i in range(150)]
    rows += [(500, None, "n"), (501, "", "e"), (None, "a\nb\nc", "i"), (502, "one <M> two\n", "s"), (3, "again\nand again\n", "r"), (3, "again\nand again\n", "r"), (503, "long line " * 20000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    found = infill.fill_in_middle(df, rate=rate, spm=spm, unit=unit, every=every).withColumn("back", infill.restored(F.col("__output"), F.col("__form"))).collect()
    got = sorted((repr((x["doc_id"], x["text"], x["form"])), x["__output"], x["__n"], x["__form"], x["__prefix_chars"], x["__middle_chars"]) for x in found)
    want = sorted((repr(row), *plain_transform(row[1] or "", "" if row[0] is None else str(row[0]), rate, spm, unit)) for row in rows)
    assert got == want
    assert all(x["back"] == (x["text"] or "") for x in found)
    assert len({x["__form"] for x in found}) > 1
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_unit_names(spark):
    with pytest.raises(ValueError):
        infill.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string"), unit="page")
