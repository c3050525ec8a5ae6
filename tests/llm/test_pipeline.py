"""The corpus pipeline on a small table with clashing extra columns."""

from __future__ import annotations

import random

import corpus_pipeline
from lodestrata.llm.packing import default_tokenizer


def test_pipeline(spark, tmp_path):
    words = lambda k, n: " ".join(random.Random(k * 1000 + i).choice("abcdefgh") * 3 + chr(97 + (i * k) % 26) for i in range(n))
    line = "Licensed under the Apache License, Version 2.0."
    secret = words(11, 40)
    docs = [(i, f"{words(i + 2, 60)}\n{line}", "en", "s", 9, "lost", 1) for i in range(8)]
    docs += [(20, docs[0][1], "en", "s", 9, "copy", 1), (21, None, "en", "s", 0, "null", 1), (22, "12345", "en", "s", 5, "und", 1), (23, secret, "en", "s", 9, "bench", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __text string, __kept int"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, secret)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path)).cache()
        seen[name] = {r["doc_id"]: r for r in table.collect()}
        if name != "best_fit_packing":
            assert table.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert set(seen["language_id"]) == {*range(8), 20, 23}
    assert line not in seen["line_dedup"][3]["text"] and line in seen["line_dedup"][20]["text"] and seen["line_dedup"][3]["n_chars"] == len(seen["line_dedup"][3]["text"])
    assert set(seen["near_dedup"]) == {*range(8), 23} and set(seen["decontamination"]) == set(range(8)) == set(seen["best_fit_packing"])
    assert default_tokenizer()


def test_run_on_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
