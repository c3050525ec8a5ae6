"""The corpus pipeline: stages that each call one of the text operators.

Every stage is a function of (spark, docs, sf_dir); it works on all documents that the stage before it kept. All but the
last return the columns of `documents` (doc_id, text, lang, source, n_chars). Near
duplicates are told by five-word shingles and a similarity of 0.8.

Cases: an empty table gives an empty result of the same columns; null texts have no letter and go in the first stage;
extra columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import decontam, langid, lines, neardup, packing
from lodestrata.llm.common import stage as staged


def _wrapped(docs: DataFrame) -> DataFrame:
    """Each document as one struct, beside the columns that operators read: no other column can clash with theirs."""
    read = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__document"), *read)


def _unwrapped(found: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs again; changed: expressions for some of them."""
    return found.select(*(changed.get(c, F.col(f"__document.`{c}`")).alias(c) for c in docs.columns))


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those without a letter go."""
    found = langid.identify(_wrapped(docs), langid.train(docs.select("doc_id", "text", "lang")), keep=["__document"])
    return _unwrapped(found.filter(F.col("__lang") != "und"), docs)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; n_chars follows the text. Those that lose all text go."""
    out = lines.line_dedup(_wrapped(docs)).filter((F.col("__n_dropped") == 0) | F.col("text").rlike(r"\S"))
    same = F.col("__n_dropped") == 0
    changed = {"text": F.when(same, F.col("__document.text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, F.col("__document.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return _unwrapped(out, docs, **changed)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id; of repeated rows, one."""
    kept = neardup.near_duplicates(docs.select("doc_id", "text"), shingle=5, num=80, den=100).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    rows = _wrapped(docs)
    named = rows.join(kept, rows["doc_id"] == kept["__kept"], "left_semi").dropDuplicates(["doc_id", "text"])
    return _unwrapped(named.unionByName(rows.filter("doc_id IS NULL")), docs)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's passages do not contaminate."""
    found = decontam.decontaminate(_wrapped(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["__document"])
    return _unwrapped(found.filter(~F.col("__contaminated")), docs)


def best_fit_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    pieces = staged(packing.tokenise(docs.select("doc_id", "text"), packing.default_tokenizer()), "pieces")
    return packing.pack(pieces).select(F.col("__doc").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express language ID or packing.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
