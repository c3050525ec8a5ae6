"""Line dedup with DataFrame functions only.

Normalised lines are exploded and hashed to 128 bits, distinct documents are counted for each hash, lines over the
threshold go from all documents but one, and what is left is put together by position. No Python runs on executors.

Defined cases: a null or empty text is one empty line and stays an empty text; keys shorter than `min_chars` never
drop; rows with the same doc_id count as one document; a null doc_id is a document below all others; repeated rows are
treated alike; all other columns pass through unchanged, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_dedup(df: DataFrame, text: str = "text", doc: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """df with `text` cut to the lines that stay, and columns __n_lines, __n_dropped.

    A key of at least `min_chars` code points in at least `min_docs` documents keeps its lines only in the largest doc.
    """
    base = df.withColumns({"__text": text_or_empty(text), "__doc": F.col(doc)}).withColumn("__at", F.xxhash64("__text"))
    keys = (
        base.select("__doc", "__at", F.posexplode(_lines(F.col("__text"))).alias("__pos", "__line"))
        .withColumn("__key", line_key(F.col("__line")))
        .filter(F.length("__key") >= min_chars)
        .select("__doc", "__at", "__pos", F.xxhash64("__key").alias("__k1"), F.xxhash64(F.lit("line"), "__key").alias("__k2"))
    )
    often = cut(
        keys.select("__k1", "__k2", "__doc")
        .distinct()
        .groupBy("__k1", "__k2")
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__doc").alias("__last"))
        .filter((F.col("__n") >= min_docs) & F.col("__last").isNotNull())
        .select("__k1", "__k2", "__last")
    )
    gone = (
        keys.join(often, ["__k1", "__k2"])
        .filter(~F.col("__doc").eqNullSafe(F.col("__last")))
        .select(F.col("__doc").alias("__d"), F.col("__at").alias("__a"), "__pos")
        .distinct()
        .groupBy("__d", "__a")
        .agg(F.collect_list("__pos").alias("__gone"))
    )
    both = base.join(gone, base["__doc"].eqNullSafe(gone["__d"]) & (base["__at"] == gone["__a"]), "left").drop("__d", "__a")
    lines = _lines(F.col("__text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(
        F.array_join(F.transform(F.array_sort(stay), lambda i: F.get(F.col("__all"), i)), "\n")
    )
    out = both.withColumn("__all", lines).withColumns(
        {"__kept": kept, "__n_lines": F.size("__all").cast("long"), "__n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}
    )
    names = [F.col("__kept").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    return out.select(*names, "__n_lines", "__n_dropped")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (o.k IS NOT NULL AND doc_id <> o.last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (o.k IS NULL OR doc_id = o.last), '')) AS kept_sha256
FROM keyed LEFT JOIN often o USING (k) GROUP BY doc_id
"""
