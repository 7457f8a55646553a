"""Operator 3, exact deduplication: 128-bit content hash, smallest stable id, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import content_hash, cut, pick_documents


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, n_copies)`` for each document that has copies: the smallest id with the same bytes, and how
    many documents have them (itself among them).

    Documents are grouped by hash and bytes together, so texts that only share a hash stay apart.  The grouping
    combines copies before the shuffle: thousands of copies of one text cost as much as one per task.

    NULL texts and ids: a NULL text is nobody's copy; rows with a NULL id count as copies but are not listed, and
    ``keep_id`` is the smallest non-NULL id.  Empty texts are copies of each
    other.  A repeated row counts as a copy of itself and is listed as often as it comes.  Very long texts are compared
    whole.  Ids are integers of any width.
    """
    docs = pick_documents(docs)
    groups = (
        docs.filter(F.col("text").isNotNull())
        .groupBy(content_hash(F.col("text")).alias("h"), "text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    by_hash = cut(
        groups.groupBy("h").agg(
            F.min("keep_id").alias("keep_id"), F.max("n_copies").alias("n_copies"), F.count(F.lit(1)).alias("n_texts")
        )
    )
    shared = by_hash.filter("n_texts > 1").select("h")
    listed = docs.filter(F.col("doc_id").isNotNull())
    some = listed.filter(F.col("text").isNotNull())
    result = (
        some.select("doc_id", content_hash(F.col("text")).alias("h"))
        .join(by_hash.filter("n_texts = 1 AND n_copies > 1"), "h")
        .select("doc_id", "keep_id", "n_copies")
    )
    if shared.take(1):  # texts with the same hash: only these meet again, with their bytes
        rows = some.withColumn("h", content_hash(F.col("text"))).join(shared, "h", "left_semi")
        texts = groups.filter("n_copies > 1").join(shared, "h", "left_semi")
        result = result.unionByName(rows.join(texts, ["h", "text"]).select("doc_id", "keep_id", "n_copies"))
    return result


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The documents with one row for each distinct text: that with the smallest id; all columns are kept.

    NULL ids are larger than any id, rows with equal ids are ordered by their other columns, columns that have no order,
    such as maps, by their JSON.  Rows with a NULL text are all kept.  Empty texts are equal; very long ones are compared
    byte by byte as any other.
    """
    pick_documents(docs)
    columns = docs.columns
    rest = [c for c in columns if c not in ("doc_id", "text")]
    values = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    kinds = [docs.schema[c].dataType.simpleString() for c in rest]
    ordered = [F.to_json(F.struct(v)).alias(f"c{i}") if any(k in kind for k in ("map<", "variant", "interval")) else v for i, (v, kind) in enumerate(zip(values, kinds, strict=True))]
    head = (F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))
    least = F.min_by(F.struct(*head, *values), F.struct(*head, *ordered)) if any(o is not v for o, v in zip(ordered, values, strict=True)) else F.min(F.struct(*head, *values))
    some = docs.filter(F.col("text").isNotNull())
    kept = some.groupBy(content_hash(F.col("text")).alias("__h"), F.col("text").alias("__text")).agg(least.alias("__first"))
    place = {"doc_id": F.col("__first.doc_id"), "text": F.col("__text")} | {c: F.col(f"__first.c{i}") for i, c in enumerate(rest)}
    return kept.select(*[place[c].alias(c) for c in columns]).unionByName(docs.filter(F.col("text").isNull()))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
SELECT doc_id, keep_id, n_copies FROM (
  SELECT doc_id,
         MIN(doc_id) OVER (PARTITION BY text) AS keep_id,
         COUNT(*) OVER (PARTITION BY text) AS n_copies
  FROM documents WHERE text IS NOT NULL)
WHERE n_copies > 1 AND doc_id IS NOT NULL
"""
