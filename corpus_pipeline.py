"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept.  All but the last return
documents with their columns as they came; the last returns packed windows of token ids.  Stages cut their lineage
in the folder of ``spark.checkpoint.dir``, where ``run`` also puts the tables between stages; each is deleted when the
next one is written, the last when the driver's Python ends.

In every stage: rows with a NULL id or a NULL text are kept (NULL texts have no tokens, so the last stage leaves them
out), extra columns may have any names and kinds, ids are integers of any width, texts are worked on whole however long
they are, and an empty table gives an empty one.  Rows that repeat an id are judged by their own texts, and go together
where a stage names ids: near dedup and decontamination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, exact, minhash, packing, toxicity
from graphloom.llm.common import forget, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, fitted on the labels, rejects.  Empty texts stay; a score at the threshold is rejected."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, empty ones too, keep that of the smallest id, of repeated rows one; an id comes before none."""
    return exact.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts keep that of the smallest id.  Texts without words are similar to none."""
    return minhash.keep_one_of_group(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that have a test item in them.  Items without an id or a text are none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in windows; a document without an id is packed under a NULL one."""
    return packing.pack_online(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Near copies and a fitted classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the windows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        after = table(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        docs = before = after
    return docs
