"""From raw documents to packed training sequences.

Each stage works on all that the one before it kept; its result is written to the shared
folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridvigil.llm import jaccard, leaks, packing, repetition, secrets
from gridvigil.llm.common import folders_made, remove_since, stored, table
from gridvigil.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked shingle sets."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets hidden in their texts."""
    return secrets.redact(docs, secrets.own_model())


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in the packed sequences."""
    pieces = packing.pack(docs, vocabulary())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packed_sequences", packed_sequences),
]

#: Spark's bound on an Arrow batch, and its value while the stages run; the default, by rows alone,
#: holds 10 000 texts on both sides of each task's pipe
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: no SQL for the fitted models, the tokenizer and the packing; see tests/llm/test_corpus_jobs.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``.

    A stage's tables, and its input, are deleted when its result is stored. Executors live through
    all stages, so batches on their way to Python are kept small meanwhile.
    """
    docs = table(spark, sf_dir, "documents")
    start = folders_made()
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name)
            remove_since(spark, start)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
