"""A corpus pipeline out of the operators of ``topspin.llm``: from raw documents to encoded ones.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the columns
of ``documents``; ``n_chars`` follows the text where a stage changes it. Rows with a null id can't be told apart, so the
stages that decide by id keep them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topspin.llm import bpe, decontamination, quality, simhash, substrings
from topspin.llm.shared import materialise, table

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None
#: A name that no column of documents has.
ROW = "near_dedup_row"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents that are still there."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("predicted") == 1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Different texts under one id are documents of their own: rows are told apart by the id and a 64-bit hash of the text.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("hash")))
    keyed = docs.withColumn(ROW, row)
    found = simhash.near_duplicates(keyed, id_column=ROW)
    gone = materialise(found.where(F.col(ROW) != F.col("component_id")).select(ROW).distinct())
    kept = keyed.where(F.col("doc_id").isNotNull()).join(gone, ROW, "left_anti").dropDuplicates([ROW])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out of all documents but the first; a document of nothing else is left with an empty text."""
    return substrings.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go."""
    found = materialise(decontamination.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens, and the digests of ids and decoded text."""
    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
