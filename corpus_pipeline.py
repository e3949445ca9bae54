"""A training corpus from raw documents, in five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm import packing, quality_rules, secret_scan, simhash_dedup, substring_dedup
from rasterlake.llm.common import documents, drop_folder, ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or are depleted by their host's frequent lines go; those lines go from the others."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document with the smallest doc_id stays."""
    return simhash_dedup.keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; a document that loses every word goes."""
    return substring_dedup.remove_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("secret_scan", secrets),
    ("best_fit_packing", packed),
]

#: The SimHash stage needs XXH64 and the packing stage a tokenizer, which SQL has not; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What they write goes to the folder of spark.checkpoint.dir; a stage's input goes when its output is there."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
