"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Every stage works on all that its predecessor kept.  All but the last return the columns
of ``documents``; the last returns one row a packed piece.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import core, decontamination, language_id, packing, queries, secret_scan, simhash_copies


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which a learned language has the larger part; texts without letters go."""
    return language_id.identified(docs, language_id.fit(docs.where(~language_id.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by 5-word shingles of Jaccard similarity 0.8 or more.

    SimHash fingerprints propose, by cells of nearest pivots and tables of pivot distances; the
    real shingles of what they propose are compared.
    """
    return simhash_copies.drop_near_copies(docs, shingle=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark passage."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark; every document stays."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens: one row a piece."""
    return packing.best_fit_packing(docs, queries.tokenizer_path(), capacity=2048, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("secret_scan", secrets),
    ("best_fit_packing", packed),
]

#: Learned mixtures, fingerprint components and the tokenizer are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = core.documents(spark, sf_dir), f"{core.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
