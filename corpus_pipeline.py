"""The corpus pipeline: five stages over `documents`, each written and read again.

Each stage takes all that the one before kept and returns the columns of
documents, but for the last, which returns sampled piece ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strandwise.llm import decontaminate, piece_sampling, quality_model, secret_scan, simhash
from strandwise.llm.common import shared_folder, table


#: Texts, and bytes of them, that a Python worker gets at once, and the settings that say so.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_model.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds; no document goes."""
    return secret_scan.redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as sampled piece ids that decode to it."""
    return piece_sampling.encode_texts(docs)


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, in a session whose Python workers get no more than BATCH_ROWS texts or BATCH_BYTES at once.

    A stage's plan runs after it returns, so the session keeps the settings;
    run() puts back those of before.
    """

    @wraps(stage)
    def held(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(ROWS))
        spark.conf.set(ROWS, str(min(BATCH_ROWS, rows) if rows > 0 else BATCH_ROWS))
        spark.conf.set(BYTES, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return held


STAGES = [
    ("quality_classifier", _bounded(quality)),
    ("simhash_near_dedup", _bounded(near_duplicates)),
    ("benchmark_decontamination", _bounded(decontamination)),
    ("secret_scan", _bounded(secrets)),
    ("sentencepiece", _bounded(pieces)),
]

#: SQL can't express the trained classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key) for key in (ROWS, BYTES)}
    try:
        for k, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return docs
