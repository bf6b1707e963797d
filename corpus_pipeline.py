"""From raw documents to packed training sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir), with the rows that its predecessor wrote,
and returns the next table. All but the last keep the columns of ``documents``:

* quality_rules: rows that fail the rules go (operator 7).
* near_dedup: one document of each near-duplicate group stays (operator 1, at a similarity of 0.8).
* decontamination: documents that hold a benchmark passage go (operator 2).
* secret_scan: secrets are masked in the text; no document goes (operator 9).
* packing: the remaining documents as packed pieces (operator 4).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lapsekit.llm.op1_minhash import keep_one
from lapsekit.llm.op2_decontaminate import drop_leaks
from lapsekit.llm.op4_packing import pack_documents
from lapsekit.llm.op7_quality import keep_good
from lapsekit.llm.op9_secrets import redact
from lapsekit.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, chars="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("packing", packing)]

#: near duplicates, latent search, tokenisation and packing have no SQL form; tests/llm hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
