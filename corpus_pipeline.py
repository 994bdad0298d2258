"""Corpus pipeline: quality, near duplicates, benchmark passages, mixture, token output.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet
and read again. The first four return the columns of ``documents``, the last the digest of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringside.llm import decontam, mixing, quality, tokens, weighted_minhash
from ringside.session import scratch_path

STAGES = [
    ("quality_classifier", quality.stage),
    ("near_dedup", weighted_minhash.stage),
    ("decontamination", decontam.stage),
    ("mixture", mixing.stage),
    ("token_output", tokens.stage),
]

#: A fitted classifier, random samples and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
