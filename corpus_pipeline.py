"""The corpus pipeline: language ID, near-duplicates, PII, mixing, tokens, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import pipeline_stages as own
from skeinwork.llm.staging import read_table, stage

STAGES = [
    ("language_id", own.language_id),
    ("near_dedup", own.near_dedup),
    ("pii", own.pii),
    ("mixing", own.mixing),
    ("bpe", own.bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
