"""The corpus pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probecraft.llm import op3_language_id, op4_jaccard_join, op6_bpe, op8_suffix_dedup, op10_mixing
from probecraft.llm.common import Scratch

STAGES = [
    ("language_id", op3_language_id.stage),
    ("jaccard_join", op4_jaccard_join.stage),
    ("suffix_dedup", op8_suffix_dedup.stage),
    ("mixing", op10_mixing.stage),
    ("bpe", op6_bpe.stage),
]

#: Classifiers and suffix arrays have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
