"""Training-data pipeline: STAGES applied one after another to ``documents``."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from hostlens.llm import stages
from hostlens.session import ensure_checkpoint_dir

STAGES = [
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup),
    ("decontaminate", stages.decontaminate),
    ("mix_sources", stages.mix_sources),
    ("shard", stages.shard),
]

#: language identification, similarity search and sampling are not SQL-expressible
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet to
    the shared checkpoint folder and read again as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = os.path.join(ensure_checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        at = f"{home}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
