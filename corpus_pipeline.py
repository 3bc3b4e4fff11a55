"""The corpus pipeline: documents in, a weighted mix out. Every stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import stages
from runlens.session import new_folder

STAGES = [
    ("toxicity", stages.without_toxic),
    ("n-gram Jaccard join", stages.without_near_copies),
    ("substring dedup", stages.without_repeats),
    ("benchmark decontamination", stages.without_benchmark),
    ("mixing sources to target weights", stages.mixed),
]

#: The stages learn, hash and draw by seed; tests compare them with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name.replace(' ', '_')}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
