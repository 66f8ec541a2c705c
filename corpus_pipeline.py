"""From raw documents to a training mixture: toxicity, near-duplicates, benchmark passages, personal data, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import pipeline
from siltstone.llm.common import Scratch

#: (name, function) in order; each function takes (spark, docs, sf_dir) and returns the next one's docs.
STAGES = [
    ("toxicity", pipeline.without_toxic),
    ("minhash_near_dedup", pipeline.without_near_duplicates),
    ("benchmark_decontamination", pipeline.without_benchmark),
    ("pii", pipeline.without_private_data),
    ("mixing_sources", pipeline.mixed),
]

#: SQL can't express the classifiers of the toxicity and PII stages; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written to the scratch folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
