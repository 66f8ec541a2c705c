"""The stages of the training-data pipeline: each takes documents and returns the documents that it keeps or makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import pii, toxicity
from siltstone.llm.common import Scratch
from siltstone.llm.decontaminate import decontaminate
from siltstone.llm.labels import fold
from siltstone.llm.minhash import deduplicate
from siltstone.llm.mixing import mix_sources


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below its threshold. It is trained on the labelled documents of
    ``sf_dir``, whatever ``docs`` still has of them, on the same rows of ``labels`` as op9."""
    labels = table(spark, sf_dir, "labels")
    sample = toxicity.sample_of(table(spark, sf_dir, "documents"), labels, fold("doc_id", 4) != 2, Scratch(spark, "toxic"))
    return toxicity.drop_toxic(docs, toxicity.train(sample))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8 or more."""
    return deduplicate(docs, Scratch(spark, "near"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "benchmark"))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind in brackets; n_chars is counted anew."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target weights, in a global random order."""
    return mix_sources(docs)
