"""Stored vectors: a cache by text, vectors that only stand in for embeddings, and the rule that decides between two records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.vector import cosine, doubles, hashed


def embedded(texts: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``texts`` (id, text) with hash, vector and cached, and the new entries of ``cache`` (hash, vector).

    ``embed`` maps (hash, text) to (hash, vector); it is asked once for each distinct text that the cache lacks. Both
    results read what it made, so an expensive one should write its result.
    """
    named = texts.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    known = cache.select("hash", "vector").dropDuplicates(["hash"])
    asked = named.select("hash", F.coalesce("text", F.lit("")).alias("text")).join(known, "hash", "left_anti").dropDuplicates(["hash"])
    made = embed(asked).select("hash", "vector")
    both = known.withColumn("cached", F.lit(True)).unionByName(made.withColumn("cached", F.lit(False)))
    return named.select("id", "hash").join(both, "hash", "left"), made


def kinds(records: DataFrame, width: int, least: float = 0.999) -> DataFrame:
    """(id, kind) for ``records`` (id, text, vector): what a stored vector is. ``hash`` is derived from the text's digest
    alone, ``semantic`` is any other, ``none`` is missing, and ``unknown`` has no text to tell by."""
    alike = cosine(doubles(F.col("vector")), hashed(F.col("text"), width))
    kind = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "unknown")
        .when(F.col("vector").isNull(), "none")
        .when(alike > least, "hash")
        .otherwise("semantic")
    )
    return records.select("id", kind.alias("kind"))


def decided(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(a, b, keep, drop): of each pair (a, b) the record that was changed last stays, else the weightier one, else the
    one with the smaller id. ``records`` has id, updated_at and importance; pairs with an unknown record are left out."""
    def side(name: str) -> DataFrame:
        rank = F.struct("updated_at", "importance", (-F.col("id")).alias("order")).alias(f"{name}_rank")
        return records.select(F.col("id").alias(name), rank)

    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    first = F.col("a_rank") >= F.col("b_rank")
    return both.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("drop"))
